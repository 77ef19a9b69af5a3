"""The queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decision_list, hard_negatives, html_extract, license_scan, media_ogg, mixing, packing, periodic_runs, quality, simhash, suffix_dedup, token_output, url_rules
from siltstone.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.op1(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op2(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op3(table(spark, sf_dir, "documents"))


def op4_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ogg.op4(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.op11(table(spark, sf_dir, "pages"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.op13(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_token_output": op1_token_output,
    "op2_simhash": op2_simhash,
    "op3_license_scan": op3_license_scan,
    "op4_media_ogg": op4_media_ogg,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_html_extract": op7_html_extract,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_packing": op9_packing,
    "op10_decision_list": op10_decision_list,
    "op11_url_filter": op11_url_filter,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

#: The others' models, tokenizers, fingerprints and formats have no SQL; tests hold them against brute force and round trips.
ORACLE_SQL: dict[str, str] = {
    "op8_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 99, 512)) AS i, h FROM d WHERE len(h) >= 200),
        x AS (SELECT doc_id, i, substr(h, 2 * i + 1, 1222) AS h FROM c),
        s AS (SELECT doc_id, i, h, unnest(range(0, least(512, len(h) // 2 - 99))) AS j FROM x),
        w AS (SELECT doc_id, i + j AS p, md5_number(substr(h, 2 * j + 1, 200)) AS k FROM s),
        m AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
        g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM m),
        r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run),
        q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS pb FROM r),
        t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * pb + 1, 2 * (a - pb)), '' ORDER BY a) AS heads, max(b) AS last FROM q JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
        sha256(unhex(CASE WHEN last IS NULL THEN h ELSE heads || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op11_url_filter": r"""WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
        s AS (SELECT page_id, url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM u),
        k AS (SELECT *, string_split(host, '.') AS labels, string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&') AS keys,
        list_filter(string_split(regexp_replace(path, '\.[A-Za-z0-9]+$', ''), '/'), lambda x: x <> '') AS segments FROM s),
        t AS (SELECT row_number() OVER () AS id, page_id, host, path, list_concat(['tld=' || labels[-1]], list_transform(list_reverse(string_split_regex(array_to_string(labels[1:len(labels) - 1], '.'), '[.\-]')), lambda x: 'host=' || x),
        list_transform(segments, lambda x: 'path=' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' || len(x) ELSE x END), ['ext=' || regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)],
        list_transform(keys, lambda x: 'query=' || string_split(x, '=')[1])) AS every FROM k),
        f AS (SELECT *, list_filter(every, lambda x: NOT regexp_full_match(x, '[a-z]+=')) AS given FROM t),
        p AS (SELECT id, page_id, host, path, list_filter(given, lambda x, i: list_position(given, x) = i) AS tokens,
        CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
        WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM f),
        l AS (SELECT id, tokens[1:12] AS tokens, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' ELSE 'block' END AS verdict FROM p WHERE rule IS NOT NULL),
        n AS (SELECT count(*) AS n FROM l), v AS (SELECT verdict, count(*) AS n_verdict FROM l GROUP BY verdict),
        x AS (SELECT id, verdict, unnest(tokens) AS t FROM l),
        c AS (SELECT verdict, [t] AS items FROM x UNION ALL SELECT a.verdict, [a.t, b.t] FROM x a JOIN x b ON a.id = b.id AND a.t < b.t
        UNION ALL SELECT a.verdict, [a.t, b.t, c.t] FROM x a JOIN x b ON a.id = b.id AND a.t < b.t JOIN x c ON c.id = b.id AND b.t < c.t),
        g AS (SELECT verdict, items, count(*) AS n_both, sum(count(*)) OVER (PARTITION BY items)::BIGINT AS n_items FROM c GROUP BY verdict, items),
        r AS (SELECT verdict, items, n_both, n_items FROM g JOIN v USING (verdict), n WHERE n_both >= greatest(5, (n * 5 + 999) // 1000) AND 100 * n_both >= 80 * n_items AND n_both * n > n_items * n_verdict),
        k2 AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r s WHERE s.verdict = r.verdict AND len(s.items) < len(r.items) AND list_has_all(r.items, s.items) AND s.n_both * r.n_items >= r.n_both * s.n_items)),
        b AS (SELECT id, k2.verdict, items FROM p JOIN k2 ON list_has_all(p.tokens, k2.items)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY n_both::DOUBLE / n_items DESC, n_both DESC, len(items) DESC, k2.verdict DESC, items DESC) = 1)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE coalesce(b.verdict, 'allow') END AS verdict,
        CASE WHEN rule IS NULL THEN array_to_string(items, ' ') END AS pattern FROM p LEFT JOIN b USING (id)""",
    "op12_periodic_runs": r"""WITH z AS (SELECT list(v ORDER BY k) AS z FROM (SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, s: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(0, 256) t(k))),
        d AS (SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        coalesce(xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, z[(xor(c, b) & 255) + 1]))), 1) AS h FROM documents, z),
        a AS (SELECT id, doc_id, w, len(w) AS n, h, (h // 10) % greatest(len(w), 1) AS a FROM d),
        p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
        t AS (SELECT id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
        g AS (SELECT id, i, md5_number(array_to_string(w[i + 1:i + 6], ' ')) AS k FROM (SELECT id, w, unnest(range(0, n - 5)) AS i FROM t WHERE n >= 12)),
        m AS (SELECT a.id, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.id = b.id AND a.k = b.k AND a.i < b.i),
        s AS (SELECT id, q, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS part, i FROM m),
        e AS (SELECT id, min(i) AS start, count(*) + 5 + q AS length, q FROM s GROUP BY id, q, part HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
        r AS (SELECT id, start, length, min(q) AS period FROM e GROUP BY id, start, length),
        o AS (SELECT id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS said FROM r GROUP BY id),
        b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY length DESC, start, period) = 1),
        x AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM r),
        y AS (SELECT id, string_agg(v, ' ' ORDER BY i) AS kept FROM (SELECT id, unnest(w) AS v, unnest(range(0, n)) AS i FROM t) ANTI JOIN x USING (id, i) GROUP BY id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM t LEFT JOIN o USING (id) LEFT JOIN b USING (id) LEFT JOIN y USING (id)""",
    "op13_hard_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank, n.other_id AS negative_id,
        p.score AS positive_score, n.score AS negative_score FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        QUALIFY rank <= 10""",
}
