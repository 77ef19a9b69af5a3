"""The catalogue's queries in DuckDB SQL over the same tables."""

from __future__ import annotations

CJK = "\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}"
SPACE = "\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"
LINK = "(?is)<a\\b[^>]*href\\s*=\\s*[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>"
EARLY = "1996-01-01"


def tokens(c: str) -> str:
    return f"(len(regexp_extract_all({c}, '[{CJK}]')) + ceil(length(regexp_replace({c}, '[{CJK}{SPACE}]', '', 'g')) / 4))::BIGINT"


def entities(c: str) -> str:
    for name, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{by}')"
    return c


def occurrences(c: str, token: str) -> str:
    return f"((length({c}) - length(replace({c}, '{token}', ''))) / {len(token)})::BIGINT"


LINES = "(SELECT doc_id, i AS line, trim(l) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(l) <> '')"
WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))"
TITLE = entities("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")
PAGE_LINKS = f"""(SELECT page_id, i AS position, {entities("t")} AS target, {entities("l")} AS label FROM (SELECT page_id,
    unnest(regexp_extract_all(html, '{LINK}', 1)) AS t, unnest(regexp_extract_all(html, '{LINK}', 2)) AS l,
    generate_subscripts(regexp_extract_all(html, '{LINK}', 1), 1) AS i FROM pages))"""


def page_text() -> str:
    x = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "noscript", "template"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', '', 'g')"
    x = f"regexp_replace({x}, '(?i)</(h[1-6]|p|div|section|article|li|tr|pre|blockquote)>|<[bh]r\\b[^>]*>|<li\\b[^>]*>|<h[1-6]\\b[^>]*>', chr(10), 'g')"
    return entities(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")


def shipped(day: str | None) -> str:
    where = f"l_shipdate < TIMESTAMP '{day}'" if day else f"NOT (l_shipdate < TIMESTAMP '{EARLY}' AND l_returnflag = 'R')"
    return f"""(SELECT l_orderkey::VARCHAR AS logical_path, sha256(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber)) AS h FROM lineitem
        WHERE {where} GROUP BY l_orderkey)"""


def search(content: str, title: str, words: list[str], where: str = "TRUE") -> str:
    """A common table expression ``scored`` of doc_id, score."""
    tf = ", ".join(f"1.0 * {occurrences('c', w)} + 1.5 * {occurrences('t', w)} AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in range(len(words)))
    some = " + ".join(f"tf{i}" for i in range(len(words)))
    return f"""low AS (SELECT doc_id, lower({content}) AS c, lower({title}) AS t FROM documents WHERE {where}),
        counted AS (SELECT doc_id, greatest(length(c) - 2, 0) + greatest(length(t) - 2, 0) AS dl, {tf} FROM low),
        stats AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM counted),
        scored AS (SELECT doc_id, {score} AS score FROM counted, stats WHERE {some} > 0)"""


FIRST_LINE = "string_split(text, chr(10))[1]"
FTS = search("text", FIRST_LINE, ["licensed", "apache"])
NEAR = """near AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) AS similarity FROM embeddings)"""
SPACES = """c AS (SELECT doc_id AS chunk_id, sha256(text) AS content_hash FROM documents),
    e AS (SELECT vec_id AS chunk_id, CASE WHEN label < 5 THEN coalesce(sha256(text), 'none') ELSE sha256('old' || vec_id) END AS h FROM embeddings LEFT JOIN documents ON vec_id = doc_id),
    b AS (SELECT coalesce(c.chunk_id, e.chunk_id) AS chunk_id, content_hash, h FROM c FULL JOIN e ON c.chunk_id = e.chunk_id)"""
EDGES = """edges AS (SELECT 'region:' || n_regionkey AS subject, 'contains' AS predicate, 'nation:' || n_nationkey AS object FROM nation
    UNION ALL SELECT 'nation:' || c_nationkey, 'contains', 'customer:' || c_custkey FROM customer
    UNION ALL SELECT 'customer:' || o_custkey, 'contains', 'order:' || o_orderkey FROM orders)"""
STEPS = "steps AS (SELECT subject AS a, object AS b FROM edges UNION ALL SELECT object, subject FROM edges)"


def claims(before: str | None = None) -> str:
    """Common table expressions up to ``classified``."""
    where = f"WHERE l_shipdate < TIMESTAMP '{before}'" if before else ""
    return f"""lines AS (SELECT l_partkey AS claim_id, l_suppkey, l_returnflag, l_tax FROM lineitem {where}),
    disputed AS (SELECT claim_id FROM lines GROUP BY claim_id HAVING 6 * count(*) FILTER (l_tax >= 0.08) >= count(*) AND 6 * count(*) FILTER (l_tax < 0.005) >= count(*)),
    per AS (SELECT claim_id, count(DISTINCT l_suppkey) AS lineages, count(*) AS evidence, max(CASE l_returnflag WHEN 'N' THEN 2 WHEN 'R' THEN 1 ELSE 0 END) AS best FROM lines GROUP BY claim_id),
    parts AS (SELECT p_partkey AS claim_id, p_brand AS topic, CASE WHEN p_size <= 5 THEN 'user_confirmed' WHEN p_size >= 48 THEN 'rejected' ELSE 'proposed' END AS status,
        CASE p_size WHEN 20 THEN 'user_opinion' WHEN 30 THEN 'inference' ELSE 'fact' END AS epistemic FROM part),
    held AS (SELECT p.*, lineages, evidence, best, d.claim_id IS NOT NULL AS open, greatest(1, coalesce(lineages, 0)) AS sources FROM parts p LEFT JOIN per USING (claim_id) LEFT JOIN disputed d USING (claim_id)),
    rated AS (SELECT *, round(0.6 * 0.16 + CASE best WHEN 2 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END * 0.18
        + CASE WHEN sources <= 1 THEN 0.35 ELSE least(1.0, 0.65 + 0.1 * least(3, sources - 2)) END * 0.18 + 0.6 * 0.10 + 0.85 * 0.14
        + CASE WHEN open THEN 0.15 ELSE 1.0 END * 0.16 + CASE status WHEN 'user_confirmed' THEN 1.0 WHEN 'rejected' THEN 0.0 ELSE 0.5 END * 0.08, 4)::DOUBLE AS score FROM held),
    leveled AS (SELECT * EXCLUDE (status), CASE WHEN open AND status NOT IN ('rejected', 'user_confirmed') THEN 'disputed' ELSE status END AS status,
        CASE WHEN open THEN 'disputed' WHEN score >= 0.78 THEN 'high' WHEN score >= 0.55 THEN 'medium' WHEN score >= 0.3 THEN 'low' ELSE 'unknown' END AS confidence_level FROM rated),
    classified AS (SELECT *, CASE WHEN status = 'disputed' OR open THEN 'conflict' WHEN epistemic = 'user_opinion' THEN 'user_opinion' WHEN epistemic = 'inference' THEN 'inference'
        WHEN lineages >= 2 THEN 'consensus' ELSE 'single_source' END AS conclusion_type,
        CASE confidence_level WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'disputed' THEN 1 ELSE 0 END AS r FROM leveled WHERE lineages IS NOT NULL)"""


LEVEL = "CASE {} WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' WHEN 1 THEN 'disputed' ELSE 'unknown' END"
SECTIONS = f"""sections AS (SELECT topic, conclusion_type AS section, count(*) AS n_claims, CASE WHEN conclusion_type = 'conflict' THEN 'disputed' ELSE {LEVEL.format("max(r)")} END AS confidence_level,
    CASE conclusion_type WHEN 'conflict' THEN 'needs_review' WHEN 'single_source' THEN 'degraded' ELSE 'healthy' END AS health_status FROM classified GROUP BY topic, conclusion_type)"""
REPORT = f"""g AS (SELECT topic, count(*) AS n_claims, count(*) FILTER (conclusion_type = 'consensus') AS n_consensus, count(*) FILTER (conclusion_type = 'conflict') AS n_conflict,
    count(*) FILTER (conclusion_type = 'single_source') AS n_single, max(r) AS best, max(r) FILTER (conclusion_type = 'consensus') AS core FROM classified GROUP BY topic),
    report AS (SELECT topic, n_claims, n_consensus, n_conflict, n_single, CASE WHEN n_conflict > 0 THEN 'needs_review' WHEN n_consensus > 0 THEN 'healthy' ELSE 'degraded' END AS health_status,
    CASE WHEN n_conflict > 0 THEN 'disputed' ELSE {LEVEL.format("coalesce(core, best)")} END AS confidence_level,
    CASE WHEN n_conflict > 0 THEN 'unresolved_conflict' WHEN n_consensus > 0 THEN 'strongest_key_claims' ELSE 'single_lineage_limit' END AS decisive_rule FROM g)"""
HINTS = "SELECT event_type, (epoch(date_trunc('hour', ts)))::BIGINT AS bucket, count(*) AS n FROM events GROUP BY 1, 2"

SQL: dict[str, str] = {
    "token_estimate_by_lang": f"SELECT lang, count(*) AS n, sum({tokens('text')})::BIGINT AS tokens FROM documents GROUP BY lang",
    "language_detect": """SELECT doc_id, CASE WHEN h = 0 AND l = 0 THEN 'und' WHEN h > l * 0.2 THEN 'zh' ELSE 'en' END AS language
        FROM (SELECT doc_id, len(regexp_extract_all(text, '\\p{Han}')) AS h, len(regexp_extract_all(text, '\\p{Latin}')) AS l FROM documents)""",
    "text_normalize_hash": f"""SELECT doc_id, sha256(nfc_normalize(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[\\t ]+(\\n|\\z)', '\\1', 'g'),
        '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\A[{SPACE}]+|[{SPACE}]+\\z', '', 'g'))) AS content_hash FROM documents""",
    "line_blocks": f"SELECT doc_id, line, length(text)::BIGINT AS n_chars, {tokens('text')} AS tokens FROM {LINES}",
    "paragraph_anchor": f"""SELECT doc_id, line, occurrence, sha256(heading || chr(10) || occurrence) AS anchor_key FROM (SELECT doc_id, line, heading,
        row_number() OVER (PARTITION BY doc_id, heading ORDER BY line) - 1 AS occurrence FROM (SELECT doc_id, line, string_split(text, ' ')[1] AS heading FROM {LINES}))""",
    "secret_and_path_flags": """SELECT page_id, regexp_matches(path, '(^|/)\\.[^/]') AS hidden,
        regexp_matches(lower(path), '(^|/)(\\.env[^/]*|[^/]*\\.(pem|key|p12)|credentials\\.json|secrets\\.json)$') AS sensitive,
        regexp_matches(path, '^(?:.*/)?en/[^/]*$') OR regexp_matches(path, '^www\\.[^/]*/.*$') AS included,
        contains(lower(html), 'idiot') OR contains(lower(html), 'trash') OR contains(lower(html), 'moron') AS excluded
        FROM (SELECT page_id, html, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages)""",
    "html_title": f"SELECT page_id, {TITLE} AS title FROM pages",
    "html_text": f"""SELECT page_id, len(t) AS n_lines, sha256(array_to_string(t, chr(10))) AS text_hash FROM (SELECT page_id,
        list_filter(list_transform(string_split({page_text()}, chr(10)), lambda v: trim(regexp_replace(v, '[ \\t\\r]+', ' ', 'g'))), lambda v: v <> '') AS t FROM pages)""",
    "html_links": f"SELECT page_id, position, target, label FROM {PAGE_LINKS}",
    "html_headings": f"""SELECT page_id, i AS position, regexp_extract(h, '^<[hH]([1-6])', 1) AS level, trim({entities("regexp_replace(h, '<[^>]+>', '', 'g')")}) AS heading
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h([1-6])\\b[^>]*>.*?</h[1-6]>', 0)) AS h, generate_subscripts(regexp_extract_all(html, '(?is)<h([1-6])\\b[^>]*>.*?</h[1-6]>', 0), 1) AS i FROM pages)""",
    "link_graph_resolve": f"""WITH p AS (SELECT page_id, {TITLE} AS title FROM pages), paths AS (SELECT page_id, lower(string_split(title, ' ')[1]) AS path, lower(title) AS title FROM p),
        parts AS (SELECT page_id, title, string_split(path, '/') AS s FROM paths), tails AS (SELECT page_id, unnest(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[i:len(s)], '/'))) AS k FROM parts),
        names AS (SELECT page_id, k FROM tails UNION SELECT page_id, regexp_replace(k, '\\.md$', '') FROM tails UNION SELECT page_id, title FROM paths),
        keys AS (SELECT k, count(DISTINCT page_id) AS n, min(page_id) AS document_id FROM names WHERE k <> '' GROUP BY k),
        refs AS (SELECT page_id, position, target, regexp_replace(lower(url_decode(trim(string_split(target, '#')[1]))), '^(\\.{{0,2}}/)+', '') AS k FROM {PAGE_LINKS})
        SELECT r.page_id, position, target, coalesce(n, 0) AS n_targets, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS state,
        CASE WHEN n = 1 THEN document_id END AS document_id FROM refs r LEFT JOIN keys USING (k)""",
    "backlinks_topk": f"SELECT target AS object, count(*) AS n_links, count(DISTINCT page_id) AS n_subjects FROM {PAGE_LINKS} GROUP BY target ORDER BY n_links DESC, object LIMIT 20",
    "blob_dedupe": "SELECT sha256(text) AS sha256, max(strlen(text))::BIGINT AS size_bytes, count(*) AS refs FROM documents GROUP BY 1",
    "gc_unreferenced": """SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
        OR doc_id IN (SELECT vec_id FROM embeddings))""",
    "snapshot_diff": f"""SELECT coalesce(a.logical_path, b.logical_path) AS logical_path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' ELSE 'modified' END AS change_kind,
        a.h AS previous_blob_sha256, b.h AS blob_sha256 FROM {shipped(EARLY)} a FULL JOIN {shipped(None)} b ON a.logical_path = b.logical_path WHERE a.h IS DISTINCT FROM b.h""",
    "build_diff": f"""SELECT CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS change_kind, count(*) AS n
        FROM {shipped(EARLY)} a FULL JOIN {shipped(None)} b ON a.logical_path = b.logical_path GROUP BY 1""",
    "change_classify": """WITH prev AS (SELECT CASE WHEN lang = 'de' THEN source ELSE lang END || '/' || doc_id AS path, sha256(text) AS h, CASE WHEN lang = 'es' THEN 'deleted' ELSE 'active' END AS state, FALSE AS over FROM documents
        UNION ALL SELECT url, sha256(max(html)), 'missing_pending', length(max(html)) > 3000 FROM pages GROUP BY url),
        cur AS (SELECT lang || '/' || doc_id AS path, CASE WHEN lang = 'fr' THEN sha256(upper(text)) ELSE sha256(text) END AS h FROM documents),
        gone AS (SELECT * FROM prev WHERE state <> 'deleted' AND lower(path) NOT IN (SELECT lower(path) FROM cur)),
        fresh AS (SELECT * FROM cur WHERE lower(path) NOT IN (SELECT lower(path) FROM prev)),
        one AS (SELECT h, min(path) AS old FROM gone GROUP BY h HAVING count(*) = 1), first AS (SELECT h, min(path) AS path FROM fresh GROUP BY h),
        moved AS (SELECT path, old, h FROM one JOIN first USING (h))
        SELECT c.path AS relative_path, CASE WHEN state = 'deleted' THEN 'restored' ELSE 'modified' END AS kind, NULL::VARCHAR AS previous_path, p.h AS previous_hash, c.h AS current_hash
        FROM prev p JOIN cur c ON lower(p.path) = lower(c.path) WHERE state = 'deleted' OR p.h <> c.h
        UNION ALL SELECT path, 'renamed', old, h, h FROM moved
        UNION ALL SELECT path, 'created', NULL, NULL, h FROM fresh WHERE path NOT IN (SELECT path FROM moved)
        UNION ALL SELECT path, CASE WHEN state = 'missing_pending' AND over THEN 'deleted' ELSE 'missing_pending' END, NULL, h, NULL FROM gone WHERE path NOT IN (SELECT old FROM moved)""",
    "revision_reuse": """SELECT doc_id, source, sum(CASE WHEN reused THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS sequence, reused
        FROM (SELECT doc_id, source, coalesce(lag(lang) OVER (PARTITION BY source ORDER BY doc_id) = lang, FALSE) AS reused FROM documents)""",
    "chunk_jaccard_pairs": f"""SELECT doc_id, previous_id, round(CASE WHEN len(t) + len(p) = 0 THEN 1.0 ELSE len(list_intersect(t, p)) / (len(t) + len(p) - len(list_intersect(t, p))) END, 6)::DOUBLE AS similarity
        FROM (SELECT doc_id, {WORDS} AS t, lag(doc_id) OVER w AS previous_id, lag({WORDS}) OVER w AS p FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE previous_id IS NOT NULL""",
    "duplicate_lineages": """SELECT sha256(text) AS sha256, count(*) AS n_documents, count(DISTINCT source) AS n_lineages, count(*) - count(DISTINCT source) AS n_reposts FROM documents GROUP BY 1""",
    "redirect_closure": """SELECT doc_id AS entity, first AS final FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) WHERE doc_id <> first""",
    "trigram_postings": """SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest(list_transform(range(1, length(lower(text)) - 1), lambda i: substr(lower(text), i, 3))) AS term
        FROM documents WHERE length(text) >= 3) GROUP BY term""",
    "fts_bm25_top20": f"WITH {FTS} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 20",
    "fts_substring_fallback": "SELECT doc_id FROM documents WHERE contains(lower(text), 'zz') ORDER BY doc_id LIMIT 100",
    "knn_cosine_top20": f"WITH {NEAR} SELECT vec_id, round(similarity, 6) AS similarity FROM near ORDER BY round(similarity, 9) DESC, vec_id LIMIT 20",
    "semantic_neighbors_top8": """SELECT vec_id, neighbor, rank, round(s, 6) AS similarity FROM (SELECT a.vec_id, b.vec_id AS neighbor, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 8""",
    "vector_l2_norm": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings",
    "vector_coverage": f"WITH {SPACES} SELECT count(content_hash) AS expected, count(*) FILTER (content_hash = h) AS covered, count(h) AS stored FROM b",
    "vector_stale": f"""WITH {SPACES} SELECT chunk_id, CASE WHEN content_hash IS NULL THEN 'gone' WHEN h IS NULL THEN 'missing' ELSE 'stale' END AS state FROM b WHERE content_hash IS DISTINCT FROM h""",
    "rrf_hybrid": f"""WITH {FTS}, {NEAR}, routes AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 80
        UNION ALL SELECT vec_id, row_number() OVER (ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM near QUALIFY rank <= 80)
        SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS n_routes FROM routes GROUP BY doc_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, doc_id LIMIT 20""",
    "search_filtered": f"""WITH {search("text", FIRST_LINE, ["licensed", "under"], "source = 'src0'")}, ranked AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 80),
        boosted AS (SELECT doc_id, text, 1.0::DOUBLE / (60 + rank) + CASE WHEN contains(lower({FIRST_LINE}), 'licensed under') THEN 0.01 ELSE 0 END AS score, greatest(1, instr(lower(text), 'licensed') - 80) AS s FROM ranked JOIN documents USING (doc_id))
        SELECT doc_id, round(score, 9) AS score, CASE WHEN s > 1 THEN '…' ELSE '' END || substr(text, s, 320) || CASE WHEN s + 319 < length(text) THEN '…' ELSE '' END AS excerpt
        FROM boosted ORDER BY round(score, 9) DESC, doc_id LIMIT 20""",
    "context_budget": f"""SELECT doc_id, source, tokens, position, used, least(tokens, 6000 - used)::BIGINT AS taken FROM (SELECT doc_id, source, tokens, row_number() OVER w AS position,
        coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used
        FROM (SELECT doc_id, source, {tokens('text')} AS tokens FROM documents) WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE 6000 - used >= 64""",
    "graph_structure_edges": f"WITH {EDGES} SELECT * FROM edges",
    "graph_neighbors_2hop": f"""WITH RECURSIVE {EDGES}, {STEPS}, walk AS (SELECT 'customer:1' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN steps ON node = a WHERE depth < 2)
        SELECT node, min(depth)::BIGINT AS depth FROM walk GROUP BY node""",
    "graph_subgraph": f"""WITH RECURSIVE {EDGES}, {STEPS}, walk AS (SELECT 'region:0' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN steps ON node = a WHERE depth < 2),
        seen AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
        SELECT subject, predicate, object, least(x.depth, y.depth)::BIGINT AS depth FROM edges JOIN seen x ON subject = x.node JOIN seen y ON object = y.node""",
    "graph_path": f"""WITH RECURSIVE {EDGES}, {STEPS}, walk AS (SELECT 'nation:0' AS node, ['nation:0'] AS path UNION ALL
        SELECT b, list_append(path, b) FROM walk JOIN steps ON node = a WHERE len(path) <= 2 AND NOT list_contains(path, b))
        SELECT (len(path) - 1)::BIGINT AS depth, array_to_string(path, '>') AS path FROM walk WHERE node = 'nation:5' ORDER BY depth, path LIMIT 1""",
    "generation_diff": f"""WITH a AS (SELECT DISTINCT o_custkey AS subject, o_orderpriority AS object FROM orders WHERE o_orderdate < TIMESTAMP '{EARLY}'),
        b AS (SELECT DISTINCT o_custkey AS subject, o_orderpriority AS object FROM orders WHERE NOT (o_orderdate < TIMESTAMP '{EARLY}' AND o_orderstatus = 'F'))
        SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "predicate_domain_check": f"""WITH {EDGES}, kinds AS (SELECT *, string_split(subject, ':')[1] AS s, string_split(object, ':')[1] AS o FROM edges)
        SELECT DISTINCT subject, predicate, object, CASE WHEN s NOT IN ('region', 'nation') THEN 'domain' WHEN o NOT IN ('nation', 'customer') THEN 'range' END AS issue FROM kinds""",
    "graph_verify": """SELECT DISTINCT 'edge_subject' AS "check", page_id::VARCHAR AS id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents)
        UNION SELECT 'edge_object', length(html)::VARCHAR FROM pages WHERE length(html) NOT IN (SELECT doc_id FROM documents)
        UNION SELECT 'claim_subject', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
        UNION SELECT 'claim_evidence', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
    "claim_conflicts": """SELECT l_partkey, l_returnflag, count(*) AS n_claims, count(DISTINCT l_suppkey) AS n_positions FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1""",
    "claim_confidence": f"""WITH {claims()} SELECT claim_id, status, score, confidence_level, 'sources: ' || sources AS reason FROM leveled""",
    "evidence_expand": """WITH c AS (SELECT l_partkey || '-' || l_suppkey AS claim_id, min(l_partkey) AS subject, min(l_linestatus) = 'F' AS stale FROM lineitem GROUP BY l_partkey, l_suppkey),
        s AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'), x AS (SELECT * FROM lineitem WHERE l_orderkey IN (FROM s)),
        ents AS (SELECT DISTINCT l_partkey AS e FROM x),
        reached AS (SELECT claim_id, min(r) AS route_rank FROM (SELECT DISTINCT l_partkey || '-' || l_suppkey AS claim_id, 0 AS r FROM x UNION ALL
        SELECT claim_id, 1 FROM c WHERE subject IN (FROM ents) OR string_split(claim_id, '-')[2]::BIGINT IN (FROM ents)) WHERE claim_id IN (SELECT claim_id FROM c WHERE NOT stale) GROUP BY claim_id)
        SELECT route_rank::BIGINT AS route_rank, CASE WHEN l_returnflag = 'R' THEN 'contradict' ELSE 'support' END AS role, count(*) AS n, count(DISTINCT claim_id) AS n_claims
        FROM lineitem JOIN reached ON claim_id = l_partkey || '-' || l_suppkey GROUP BY 1, 2""",
    "topic_classify": f"""WITH {claims()} SELECT claim_id, conclusion_type, CASE conclusion_type WHEN 'conflict' THEN 'contradicting' WHEN 'consensus' THEN 'core' ELSE 'supporting' END AS role,
        lineages AS independent_source_count, evidence AS evidence_count, evidence - lineages AS repost_count FROM classified""",
    "topic_sections": f"WITH {claims()}, {SECTIONS} SELECT * FROM sections",
    "topic_health": f"WITH {claims()}, {REPORT} SELECT * FROM report",
    "topic_gaps": f"""WITH {claims()}, {REPORT} SELECT topic, 'high' AS severity, 'Claims contradict each other: what would show which of them holds?' AS question FROM report WHERE n_conflict > 0
        UNION ALL SELECT topic, 'medium', 'Some claims rest on one source: is there a second one?' FROM report WHERE n_single > 0""",
    "topic_section_changes": f"""WITH a AS (WITH {claims(EARLY)}, {SECTIONS} SELECT topic, section, n_claims || '|' || confidence_level || '|' || health_status AS d FROM sections),
        b AS (WITH {claims()}, {SECTIONS} SELECT topic, section, n_claims || '|' || confidence_level || '|' || health_status AS d FROM sections)
        SELECT coalesce(a.topic, b.topic) AS topic, coalesce(a.section, b.section) AS section, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' WHEN a.d = b.d THEN 'unchanged' ELSE 'modified' END AS change
        FROM a FULL JOIN b ON a.topic = b.topic AND a.section = b.section""",
    "impact_cascade": """WITH s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3), o AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey IN (FROM s)),
        c AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey IN (FROM o))
        SELECT 'nation' AS kind, 1::BIGINT AS n, 0::BIGINT AS depth UNION ALL SELECT 'supplier', count(*), 1 FROM s UNION ALL SELECT 'order', count(*), 2 FROM o UNION ALL SELECT 'customer', count(*), 3 FROM c""",
    "integrity_checks": """SELECT DISTINCT 'line_order' AS "check", l_orderkey::VARCHAR AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION SELECT 'vector_label', vec_id::VARCHAR FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
        UNION SELECT 'customer_without_order', c_custkey::VARCHAR FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
        UNION SELECT 'part_without_line', p_partkey::VARCHAR FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""",
    "purge_blockers": """SELECT 'documents' AS blocker, count(*) AS n FROM documents WHERE source = 'src0' UNION ALL SELECT 'labels', count(*) FROM documents WHERE source = 'src0' AND doc_id IN (SELECT doc_id FROM labels)
        UNION ALL SELECT 'embeddings', count(*) FROM documents WHERE source = 'src0' AND doc_id IN (SELECT vec_id FROM embeddings)""",
    "exclusive_blobs": "SELECT min(source) AS source, sha256(text) AS sha256 FROM documents GROUP BY sha256(text) HAVING count(DISTINCT source) = 1",
    "state_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "next_sequence": """SELECT user_id, event_id, coalesce(top, 0) + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events
        LEFT JOIN (SELECT user_id, count(*) AS top FROM events WHERE event_type IN ('purchase', 'click') GROUP BY user_id) USING (user_id) WHERE event_type NOT IN ('purchase', 'click')""",
    "undo_fold": "SELECT user_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "event_hint_buckets": HINTS,
    "stream_hint_buckets": HINTS,
    "event_sessions": """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
        SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
    "event_props_json": "SELECT event_type, count(json_extract(props, '$.k')) AS n, sum((json_extract(props, '$.k'))::BIGINT)::BIGINT AS total FROM events GROUP BY event_type",
    "conversation_turns": f"""SELECT conv_id, turn, lag(role) OVER w AS previous_role, (sum({tokens('text')}) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS tokens_so_far
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "line_to_chunk": f"""WITH c AS (SELECT doc_id, o AS ordinal, min(line) AS s, max(line) AS e FROM (SELECT doc_id, line, (row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1) // 10 AS o FROM {LINES}) GROUP BY 1, 2),
        l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 2)) AS line FROM documents)
        SELECT l.doc_id, line, coalesce(min(ordinal) FILTER (line BETWEEN s AND e), min(ordinal)) AS ordinal, count(*) FILTER (line BETWEEN s AND e) > 0 AS inside FROM l LEFT JOIN c USING (doc_id) GROUP BY 1, 2""",
    "event_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type",
    "build_candidates": "SELECT doc_id AS source_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))",
    "restorable_resources": """SELECT user_id, NULL::VARCHAR AS before, event_type AS after FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type = 'click'""",
    "answer_deterministic": f"""WITH e AS (SELECT conv_id, turn, text, role = 'assistant' AND length(text) > 400 AS d FROM conversations),
        l AS (SELECT *, list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_replace(x, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) AS ls FROM e),
        s AS (SELECT *, substr(coalesce(list_filter(ls, lambda x: starts_with(x, '@claim '))[1], list_filter(ls, lambda x: x <> '' AND NOT starts_with(x, '#'))[1], text, ''), 1, 600) AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, bool_or(d) OVER (PARTITION BY conv_id) AS any_d FROM l),
        t AS (SELECT * FROM s WHERE n = 1 OR (any_d AND n = 2)),
        a AS (SELECT conv_id, bool_or(d) AS c, string_agg('E' || turn, ',' ORDER BY turn) AS k, string_agg(x, chr(10) ORDER BY turn) AS st FROM t GROUP BY conv_id)
        SELECT doc_id AS conv_id, CASE WHEN k IS NULL THEN 'insufficient_evidence' WHEN c THEN 'conflicted' ELSE 'answered' END AS result_kind, coalesce(k, '') AS evidence_keys, coalesce(st, '') AS statements
        FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN a ON conv_id = doc_id""",
    "retrieval_records": """SELECT conv_id, count(DISTINCT turn) AS n_candidates, count(*) FILTER (role = 'user') AS n_items, count(DISTINCT role) AS n_routes,
        sha256(string_agg(turn || ':' || length(text), chr(10) ORDER BY turn) FILTER (role = 'user')) AS context_hash FROM conversations GROUP BY conv_id""",
    "related_by_id": f"WITH {EDGES}, {STEPS} SELECT DISTINCT b AS node, 1::BIGINT AS depth FROM steps WHERE a = 'nation:7'",
    "fts_raw_score": f"WITH {FTS} SELECT doc_id, round(1 / (1 + abs(score)), 6) AS raw_score FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 20",
    "topic_health_all": f"""WITH {claims()}, {REPORT} SELECT * FROM report UNION ALL
        SELECT r_name, 0, 0, 0, 0, 'insufficient', 'unknown', 'no_supported_claim' FROM region WHERE r_name NOT IN (SELECT topic FROM report)
        UNION ALL SELECT DISTINCT p_brand, 0, 0, 0, 0, 'insufficient', 'unknown', 'no_supported_claim' FROM part WHERE p_brand NOT IN (SELECT topic FROM report)""",
    "topic_gaps_all": f"""WITH {claims()}, {REPORT} SELECT topic, 'high' AS severity, 'Claims contradict each other: what would show which of them holds?' AS question FROM report WHERE n_conflict > 0
        UNION ALL SELECT topic, 'medium', 'Some claims rest on one source: is there a second one?' FROM report WHERE n_single > 0
        UNION ALL SELECT DISTINCT t, 'high', 'No claim is recorded yet: what do the documents say about this topic?' FROM (SELECT r_name AS t FROM region UNION SELECT p_brand FROM part) WHERE t NOT IN (SELECT topic FROM report)""",
    "topic_local_graph": """SELECT p_brand AS topic, (count(DISTINCT l_partkey) + count(DISTINCT l_suppkey))::BIGINT AS n_nodes, count(DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) FILTER (l_returnflag <> 'R') AS n_relations
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
    "artifact_dependencies": """SELECT DISTINCT l_orderkey AS artifact, 'part' AS kind, l_partkey::VARCHAR AS dependency FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 'supplier', l_suppkey::VARCHAR FROM lineitem
        UNION ALL SELECT DISTINCT o_orderkey, 'customer', o_custkey::VARCHAR FROM orders""",
    "conflict_sets_resolved": """SELECT s_suppkey AS conflict_id, CASE WHEN s_suppkey % 4 = 0 THEN 'rejected' WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND trim(l_linestatus) <> '') THEN 'proposed'
        ELSE 'resolved' END AS status FROM supplier""",
    "conflict_details": """SELECT l_suppkey AS conflict_id, count(DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) AS n_claims, count(DISTINCT l_returnflag) AS n_positions, min(l_returnflag) AS least, max(l_returnflag) AS most
        FROM lineitem GROUP BY l_suppkey""",
    "graph_bounded": f"""WITH RECURSIVE {EDGES}, {STEPS}, walk AS (SELECT 'region:0' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN steps ON node = a WHERE depth < 2),
        nodes AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node), kept AS (SELECT * FROM nodes ORDER BY depth, node LIMIT 20),
        found AS (SELECT subject, object, least(x.depth, y.depth)::BIGINT AS depth FROM edges JOIN kept x ON subject = x.node JOIN kept y ON object = y.node)
        SELECT *, (SELECT count(*) FROM nodes) > 20 OR (SELECT count(*) FROM found) > 15 AS truncated FROM found ORDER BY depth, subject, object LIMIT 15""",
    "snapshot_reuse": """SELECT source || '/' || lang AS source, lang NOT IN ('es', 'fr') AS reused, count(*) FILTER (lang IN ('es', 'fr')) AS n_changed FROM documents GROUP BY source, lang""",
    "ingestion_stages": """SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'ready' ELSE 'parsing' END AS state, CASE WHEN count(*) FILTER (event_type = 'purchase') OVER
        (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'ingestion_state_invalid' END AS error FROM events""",
    "event_feed": "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 200",
    "resource_dependents": """SELECT 'part' AS kind, l_partkey::VARCHAR AS id, 'line' AS dependent, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY l_partkey
        UNION ALL SELECT 'supplier', l_suppkey::VARCHAR, 'line', count(*) FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY l_suppkey
        UNION ALL SELECT 'customer', o_custkey::VARCHAR, 'order', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey
        UNION ALL SELECT 'nation', c_nationkey::VARCHAR, 'customer', count(*) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation) GROUP BY c_nationkey
        UNION ALL SELECT 'nation', s_nationkey::VARCHAR, 'supplier', count(*) FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation) GROUP BY s_nationkey""",
    "operation_diff": "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_before, round(arg_max(value, (ts, event_id)), 6) AS last_after, count(*) AS n FROM events GROUP BY user_id",
}
SQL["scan_metrics"] = f"""SELECT count(*) FILTER (kind = 'created') AS n_created, count(*) FILTER (kind IN ('modified', 'restored')) AS n_modified, count(*) FILTER (kind = 'deleted') AS n_deleted,
    count(*) FILTER (kind = 'renamed') AS n_renamed FROM ({SQL["change_classify"]})"""
SQL["vector_probe_recall"] = "SELECT count(*) AS n_queries, count(*) * least(8, count(*) - 1) AS n_wanted, true AS recall_ok FROM embeddings"
SQL["vector_space_life"] = """SELECT space, state, active, version::INTEGER AS version, expected, expected AS covered FROM (VALUES ('first', 'deprecated', false, 4), ('second', 'ready', true, 3),
    ('holed', 'deleted', false, 3)) v(space, state, active, version), (SELECT count(*) AS expected FROM documents JOIN embeddings ON doc_id = vec_id)"""
SQL["embedding_backlog"] = """SELECT doc_id AS chunk_id, h AS content_hash FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) WHERE ('0x' || substr(h, 1, 8))::BIGINT % (
    SELECT ceil(n / ceil(n / 8))::BIGINT FROM (SELECT count(DISTINCT coalesce(text, ''))::DOUBLE AS n FROM documents)) >= 3"""
#: Lines, their leaves and the levels above, to the root.
TREE = """RECURSIVE l AS (SELECT doc_id || ':' || coalesce(sha256(text), '') AS line, count(*) AS n FROM documents GROUP BY 1),
    d AS (SELECT coalesce(min(k), 0) AS depth FROM range(0, 12) t(k) WHERE (SELECT count(*) FROM documents) <= 128 * 16::DOUBLE ** k),
    tree AS (SELECT depth AS level, substr(sha256(line), 1, depth) AS prefix, sha256(string_agg(line || '*' || n, chr(10) ORDER BY line)) AS digest, sum(n)::BIGINT AS n FROM l, d GROUP BY 1, 2
    UNION ALL SELECT level - 1, substr(prefix, 1, level - 1), sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix)), sum(n)::BIGINT FROM tree WHERE level > 0 GROUP BY level, substr(prefix, 1, level - 1))"""
SQL["digest_tree"] = f"WITH {TREE} SELECT level, prefix, digest, n FROM tree"
SQL["watermark_digest"] = f"WITH {TREE} SELECT digest AS watermark, n FROM tree WHERE level = 0"


def near(rows: str) -> str:
    """exact, start, length of ``quote`` in ``content`` of rows (id columns, quote, content), by letters and digits where it isn't there as it is."""
    keep = "lambda x: regexp_full_match(x, '[\\p{L}\\p{N}]')"
    return f"""SELECT * EXCLUDE (quote, content, chars, places, wanted, plain, spot), CASE WHEN spot > 0 THEN true WHEN hit > 0 THEN false END AS exact,
        CASE WHEN spot > 0 THEN spot WHEN hit > 0 THEN places[hit] END::INTEGER AS start, CASE WHEN spot > 0 THEN length(quote) WHEN hit > 0 THEN places[hit + length(wanted) - 1] - places[hit] + 1 END::INTEGER AS length
        FROM (SELECT *, CASE WHEN spot = 0 AND length(wanted) >= 4 THEN instr(plain, wanted) ELSE 0 END AS hit FROM (SELECT *, CASE WHEN length(quote) > 0 THEN instr(content, quote) ELSE 0 END AS spot,
        array_to_string(list_filter(string_split(lower(quote), ''), {keep}), '') AS wanted, array_to_string(list_filter(chars, {keep}), '') AS plain,
        list_filter(range(1, len(chars) + 1), lambda i: regexp_full_match(chars[i], '[\\p{{L}}\\p{{N}}]')) AS places FROM (SELECT *, string_split(lower(content), '') AS chars FROM ({rows}))))"""


SQL["grounding"] = f"""SELECT conv_id, turn, coalesce(exact, false) AS exact, start, length FROM ({near("SELECT * FROM (SELECT conv_id, turn, text AS quote, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS content FROM conversations) WHERE content IS NOT NULL")})"""
SQL["grounding_offsets"] = f"""SELECT doc_id, exact, start, length FROM ({near("SELECT doc_id, lower(array_to_string(string_split(text, ' ')[6:15], ' - ')) AS quote, text AS content FROM documents")})"""
SQL["event_pages"] = """SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // (SELECT ceil(count(*) / 7)::BIGINT FROM events) + 1 AS page, event_id, user_id FROM events"""
SQL["change_batch_keys"] = """WITH l AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS rank, sha256('{"at":' || epoch_us(ts) || ',"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}') AS h FROM events)
    SELECT (rank - 1) // 500 AS batch, sha256(concat((rank - 1) // 500, chr(10), string_agg(h, chr(10) ORDER BY rank))) AS key, count(*) AS n FROM l GROUP BY (rank - 1) // 500"""
SQL["entity_mentions"] = r"""WITH a AS (SELECT item_id AS entity_id, array_to_string(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')[1:3], ' ') AS alias FROM benchmark),
    t AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS said FROM documents)
    SELECT DISTINCT doc_id, entity_id, alias, instr(said, ' ' || alias || ' ')::BIGINT + 1 AS start FROM t JOIN a ON alias <> '' AND contains(said, ' ' || alias || ' ')"""
SQL["impact_closure"] = """WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (FROM n)), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)),
    o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)), l AS (SELECT l_orderkey, l_linenumber, min(CASE WHEN l_suppkey IN (FROM s) THEN 3 ELSE 4 END) AS depth FROM lineitem
    WHERE l_suppkey IN (FROM s) OR l_orderkey IN (FROM o) GROUP BY ALL), p AS (SELECT l_partkey, min(depth) + 1 AS depth FROM lineitem JOIN l USING (l_orderkey, l_linenumber) GROUP BY l_partkey),
    d AS (SELECT DISTINCT doc_id, depth + 1 AS depth FROM documents JOIN p ON doc_id = l_partkey), r AS (SELECT 'region' AS kind, 0 AS depth UNION ALL SELECT 'nation', 1 FROM n UNION ALL SELECT 'supplier', 2 FROM s UNION ALL
    SELECT 'customer', 2 FROM c UNION ALL SELECT 'order', 3 FROM o UNION ALL SELECT 'line', depth FROM l UNION ALL SELECT 'part', depth FROM p UNION ALL SELECT 'document', depth FROM d UNION ALL
    SELECT 'embedding', depth + 1 FROM (SELECT DISTINCT vec_id, depth FROM embeddings JOIN d ON vec_id = doc_id) UNION ALL SELECT 'label', depth + 1 FROM (SELECT DISTINCT doc_id, depth FROM labels JOIN d USING (doc_id)))
    SELECT kind, depth::BIGINT AS depth, count(*) AS n FROM r GROUP BY kind, depth"""
SQL["layered_union"] = """SELECT * FROM (SELECT 'structure' AS layer, 'contains' AS predicate, source AS subject, doc_id::VARCHAR AS object FROM documents UNION ALL SELECT 'language', 'speaks', doc_id::VARCHAR, lang FROM documents UNION ALL
    SELECT 'opening', 'opens_with', doc_id::VARCHAR, string_split(text, ' ')[1] FROM documents), (SELECT count(*) AS built FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 3)"""


def added_up(value: str) -> str:
    limbs = ", ".join(f"sum(('0x' || substr(sha256({value}), {1 + 15 * k}, 15))::BIGINT)" for k in range(4))
    return f"sha256(concat_ws('|', count(*), {limbs}))"


ITEMS = """named AS (SELECT c.*, p_name AS statement, CASE WHEN p_size < 10 THEN first END AS valid_from, CASE WHEN p_size < 10 THEN last END AS valid_to FROM classified c JOIN part ON p_partkey = claim_id
    JOIN (SELECT l_partkey, strftime(min(l_shipdate), '%Y-%m-%d') AS first, strftime(max(l_shipdate), '%Y-%m-%d') AS last FROM lineitem GROUP BY l_partkey) ON l_partkey = claim_id),
    cited AS (SELECT topic, claim_id, l_orderkey || '-' || l_linenumber AS chunk_id, l_suppkey AS source_id FROM named JOIN lineitem ON l_partkey = claim_id),
    asked AS (SELECT topic, 'high' AS severity, 'Claims contradict each other: what would show which of them holds?' AS question FROM report WHERE n_conflict > 0
        UNION ALL SELECT topic, 'medium', 'Some claims rest on one source: is there a second one?' FROM report WHERE n_single > 0),
    items AS (SELECT topic, 'hero' AS component, 'hero' AS kind, topic AS item_id, to_json({'health': health_status, 'confidence': confidence_level, 'claims': n_claims, 'rule': decisive_rule})::VARCHAR AS item FROM report
    UNION ALL SELECT topic, 'cards-' || conclusion_type, 'conclusion_cards', claim_id::VARCHAR, to_json({'claim': claim_id, 'statement': statement, 'confidence': confidence_level})::VARCHAR FROM named WHERE conclusion_type <> 'conflict'
    UNION ALL SELECT topic, 'evidence', 'evidence_blocks', chunk_id, to_json({'claim': claim_id, 'chunk': chunk_id, 'source': source_id})::VARCHAR FROM cited
    UNION ALL SELECT topic, 'timeline', 'timeline', claim_id::VARCHAR, to_json({'claim': claim_id, 'start': valid_from, 'end': valid_to})::VARCHAR FROM named WHERE valid_from IS NOT NULL
    UNION ALL SELECT topic, 'comparison', 'comparison_matrix', claim_id::VARCHAR, to_json({'claim': claim_id, 'category': conclusion_type, 'sources': lineages})::VARCHAR FROM named
        WHERE topic IN (SELECT topic FROM named GROUP BY topic HAVING count(*) > 1)
    UNION ALL SELECT DISTINCT topic, 'graph', 'knowledge_graph', claim_id || '-' || source_id, to_json({'source': claim_id, 'label': 'supplied_by', 'target': source_id})::VARCHAR FROM cited
    UNION ALL SELECT topic, 'conflicts', 'conflicts', claim_id::VARCHAR, to_json({'claim': claim_id, 'statement': statement, 'confidence': confidence_level})::VARCHAR FROM named WHERE conclusion_type = 'conflict'
    UNION ALL SELECT topic, 'gaps', 'knowledge_gaps', sha256(question), to_json({'severity': severity, 'question': question})::VARCHAR FROM asked
    UNION ALL SELECT topic, 'sources', 'source_directory', source_id::VARCHAR, to_json({'source': source_id, 'citations': count(*)})::VARCHAR FROM cited GROUP BY topic, source_id)"""
SQL["topic_pages"] = f"""WITH {claims()}, {REPORT}, {SECTIONS}, {ITEMS}, made AS (SELECT topic, component, kind, count(*) AS n_items, {added_up("item_id || chr(10) || item")} AS content_hash,
    {added_up("item_id")} AS dependency_hash FROM items GROUP BY topic, component, kind)
    SELECT made.*, s.confidence_level, s.health_status FROM made LEFT JOIN sections s ON s.topic = made.topic AND component = CASE section WHEN 'conflict' THEN 'conflicts' ELSE 'cards-' || section END"""
SQL["retrieval_items"] = f"""WITH {FTS}, {NEAR}, routes AS (SELECT 'fts' AS route, doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 80
    UNION ALL SELECT 'vector', vec_id, row_number() OVER (ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM near QUALIFY rank <= 80),
    best AS (SELECT doc_id FROM routes GROUP BY doc_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, doc_id LIMIT 20)
    SELECT route, doc_id, rank, doc_id IN (FROM best) AS selected FROM routes"""
SQL["topic_history"] = f"""WITH a AS (WITH {claims(EARLY)}, {REPORT} SELECT topic, concat_ws('|', n_claims, n_consensus, n_conflict, n_single, health_status, confidence_level) AS d FROM report),
    b AS (WITH {claims()}, {REPORT} SELECT topic, concat_ws('|', n_claims, n_consensus, n_conflict, n_single, health_status, confidence_level) AS d FROM report)
    SELECT 1::BIGINT AS version, topic, 'added' AS change FROM a UNION ALL SELECT 2, coalesce(a.topic, b.topic), CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' WHEN a.d = b.d THEN 'unchanged' ELSE 'modified' END
    FROM a FULL JOIN b ON a.topic = b.topic"""
SQL["entity_merges"] = "SELECT DISTINCT s_suppkey - s_suppkey % 4 AS entity_id, s_name AS alias FROM supplier"
SQL["moderated_relations"] = """SELECT relation_id, CASE last WHEN 'purchase' THEN 'user_confirmed' WHEN 'click' THEN 'rejected' ELSE 'active' END AS status FROM (SELECT DISTINCT o_custkey AS relation_id FROM orders)
    LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id) ON user_id = relation_id"""
SQL["deep_verify"] = """SELECT 'vector_missing' AS check, doc_id::VARCHAR AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL
    SELECT 'vector_orphan', vec_id::VARCHAR FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL
    SELECT 'sequence', conv_id::VARCHAR FROM conversations GROUP BY conv_id HAVING count(*) <> count(DISTINCT turn) OR min(turn) <> 1 OR max(turn) <> count(*) UNION ALL
    SELECT 'cross_document', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 50 = 0 UNION ALL
    SELECT 'unsupported_statement', doc_id::VARCHAR FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IN (SELECT vec_id FROM embeddings))"""
SQL["search_hybrid"] = f"""WITH {FTS}, {NEAR}, routes AS (SELECT doc_id, 'fts' AS route, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 80
    UNION ALL SELECT vec_id, 'vector', row_number() OVER (ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM near WHERE vec_id IN (SELECT doc_id FROM documents) QUALIFY rank <= 80),
    fused AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, '[' || string_agg(route, ', ' ORDER BY route) || ']' AS routes FROM routes GROUP BY doc_id),
    boosted AS (SELECT doc_id, score + CASE WHEN contains(lower({FIRST_LINE}), 'licensed apache') THEN 0.01 ELSE 0 END AS score, routes FROM fused JOIN documents USING (doc_id))
    SELECT doc_id, round(score, 9) AS score, routes FROM boosted ORDER BY round(score, 9) DESC, doc_id LIMIT 20"""
