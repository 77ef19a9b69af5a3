import hashlib
import re
import tracemalloc
import unicodedata

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import scoring
from siltstone.functions import text as tx
from siltstone.functions import vectors as vx
from siltstone.operators.chunking import chunk, chunk_blocks, estimate, line_documents, split_text
from siltstone.sources.files import read_pages
from siltstone.sources.parsers import normalize_text, parse, parse_one


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def test_token_estimate_counts_cjk_and_quarters(spark):
    texts = ["", "abcd", "abcde", "中文 ab", "ひらがな", "한국 x y"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], ["t"]).select(tx.token_estimate("t").alias("n")).collect()]
    assert got == [0, 1, 2, 3, 4, 3] == [estimate(t) for t in texts]


def test_language(spark):
    got = [r.x for r in spark.createDataFrame([("abc",), ("中文",), ("123",), ("abcdef 中",)], ["t"]).select(tx.detect_language("t").alias("x")).collect()]
    assert got == ["en", "zh", "und", "en"]


def test_normalize_text_is_the_parsers(spark):
    texts = ["a \r\nb\t\n\n\n\nc ", "é", " \n x", ""]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], ["t"]).select(tx.normalize_text("t").alias("x")).collect()]
    assert got == [normalize_text(t) for t in texts]


def test_normal_form_is_asked_of_few_texts(spark):
    inert = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), tx.MAY_COMPOSE))
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    canonical = (unicodedata.decomposition(c).split() for c in every)
    seconds = {chr(int(d[1], 16)) for d in canonical if len(d) == 2 and d[0][0] != "<"} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    assert not [c for c in every if not inert.search(c) and (unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c or c in seconds)]
    texts = ["Stra\u00dfe \u4e2d\u6587\u3001\u304c \ud55c", "e\u0301", "\u304b\u3099", "\u1112\u1161\u11ab", "\uac00\u11a8", "\u2126", "\U0001f600", "q\u0307\u0323", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i")
    assert [r.x for r in rows.select(tx.normalize_text("t").alias("x")).collect()] == [t and normalize_text(t) for t in texts]
    asked = rows.select(F.col("t").rlike(tx.MAY_COMPOSE).alias("x")).collect()
    assert [r.x for r in asked] == [False, True, True, True, True, True, False, True, None]


def test_normal_form_holds_few_texts_at_a_time():
    texts = pa.array(["e\u0301" * 2000] * 8000)
    tracemalloc.start()
    done = tx.nfc.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done[7999].as_py() == "\u00e9" * 2000
    assert peak < 8_000_000  # all at once are 64 MB


def in_arrow(monkeypatch, rows, made):
    """The batches that ``made`` gives in a task, from all ``rows`` in one batch."""
    kept = {}
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: kept.update(rows=self, f=f))
    made(rows)
    return kept["f"](kept["rows"].toArrow().combine_chunks().to_batches())


def test_chunks_leave_a_task_in_small_batches(spark, monkeypatch):
    texts = spark.createDataFrame([(i, None if i == 7 else f"line {i}\n\n" + "word " * 2000) for i in range(300)], "doc_id long, text string")
    batches = list(in_arrow(monkeypatch, texts, lambda t: chunk(line_documents(t, "doc_id"), key="doc_id", key_type="long")))
    assert len(batches) == 3 and max(b.nbytes for b in batches) < 2_000_000
    assert {r["doc_id"] for b in batches for r in b.to_pylist()} == set(range(300)) - {7}
    assert [r["content_text"] for r in batches[0].to_pylist() if r["doc_id"] == 3][0].startswith("line 3")


def test_documents_leave_a_task_in_small_batches(spark, monkeypatch):
    pages = spark.createDataFrame([(f"x://h/{i}", f"<title>t{i}</title><p>" + "word " * 2000) for i in range(300)], "url string, html string")
    batches = list(in_arrow(monkeypatch, pages, lambda p: parse(read_pages(p))))
    assert len(batches) == 3 and [r["title"] for b in batches for r in b.to_pylist()] == [f"t{i}" for i in range(300)]


def test_upper_case_is_that_of_sql(spark):
    texts = ["Straße ŉ\nﬁn ᾳ ᾼ ÿé", "ß", "plain", "", None, *(chr(i) for i in range(1, 0x1E000) if not 0xD800 <= i < 0xE000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = [r.x for r in rows.orderBy("i").select(tx.upper_each("t").alias("x")).collect()]
    sql = duckdb.connect()
    sql.register("rows", rows.orderBy("i").toArrow())
    assert got == [x for (x,) in sql.execute("SELECT upper(t) FROM rows ORDER BY i").fetchall()]


def test_jaccard(spark):
    pairs = [("a b c", "b c d"), ("", ""), ("a", ""), ("A-b", "a B")]
    rows = spark.createDataFrame(pairs, ["a", "b"]).select(tx.jaccard(tx.tokens("a"), tx.tokens("b")).alias("x")).collect()
    assert [round(r.x, 4) for r in rows] == [0.5, 1.0, 0.0, 1.0]


@pytest.mark.parametrize(
    ("glob", "path", "fits"),
    [("**/*.md", "a/b/c.md", True), ("**/*.md", "c.md", True), ("*.md", "a/c.md", False), ("a/?.txt", "a/b.txt", True), ("**/.git/**", "x/.git/y", True), ("a.b", "axb", False)],
)
def test_globs(glob, path, fits):
    assert bool(re.search(tx.glob_pattern(glob), path)) is fits


def test_hidden_sensitive_secret(spark):
    paths = spark.createDataFrame([("a/.x/b",), ("a/.env.local",), ("k.PEM",), ("a/b",)], ["p"])
    got = [(r.h, r.s) for r in paths.select(tx.is_hidden("p").alias("h"), tx.is_sensitive("p").alias("s")).collect()]
    assert got == [(True, False), (True, True), (False, True), (False, False)]
    assert one(spark, tx.has_secret("t"), t="api_key = 'abcdefghijklmnop'") and not one(spark, tx.has_secret("t"), t="the key of the matter")


def test_decode_path_keeps_plus_and_bad_escapes(spark):
    got = [r.x for r in spark.createDataFrame([("a%20b",), ("a+b",), ("%zz",)], ["p"]).select(tx.decode_path("p").alias("x")).collect()]
    assert got == ["a b", "a+b", "%zz"]


def test_excerpt(spark):
    text = "x" * 200 + "needle" + "y" * 500
    got = one(spark, tx.excerpt("t", "needle"), t=text)
    assert got.startswith("…") and got.endswith("…") and len(got) == 322 and "needle" in got


def test_confidence(spark):
    def level(directness, sources, disputed, verified):
        c = scoring.confidence(F.lit(directness), F.lit(sources), F.lit(disputed), F.lit(verified))
        return spark.range(1).select(c.alias("c")).first().c

    alone, many = level("inferred", 1, False, "none"), level("direct", 4, False, "confirmed")
    assert many.score > alone.score and many.level == "high" and level("direct", 9, True, "confirmed").level == "disputed"
    assert alone.score == round(0.6 * 0.16 + 0.4 * 0.18 + 0.35 * 0.18 + 0.6 * 0.1 + 0.85 * 0.14 + 0.16 + 0.5 * 0.08, 4)
    assert alone.reasons == ["sources: 1", "closeness: inferred", "contradicted: no", "checked by a person: no"]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],)], "v array<float>")
    got = rows.select(vx.norm("v").alias("n"), vx.normalized("v", 2).alias("u"), vx.cosine(F.col("v"), [1.0, 0.0]).alias("c")).first()
    assert got.n == 5 and [round(x, 6) for x in got.u] == [0.6, 0.8] and round(got.c, 6) == 0.6
    with pytest.raises(Exception, match="invalid vector"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(vx.normalized("v", 2)).collect()


def block(text, kind="paragraph", path=(), line=1):
    return {"kind": kind, "text": text, "heading_path": list(path), "source_start_line": line, "source_end_line": line, "metadata": {}}


def test_chunks_stay_in_budget_and_differ_in_anchor():
    blocks = [block("Alpha beta gamma. " * 6, path=["H"]), block("中文字符测试。继续写一点内容。", "list"), block("tail words here", line=9)]
    made = chunk_blocks(blocks, 12, 2)
    assert len(made) > 1 and all(c["token_estimate"] <= 12 for c in made) and len({c["anchor_key"] for c in made}) == len(made)
    assert made == chunk_blocks(blocks, 12, 2)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n中。", max_size=80), st.integers(1, 9))
def test_split_keeps_all_but_white_space(text, budget):
    pieces = split_text(text, budget)
    squeeze = lambda x: re.sub(r"\s", "", x)
    assert squeeze("".join(pieces)) == squeeze(text)
    assert all(estimate(p) <= budget for p in pieces)


def test_chunks_overlap():
    blocks = [block(f"word{i:04d}" * 2, line=i) for i in range(8)]
    made = chunk_blocks(blocks, 12, 4)
    assert made[1]["content_text"].split("\n\n")[0] == made[0]["content_text"].split("\n\n")[-1]


def test_markdown():
    text = "---\ntags: [b, a]\nowner: me\n---\n# Title\nsee [x](y.md) and [[w|l]] #tag\n\n- i\n```py\ncode | x\n```\n## Sub\n> q\n~~~\nopen"
    d = parse_one("a/guide.md", "text/markdown", "markdown", text.encode())
    assert (d["title"], d["tags"], d["frontmatter"]["owner"]) == ("Title", ["a", "b", "tag"], "me")
    assert [(b["kind"], b["heading_path"]) for b in d["blocks"]] == [
        ("heading", ["Title"]), ("table", ["Title"]), ("list", ["Title"]), ("code", ["Title"]), ("heading", ["Title", "Sub"]), ("quote", ["Title", "Sub"]), ("code", ["Title", "Sub"]),
    ]
    assert d["blocks"][3]["metadata"]["language"] == "py" and d["blocks"][6]["metadata"]["unterminated"] == "true"
    assert [(x["kind"], x["target"], x["source_line"]) for x in d["links"]] == [("markdown", "y.md", 6), ("wiki", "w", 6)]


def test_html():
    page = b"<title>T &amp; U</title><h1>H</h1><p>a &#X41;<br>b</p><script>bad()</script><ul><li>one</li></ul><p><a href='/x?a=1&amp;b=2'>go <b>on</b></a></p>"
    d = parse_one("p.html", "text/html", "html", page)
    assert d["title"] == "T & U" and "bad" not in d["text"] and "a A" in d["text"]
    assert d["links"][0]["target"] == "/x?a=1&b=2" and d["links"][0]["label"] == "go  on"
    assert ("list", "- one go on") in [(b["kind"], b["text"]) for b in d["blocks"]]


def test_jsonl_and_bad_input():
    assert parse_one("e.jsonl", "application/x-ndjson", "jsonl", b'{"z":1,"a":{"d":1,"c":2}}')["text"] == '{"a":{"c":2,"d":1},"z":1}'
    assert parse_one("e.jsonl", "application/x-ndjson", "jsonl", b'{"z":1}\n{')["error"]
    assert parse_one("e.txt", "text/plain", "plain-text", b"\xff\xfe")["error"] == "UnicodeDecodeError"
    assert parse_one("e.png", "image/png", None, b"")["error"] == "skipped"


def test_plain_text():
    d = parse_one("n.txt", "text/plain", "plain-text", b"\xef\xbb\xbffirst line\nmore\n\n\nsecond")
    assert d["title"] == "first line" and [(b["source_start_line"], b["source_end_line"]) for b in d["blocks"]] == [(1, 2), (5, 5)]


def test_fixture_embeddings_hash_a_feature_once(spark):
    def plain(text):
        x = unicodedata.normalize("NFKC", text or "").lower()
        out = [0.0] * 16
        for f in set(x.split()) | {x[i : i + n] for n in (2, 3) for i in range(len(x) - n + 1)}:
            d = hashlib.sha256(f"s\n{f}".encode()).digest()
            out[(d[0] << 8 | d[1]) % 16] += 1 if d[2] % 2 == 0 else -1
        return out

    texts = ["Größe und ＡＢ ab", "a", "", None, "the same the same"] * 2
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(vx.fixture_embedding(16, "s")("t").alias("v")).collect()
    assert [r.v for r in rows] == [plain(t) for t in texts]
    slots = vx.Slots("s", 16)
    assert len({slots["ab"] for _ in range(5)}) == slots.made == 1
