"""Digest trees, cursors, mentions, layered builds, impact and plans, batches handed over once, quotes mapped back."""

import hashlib
import json
import unicodedata
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import impact, mentions, pages, paging, retrieval
from siltstone.operators.layers import LayeredGraph
from siltstone.plans import catalog
from siltstone.sources import digests
from siltstone.streaming import events as ev


def versions(spark, n, changed=()):
    return spark.createDataFrame([(i, f"{'new' if i in changed else 'v'}{i}") for i in range(n)], "key long, version string")


def test_tree_grows_and_finds_differences(spark):
    assert [digests.depth_for(n) for n in (0, 128, 129, 2048, 2049, 32769)] == [0, 0, 1, 1, 2, 3]
    a, b = versions(spark, 3000), versions(spark, 3000, {5, 777}).where("key <> 9")
    nodes = digests.digest_tree(a, "key", "version")
    assert nodes.agg(F.max("level")).first()[0] == 2 and nodes.where("level = 2").agg(F.max("n")).first()[0] < 4 * digests.LEAF
    assert {r.level: r.s for r in nodes.groupBy("level").agg(F.sum("n").alias("s")).collect()} == {0: 3000, 1: 3000, 2: 3000}
    found, opened = digests.differences(a, b, "key", "version")
    assert sorted(map(tuple, found.collect())) == [("5:new5", 0, 1), ("5:v5", 1, 0), ("777:new777", 0, 1), ("777:v777", 1, 0), ("9:v9", 1, 0)]
    assert opened <= 5
    same, opened = digests.differences(a, a.repartition(3), "key", "version")
    assert same.count() == opened == 0


def test_equal_lines_count_and_empty_tables(spark):
    twice = versions(spark, 3).unionByName(versions(spark, 3))
    assert digests.differences(versions(spark, 3), twice, "key", "version")[0].count() == 3
    empty = digests.root(versions(spark, 0), "key", "version").first()
    assert empty.n == 0 and empty.watermark == hashlib.sha256(b"").hexdigest()
    hot = spark.createDataFrame([(None, "x")] * 5000, "key long, version string")
    assert digests.digest_tree(hot, "key", "version", leaf=100).where("level = 0").first().n == 5000


# -- pages ----------------------------------------------------------------------


@pytest.mark.parametrize("descending", [False, True])
def test_pages_join_to_the_table(spark, descending):
    rows = spark.createDataFrame([(None if i % 11 == 0 else i % 5, i, f"r{i}") for i in range(100)], "a int, b int, c string")
    for size in (1, 7, 100, 101):
        if size == 1:
            rows_ = rows.where("b < 6")
        else:
            rows_ = rows
        got = [r.b for p in paging.pages(rows_, ["a", "b"], size, descending) for r in p.collect()]
        key = lambda r: (r.a is not None, r.a or 0, r.b)
        assert got == [r.b for r in sorted(rows_.collect(), key=key, reverse=descending)]


def test_long_pages_are_not_sorted_by_one_task(spark, monkeypatch):
    monkeypatch.setattr(paging, "ONE_TASK", 3)
    rows = spark.createDataFrame([(i % 5 or None, i) for i in range(23)], "a long, b long").repartition(3)
    for descending in (False, True):
        want = sorted([(i % 5 or -1, i) for i in range(23)], reverse=descending)
        found = list(paging.pages(rows, ["a", "b"], 4, descending))
        assert [sorted(r.b for r in p.collect()) for p in found] == [sorted(b for _, b in want[k : k + 4]) for k in range(0, 23, 4)]
        assert "Limit" not in found[1]._jdf.queryExecution().executedPlan().toString()
    first, cursor = paging.page(rows, ["a", "b"], 12)
    second, _ = paging.page(rows, ["a", "b"], 12, cursor)
    assert [p.count() for p in (first, second)] == [12, 11]
    none, cursor = paging.page(rows.where("false"), ["a", "b"], 5)
    assert none.count() == 0 and cursor is None


def test_new_rows_are_neither_lost_nor_repeated(spark):
    ts = lambda i: datetime(2024, 1, 1) + timedelta(seconds=i)
    rows = spark.createDataFrame([(ts(i), i) for i in range(10)], "ts timestamp, id long")
    first, cursor = paging.page(rows, ["ts", "id"], 4)
    more = rows.unionByName(spark.createDataFrame([(ts(20), 10), (ts(21), 11)], rows.schema))
    rest = [r.id for p in iter_from(more, cursor) for r in p.collect()]
    assert [r.id for r in first.collect()] + rest == list(range(12))
    new, cursor = paging.follow(rows, ["ts", "id"], None)
    assert new.count() == 10
    new, after = paging.follow(rows, ["ts", "id"], cursor)
    assert new.count() == 0 and after == cursor
    new, _ = paging.follow(more, ["ts", "id"], cursor)
    assert sorted(r.id for r in new.collect()) == [10, 11]
    plan = paging.page(more, ["ts", "id"], 4, cursor)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan
    for bad in ("nonsense", paging.cursor_of({"id": 1}, ["id"], {"id": "bigint"})):
        with pytest.raises(ValueError):
            paging.page(rows, ["ts", "id"], 4, bad)
    with pytest.raises(ValueError):
        paging.page(rows, ["ts"], 0)


def iter_from(rows, cursor):
    while True:
        found, after = paging.page(rows, ["ts", "id"], 5, cursor)
        if after == cursor:
            return
        yield found
        cursor = after


def test_topic_pages_works_claims_out_once(spark):
    plan = catalog.topic_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 3  # evidence, its sources and the graph; claims are written once


def test_page_digest_is_exact(spark):
    ids = [f"i{i}" for i in range(3000)] + ["i1", None]
    found = spark.createDataFrame([("t", "a", "k", i, "x") for i in ids], "topic string, component string, kind string, item_id string, item string")
    r = pages.components(found, "topic").first()
    digest = lambda of: hashlib.sha256("|".join([str(len(ids)), *(str(sum(int(hashlib.sha256(v.encode()).hexdigest()[15 * k : 15 * k + 15], 16) for v in of)) for k in range(4))]).encode()).hexdigest()
    assert r.n_items == len(ids) and r.dependency_hash == digest([i for i in ids if i]) and r.content_hash == digest([f"{i}\nx" if i else "x" for i in ids])


def test_closure_drops_what_is_known_only_of_kinds_met_before(spark, monkeypatch):
    plans, write = [], impact.written
    monkeypatch.setattr(impact, "written", lambda rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(rows))
    ab = spark.createDataFrame([(1, 10), (2, 20), (7, 70), (1, 10), (None, 30), (2, None)], "a long, b int")
    bb = spark.createDataFrame([("10", "11"), ("11", "10"), ("010", "12")], "a string, b string")
    start = spark.createDataFrame([("a", "1"), ("a", "07"), ("a", "x"), ("a", None)], "kind string, id string")
    got = {tuple(r) for r in impact.closure(start, [("a", "b", ab, "a", "b"), ("b", "b", bb, "a", "b")]).collect()}
    assert got == {("a", "1", 0), ("a", "07", 0), ("a", "x", 0), ("b", "10", 1), ("b", "11", 2)}
    assert ["LeftAnti" in p for p in plans] == [False, False, True, True] and "a#" in plans[1]


def test_page_components(spark):
    claims = spark.createDataFrame(
        [("t", 1, "one", "consensus", "high", 2, "2024", None), ("t", 2, "t<w>o", "conflict", "disputed", 1, None, None), ("u", 3, "three", "single_source", "low", 1, None, None), (None, 4, "four", "inference", "low", 1, None, None)],
        "topic string, claim_id long, statement string, conclusion_type string, confidence_level string, independent_source_count long, valid_from string, valid_to string",
    )
    reports = spark.createDataFrame([("t", "needs_review", "disputed", 2, "rule"), ("u", "degraded", "low", 1, "rule"), ("v", "insufficient", "unknown", 0, "none")], "topic string, health_status string, confidence_level string, n_claims long, decisive_rule string")
    evidence = spark.createDataFrame([(1, "c1", "s1"), (1, "c2", "s2"), (2, "c1", "s1"), (9, "c9", "s9")], "claim_id long, chunk_id string, source_id string")
    relations = spark.createDataFrame([("t", "r1", "a", "p", "b")], "topic string, relation_id string, subject string, predicate string, object string")
    gaps = spark.createDataFrame([("v", "high", "what?")], "topic string, severity string, question string")
    found = pages.items("topic", reports, claims, evidence, relations, gaps)
    parts = pages.rated(pages.components(found, "topic"), claims, "topic")
    got = {(r.topic, r.component): (r.n_items, r.confidence_level, r.health_status) for r in parts.collect()}
    assert got == {
        ("t", "hero"): (1, None, None), ("t", "cards-consensus"): (1, "high", "healthy"), ("t", "evidence"): (3, None, None), ("t", "timeline"): (1, None, None), ("t", "comparison"): (2, None, None), ("t", "graph"): (1, None, None),
        ("t", "conflicts"): (1, "disputed", "needs_review"), ("t", "sources"): (2, None, None), ("u", "hero"): (1, None, None), ("u", "cards-single_source"): (1, "low", "degraded"), ("v", "hero"): (1, None, None), ("v", "gaps"): (1, None, None),
        (None, "cards-inference"): (1, None, None),
    }
    assert pages.invalid(found, parts, "topic").where("topic is not null").count() == 0
    assert [r.component for r in pages.invalid(found.where("item_id <> 'c2'"), parts, "topic").where("topic is not null").collect()] == ["evidence"]
    hashes = lambda f: {(r.topic, r.component): r.content_hash for r in pages.components(f, "topic").collect()}
    assert hashes(found) == hashes(found.repartition(5)) and hashes(found.unionByName(found))["t", "hero"] != hashes(found)["t", "hero"]
    shown = json.loads(pages.page(parts, "topic").where("topic = 'v'").first().page)
    assert [c["kind"] for c in shown["components"]] == ["knowledge_gaps", "hero"] or len(shown["components"]) == 2
    lines = [r.value for r in pages.html(found, "topic").where("topic = 't'").orderBy("no").collect()]
    assert lines[0].startswith("<!doctype html>") and lines[-1].endswith("</html>") and len(lines) == 2 + 12 and "t&lt;w&gt;o" in "".join(lines) and "<w>" not in "".join(lines)


# -- mentions -------------------------------------------------------------------


def test_mentions_in_one_and_in_many_parts(spark):
    aliases = spark.createDataFrame([(1, "New  York"), (2, "new york city"), (3, "York"), (4, "Straße"), (5, None), (6, "--"), (7, "york"), (1, "new york")], "entity_id long, alias string")
    texts = spark.createDataFrame([(1, "In New York, new-york City. Yorkshire!"), (2, None), (3, ""), (4, "STRASSE straße")], "doc_id long, body string")
    want = [(1, 1, "new york", 5, 2), (1, 2, "new york city", 14, 1), (1, 3, "york", 9, 2), (1, 7, "york", 9, 2), (4, 4, "straße", 10, 1)]
    for most in (1 << 20, 40):
        assert sorted(map(tuple, mentions.mentions(texts, aliases, "doc_id", "body", most).collect())) == want
    assert mentions.mentions(texts, aliases.limit(0), "doc_id", "body").count() == 0


def test_candidates_and_merges(spark):
    aliases = spark.createDataFrame([("a", "York"), ("b", "york"), ("c", "Leeds")], "entity_id string, alias string")
    refs = spark.createDataFrame([(1, "YORK"), (2, "leeds "), (3, "Hull"), (4, None)], "reference_id long, target string")
    got = {r.reference_id: (r.state, r.candidates) for r in mentions.candidates(refs, aliases).collect()}
    assert got == {1: ("ambiguous", ["a", "b"]), 2: ("resolved", ["c"]), 3: ("unresolved", []), 4: ("unresolved", [])}
    merged = mentions.merge_aliases(aliases, spark.createDataFrame([("b", "c")], "from_id string, into_id string"))
    assert sorted(map(tuple, merged.collect())) == [("a", "York"), ("b", "york"), ("c", "Leeds"), ("c", "york")]


# -- layers ---------------------------------------------------------------------


def test_a_rebuild_writes_only_what_changed(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    edges = lambda kind: lambda docs: docs.select("doc_id", F.lit(kind).alias("predicate"), F.explode(F.split("text", " ")).alias("object"))
    held = LayeredGraph(spark, f"file://{tmp_path}/graph", "doc_id", {"words": edges("has"), "more": edges("also")})
    docs = lambda rows: spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, version string")
    texts = {i: f"a{i} b{i}" for i in range(20)}
    assert held.build(docs(texts.items())) == {"words": 20, "more": 20}
    files = lambda: sorted(p for p in (tmp_path / "graph").rglob("part-*") if "generations" not in str(p))
    before = files()
    assert held.build(docs(texts.items())) == {"words": 0, "more": 0} and files() == before
    texts[3] = "c3 d3 e3"
    del texts[4]
    assert held.build(docs(texts.items()), only=["words"]) == {"words": 1}
    assert not any("layer=more" in str(p) for p in set(files()) - set(before))
    assert held.build(docs(texts.items())) == {"words": 0, "more": 1}
    texts[4] = "back again"
    held.build(docs(texts.items()))
    want = sorted((i, w) for i, t in texts.items() for w in t.split())
    for _ in range(2):
        for layer in ("words", "more"):
            assert sorted((r.doc_id, r.object) for r in held.rows(layer).collect()) == want
        held.compact("words")
    assert len(held.state()["words"][1]) == 1 < len(held.state()["more"][1])
    state = held.state()
    texts[5] = "bad"
    with pytest.raises(ValueError):
        held.build(docs(texts.items()), check=lambda rows: rows.where("object = 'bad'"))
    assert held.state() == state and seen.value == 0


# -- impact and plans -----------------------------------------------------------


def test_closure_and_stale_plans(spark, tmp_path):
    table = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    links = [("s", "d", table([(1, 10), (1, 11), (2, 12), (None, 13)]), "a", "b"), ("d", "c", table([(10, 100), (11, 100), (12, 101), (11, None)]), "a", "b"), ("c", "d", table([(100, 12), (101, 10)]), "a", "b")]
    reached = impact.closure(spark.createDataFrame([("s", "1"), ("s", None)], "kind string, id string"), links)
    assert sorted(map(tuple, reached.collect())) == [("c", "100", 2), ("c", "101", 4), ("d", "10", 1), ("d", "11", 1), ("d", "12", 3), ("s", "1", 0)]
    now = [datetime(2024, 1, 1, tzinfo=UTC)]
    plans = impact.Plans(spark, f"file://{tmp_path}/plans", lambda: now[0])
    docs = spark.createDataFrame([(10, "x"), (11, "y"), (12, None)], "id long, state string")
    changes = impact.with_state(reached, {"d": (docs, "id")})
    assert changes.count() == 3
    done = []
    fresh, stale, late = (plans.create("delete", changes) for _ in range(3))
    other = impact.with_state(reached, {"d": (docs.withColumn("state", F.lit("z")), "id")})
    with pytest.raises(ValueError, match="stale"):
        plans.apply(stale, other, lambda rows: done.append(rows.count()))
    plans.apply(fresh, changes.repartition(7), lambda rows: done.append(rows.count()))
    with pytest.raises(ValueError, match="applied"):
        plans.apply(fresh, changes, done.append)
    now[0] += timedelta(minutes=16)
    with pytest.raises(ValueError, match="expired"):
        plans.apply(late, changes, done.append)
    with pytest.raises(LookupError):
        plans.apply("none", changes, done.append)
    assert done == [3] and {r.plan_id: r.state for r in plans.listed().collect()} == {fresh: "applied", stale: "expired", late: "expired"}


# -- batches --------------------------------------------------------------------


def test_batches_are_the_same_on_any_partitions(spark):
    rows = spark.createDataFrame([(i % 7, f"p{i}") for i in range(1234)] + [(3, "same")] * 5, "at int, path string")
    keys = []
    for n in (3, 30):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found = ev.change_batches(rows.repartition(n), ["at"], 100)
        keys.append(sorted(map(tuple, found.groupBy("batch", "key").count().collect())))
        assert found.select(*rows.columns).exceptAll(rows).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert keys[0] == keys[1] and [k[2] for k in keys[0]] == [100] * 12 + [39]


def test_a_batch_is_handed_over_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(250)], "at int, path string")
    receipts = ev.Receipts(spark, f"file://{tmp_path}/out")
    batches = ev.change_batches(rows, ["at"], 100)
    assert receipts.hand_over(batches.where("batch < 2")).count() == 2
    (tmp_path / "out/batches/key=crashed").mkdir()
    assert receipts.hand_over(batches).count() == 1
    assert receipts.hand_over(batches).count() == 0
    assert receipts.delivered().count() == 250


# -- quotes ---------------------------------------------------------------------


@pytest.mark.parametrize(
    ("quote", "content", "want"),
    [
        ("b c", "a b c", (3, 3, True)),
        ("Hello, World", "say «hello — WORLD»!", (6, 13, False)),
        ("ﬁnal cut", "The FINAL-CUT.", (5, 9, False)),
        ("final", "a ﬁnal b", (3, 4, False)),
        ("abc", "A-B-C", None),
        ("gone", "nothing", None),
        ("", "text", None),
        (None, "text", None),
        ("quote", None, None),
        ("ＡＢＣＤ", "x abcd", (3, 4, False)),
    ],
)
def test_quotes_are_mapped_back(spark, quote, content, want):
    row = spark.createDataFrame([(quote, content)], "q string, c string").select(retrieval.locate(F.col("q"), F.col("c")).alias("at")).first().at
    assert (row and tuple(row)) == want
    if want and not want[2]:
        cut = content[want[0] - 1 : want[0] - 1 + want[1]]
        plain = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t).lower() if c.isalnum())
        assert plain(cut) == plain(quote)
