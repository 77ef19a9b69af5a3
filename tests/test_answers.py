"""Answers without a model, conflict resolution, snapshot reuse and run stages on small rows."""

import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltstone.operators import answers, fulltext, graph, maintenance, retrieval, topics, versioning
from siltstone.sources.generations import GenerationStore

ITEM = "q long, position int, evidence_key string, content string, claim_status string, role string"


def test_answers(spark):
    items = spark.createDataFrame(
        [
            (1, 2, "E2", "second", "proposed", "seed"), (1, 1, "E1", "# head\n\n body \nmore", "proposed", "seed"),
            (2, 1, "E1", "text\n@claim a|b|c|It holds.|x", "disputed", "seed"), (2, 2, "E2", "other", "proposed", "seed"), (2, 3, "E3", "third", "proposed", "seed"),
            (3, 1, "E1", "against", None, "graph_contradict"), (4, 1, "E1", None, None, None), (4, 1, "E1", None, None, None),
        ],
        ITEM,
    )
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5)], "q long")
    got = {r.q: (r.result_kind, r.evidence_keys, r.statements) for r in answers.deterministic_answers(asked, items, "q").collect()}
    assert got == {
        1: ("answered", ["E1"], ["body"]), 2: ("conflicted", ["E1", "E2"], ["It holds.", "other"]), 3: ("conflicted", ["E1"], ["against"]),
        4: ("answered", ["E1"], [""]), 5: ("insufficient_evidence", [], []),
    }
    assert answers.deterministic_answers(asked.limit(0), items, "q").count() == 0
    assert {r.result_kind for r in answers.deterministic_answers(asked, items.limit(0), "q").collect()} == {"insufficient_evidence"}


def test_excerpt_is_cut(spark):
    row = spark.createDataFrame([("x" * 5000,)], "c string").select(F.length(answers.excerpt_of(F.col("c"))).alias("n")).first()
    assert row.n == answers.EXCERPT


def test_implicit_conflicts(spark):
    sets = spark.createDataFrame([(1, "proposed"), (2, "confirmed"), (3, "rejected"), (4, "proposed")], "conflict_id long, status string")
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 12)], "conflict_id long, claim_id long")
    claims = spark.createDataFrame([(10, " "), (11, "2020"), (12, None)], "claim_id long, conflict_scope string")
    got = {r.conflict_id: r.status for r in graph.resolve_implicit(sets, members, claims).collect()}
    assert got == {1: "proposed", 2: "resolved", 3: "rejected", 4: "resolved"}


def test_snapshot_reuse(spark):
    rows = lambda x: spark.createDataFrame(x, "source string, logical_path string, blob_sha256 string")
    before = rows([("a", "p", "1"), ("a", "q", None), ("b", "p", "1"), ("gone", "p", "1")])
    now = rows([("a", "p", "1"), ("a", "q", None), ("b", "p", "2"), ("new", "p", "1")])
    got = {r.source: (r.reused, r.n_changed) for r in versioning.reuse_snapshots(before, now, "source").collect()}
    assert got == {"a": (True, 0), "b": (False, 1), "new": (False, 1)}


def test_stages(spark):
    rows = spark.createDataFrame([(1, 1, "parsing"), (1, 2, "ready"), (1, 3, "chunked"), (2, 1, "parsing")], "run long, at int, state string")
    got = {(r.run, r.at): r.error for r in versioning.mark_stages(rows, "run", ["at"]).collect()}
    assert got == {(1, 1): None, (1, 2): None, (1, 3): "ingestion_state_invalid", (2, 1): None}


def test_listings(spark):
    chunks = spark.createDataFrame([("d", 0, "x"), ("d", 1, "y")], "document string, ordinal int, chunk_id string")
    lineage = spark.createDataFrame([("x", "unchanged", "w")], "chunk_id string, lineage_kind string, previous_chunk_id string")
    got = [tuple(r) for r in versioning.chunk_list(chunks, lineage, "document").orderBy("ordinal").collect()]
    assert got == [("d", 0, "x", "unchanged", "w"), ("d", 1, "y", "added", None)]
    assert maintenance.feed(spark.range(3000), ["id"], 5000).count() == maintenance.MOST_LISTED
    assert spark.range(1).select(fulltext.raw_score(F.lit(-3.0)).alias("s")).first().s == 0.25


def test_bounded_says_truncated(spark):
    edges = spark.createDataFrame([("a", "p", x) for x in "bcd"], "subject string, predicate string, object string")
    start = spark.createDataFrame([("a",)], "node string")
    got = graph.bounded_neighborhood(edges, start, 1, 10, 2).collect()
    assert [(r.object, r.truncated) for r in got] == [("b", True), ("c", True)]
    assert {r.truncated for r in graph.bounded_neighborhood(edges, start, 1).collect()} == {False}


def test_topics_without_claims(spark):
    row = spark.createDataFrame([("t", 1, "consensus", "core", "high")], "topic string, claim_id long, conclusion_type string, role string, confidence_level string")
    known = spark.createDataFrame([("t",), ("bare",)], "topic string")
    all_ = topics.with_all_topics(topics.report(row, ["topic"]), known, ["topic"])
    assert {r.topic: r.health_status for r in all_.collect()} == {"t": "healthy", "bare": "insufficient"}
    assert [(r.topic, r.severity) for r in topics.gaps(all_, ["topic"]).collect()] == [("bare", "high")]


def test_times_are_parsed(spark):
    with pytest.raises(ValueError):
        retrieval.Filters(since="2024-01-01T01:00:00+00:00", until="2024-01-01T01:30:00+01:00")
    with pytest.raises(ValueError):
        retrieval.Filters(since="yesterday")
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 3)), (3, None)], "k long, updated_at timestamp")
    assert retrieval.Filters(since="2024-01-02").apply(rows).count() + retrieval.Filters(until="2024-01-02T00:00:00Z").apply(rows).count() == 2


def test_cache_is_bounded():
    cache = maintenance.QueryCache(lambda q: [float(len(q))], most=2)
    for q in ("a", "bb", "a", "ccc"):
        cache.get("s", q)
    assert list(cache.held) == [("s", "a"), ("s", "ccc")] == list(cache.hits)


def test_pointer_survives_a_stop(spark, tmp_path):
    store = GenerationStore(spark, f"file://{tmp_path}")
    for g in ("1", "2"):
        store.write(g, spark.range(1))
        store.activate(g)
    assert store.current() == "2"
    shutil.move(tmp_path / "pointer", tmp_path / "pointer-next")
    assert store.current() == "2"
