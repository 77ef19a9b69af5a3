"""Kept runs, topic versions, moderation, merges and checks on small rows."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import graph, records


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_a_run_is_there_once_it_is_finished(spark, tmp_path):
    kept = records.RetrievalRecords(spark, f"file://{tmp_path}/runs")
    routes = {"fts": rows(spark, "id long, rank int, score double", (1, 1, 2.0), (2, 2, 1.0)), "vector": rows(spark, "id long, rank int, score double", (2, 1, 0.9), (3, 2, 0.8))}
    found = records.candidate_rows(routes, rows(spark, "id long", (2,)), "id")
    run = kept.add("q", "hybrid", found, rows(spark, "id long, position int", (2, 1)))
    assert sorted(map(tuple, kept.of(run, "candidates").select("route", "id", "rank", "selected").collect())) == [("fts", 1, 1, False), ("fts", 2, 2, True), ("vector", 2, 1, True), ("vector", 3, 2, False)]
    assert [(r.query, r.n_candidates, r.n_items) for r in kept.runs().collect()] == [("q", 4, 1)]
    found.write.parquet(f"file://{tmp_path}/runs/candidates/run_id=crashed")
    with pytest.raises(LookupError):
        kept.of("crashed", "candidates")


def test_topic_versions(spark, tmp_path):
    held = records.TopicVersions(spark, f"file://{tmp_path}")
    assert held.publish(rows(spark, "topic string, n long", ("a", 1), ("b", 1)), 0) == 1
    held.publish(rows(spark, "topic string, n long", ("a", 1), ("b", 2), ("c", 1)), 1)
    with pytest.raises(ValueError, match="version 2, not 1"):
        held.publish(rows(spark, "topic string, n long"), 1)
    held.publish(rows(spark, "topic string, n long", ("c", 1)), 2)
    got = sorted(map(tuple, held.history("topic", F.col("n").cast("string")).collect()))
    assert got == [(1, "a", "added"), (1, "b", "added"), (2, "a", "unchanged"), (2, "b", "modified"), (2, "c", "added"), (3, "a", "removed"), (3, "b", "removed"), (3, "c", "unchanged")]
    assert held.report().count() == 1 and held.report(1).count() == 2


def test_moderation_and_merges(spark):
    relations = rows(spark, "id long, status string", (1, "active"), (2, "active"), (3, "stale"), (4, "active"))
    decisions = rows(spark, "id long, decision string, at int", (1, "reject", 1), (1, "confirm", 2), (2, "reject", 1), (3, None, 1), (9, "confirm", 1))
    assert sorted(map(tuple, records.moderated(relations, decisions, "id", ["at"]).collect())) == [(1, "user_confirmed"), (2, "rejected"), (3, "stale"), (4, "active")]
    aliases = rows(spark, "entity_id long, alias string", (1, "a"), (2, "b"), (2, "a"), (3, "c"), (4, None))
    merges = rows(spark, "from long, to long", (3, 2), (2, 1))
    assert sorted(map(tuple, records.merged_entities(aliases, graph.redirects(merges)).collect()), key=str) == [(1, "a"), (1, "b"), (1, "c"), (4, None)]
    with pytest.raises(Exception, match="cycle"):
        records.merged_entities(aliases, graph.redirects(rows(spark, "from long, to long", (3, 2), (2, 3)))).collect()


def test_checks(spark):
    out = records.gaps_in_sequence(rows(spark, "d string, n int", ("a", 1), ("a", 2), ("b", 2), ("c", 1), ("c", 1), ("e", 1), ("e", 3)), "d", "n")
    assert sorted(r.id for r in out.collect()) == ["b", "c", "e"]
    links = rows(spark, "c string, d string", ("c1", "d1"), ("c2", "d1"), ("c3", None), ("c9", "d1"))
    children = rows(spark, "c string, d string", ("c1", "d1"), ("c2", "d2"), ("c3", "d1"))
    assert sorted(r.id for r in records.cross_document(links, children, "c", "d").collect()) == ["c2", "c3"]
    statements, citations = rows(spark, "statement_id long", (1,), (2,), (3,)), rows(spark, "statement_id long, evidence_key string", (1, "E1"), (2, "E9"), (2, None))
    assert sorted(r.id for r in records.unsupported(statements, citations, rows(spark, "evidence_key string", ("E1",), ("E2",))).collect()) == ["2", "3"]
    chunks = rows(spark, "d string, token_estimate int, source_start_line int, source_end_line int", ("d1", 5, 1, 2), ("d1", 7, 3, 9))
    assert sorted(map(tuple, records.documents_listed(rows(spark, "d string", ("d1",), ("d2",)), chunks, "d").collect())) == [("d1", 2, 12, 1, 9), ("d2", 0, 0, None, None)]
