"""Answers from evidence without a model, what is recorded of them, and what is related.

Nulls: evidence without content counts as evidence with an empty excerpt. Ties:
evidence is taken in order of position, then key. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import SPACE
from siltstone.operators import evidence as ev
from siltstone.operators import graph

# The mark of a claim's line, the part of it that is the statement, and the longest excerpt.
CLAIM_MARK = "@claim "
STATEMENT_PART = 4
EXCERPT = 600


def excerpt_of(content: Column) -> Column:
    """The first line that states a claim, else the first that is no heading, else all; at most ``EXCERPT`` characters."""
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), "\\r?\\n"), lambda x: F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    stated = F.filter(lines, lambda x: F.startswith(x, F.lit(CLAIM_MARK)))
    plain = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return F.substring(F.coalesce(F.get(stated, 0), F.get(plain, 0), content, F.lit("")), 1, EXCERPT)


def statement_of(excerpt: Column) -> Column:
    """A claim line's statement, or the excerpt itself."""
    part = F.get(F.split(F.substr(excerpt, F.lit(len(CLAIM_MARK) + 1)), "\\|"), STATEMENT_PART - 1)
    return F.when(F.startswith(excerpt, F.lit(CLAIM_MARK)) & (F.coalesce(part, F.lit("")) != ""), part).otherwise(excerpt)


def deterministic_answers(queries: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """key, result_kind, evidence_keys, statements: an answer for each query.

    ``items``: key, position, evidence_key, content, claim_status, role. The first
    item answers, the first two where any item's claim is disputed. A query without
    items has insufficient evidence. Only two items of a query outlive the aggregate.
    """
    item = F.struct("position", "evidence_key", "content", "claim_status", "role")
    first = items.groupBy(key).agg(F.min(item).alias("one"), F.bool_or(F.coalesce(F.col("claim_status") == "disputed", F.lit(False))).alias("disputed"))
    where = first.where("disputed").select(key, F.col("one.position").alias("p"), F.col("one.evidence_key").alias("k"))
    later = items.join(where, key).where(F.struct("position", "evidence_key") > F.struct(F.col("p").alias("position"), F.col("k").alias("evidence_key")))
    second = later.groupBy(key).agg(F.min(item).alias("two"))
    taken = F.filter(F.array("one", "two"), lambda x: x.isNotNull())
    held = queries.select(key).distinct().join(first, key, "left").join(second, key, "left").withColumn("taken", taken)
    against = F.exists("taken", lambda x: F.coalesce((x["claim_status"] == "disputed") | (x["role"] == "graph_contradict"), F.lit(False)))
    kind = F.when(F.size("taken") == 0, "insufficient_evidence").when(against, "conflicted").otherwise("answered")
    keys = F.transform("taken", lambda x: x["evidence_key"])
    return held.select(key, kind.alias("result_kind"), keys.alias("evidence_keys"), F.transform("taken", lambda x: statement_of(excerpt_of(x["content"]))).alias("statements"))


def run_records(candidates: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """What is kept of a retrieval run: key, n_candidates, n_items, n_routes, context_hash.

    ``candidates``: key, route, chunk_id, rank. ``items``: key, position, chunk_id, taken.
    The context's hash is that of its items in order, so equal contexts are found again.
    """
    c = candidates.groupBy(key).agg(F.count_distinct("chunk_id").alias("n_candidates"), F.count_distinct("route").alias("n_routes"))
    line = F.concat_ws(":", F.col("chunk_id").cast("string"), F.col("taken").cast("string"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"])  # a context is a few hundred items at most
    i = items.groupBy(key).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(ordered, "\n"), 256).alias("context_hash"))
    return c.join(i, key, "left").withColumn("n_items", F.coalesce("n_items", F.lit(0))).select(key, "n_candidates", "n_items", "n_routes", "context_hash")


def related_nodes(edges: DataFrame, node: str, depth: int = 1) -> DataFrame:
    """(node, depth): what is related to an id, by the graph."""
    start = edges.sparkSession.createDataFrame([(node,)], "node string")
    return graph.neighborhood(edges, start, depth).where("depth > 0")


def related_evidence(found: DataFrame, mentions: DataFrame, claims: DataFrame, held: DataFrame) -> DataFrame:
    """(claim_id, chunk_id, role, route_rank): what is related to a text, by the chunks a search found for it."""
    return ev.expand(found, mentions, claims, held)
