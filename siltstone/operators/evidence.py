"""From seeds to evidence, tracing, integrity, garbage, impact of deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSED = ["rejected", "deleted", "stale", "superseded"]


def expand(seeds: DataFrame, mentions: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims that bear on seed chunks (chunk_id): route_rank 0 by their own evidence, 1 by an entity the chunks mention.

    ``mentions``: chunk_id, entity. ``claims``: claim_id, subject, object, status.
    ``evidence``: claim_id, chunk_id, role. A claim reached both ways has the lower rank.
    """
    entities = mentions.join(seeds.select("chunk_id").distinct(), "chunk_id", "left_semi").select("entity").distinct()
    open_ = claims.where(~F.col("status").isin(*CLOSED))
    direct = evidence.join(seeds.select("chunk_id").distinct(), "chunk_id", "left_semi").select("claim_id").distinct().join(open_.select("claim_id"), "claim_id", "left_semi").withColumn("route", F.lit(0))
    by = [open_.join(entities.withColumnRenamed("entity", end), end, "left_semi").select("claim_id") for end in ("subject", "object")]
    via = by[0].union(by[1]).distinct().withColumn("route", F.lit(1))
    reached = direct.unionByName(via).groupBy("claim_id").agg(F.min("route").alias("route_rank"))
    return reached.join(evidence, "claim_id").select("claim_id", "chunk_id", "role", "route_rank")


def evidence_order() -> list[Column]:
    return [F.col("route_rank"), F.when(F.col("role") == "contradict", 0).otherwise(1), F.col("claim_id"), F.col("chunk_id")]


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, check: str) -> DataFrame:
    """(check, id): keys of ``child`` that ``parent`` lacks."""
    keys = child.select(F.col(child_key).cast("string").alias("id")).where("id is not null").distinct()
    return keys.join(parent.select(F.col(parent_key).cast("string").alias("id")), "id", "left_anti").select(F.lit(check).alias("check"), "id")


def uncovered(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, check: str) -> DataFrame:
    """(check, id): rows of ``parent`` that no row of ``child`` refers to."""
    return orphans(parent, child, parent_key, child_key, check)


def broken_chains(revisions: DataFrame) -> DataFrame:
    """Revisions whose parent isn't there or belongs to another document."""
    p = revisions.select(F.col("revision_id").alias("parent_revision_id"), F.col("document_id").alias("parent_document"))
    held = revisions.where("parent_revision_id is not null").join(p, "parent_revision_id", "left")
    return held.where(F.col("parent_document").isNull() | (F.col("parent_document") != F.col("document_id"))).select(F.lit("revision_chain").alias("check"), F.col("revision_id").alias("id"))


def unreferenced(candidates: DataFrame, key: str, holders: list[tuple[DataFrame, str]]) -> DataFrame:
    """Candidates that none of the holders refer to."""
    out = candidates
    for rows, column in holders:
        out = out.join(rows.select(F.col(column).alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return out


def trace(items: DataFrame, blobs: DataFrame) -> DataFrame:
    """Items (item_id, blob_sha256, start, length, quote) and whether the blob (sha256, content) still has its hash and, there, the quote."""
    held = items.join(blobs.select(F.col("sha256").alias("blob_sha256"), "content"), "blob_sha256", "left")
    text = F.decode("content", "utf-8")
    state = F.when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) != F.col("blob_sha256"), "corrupt")
    state = state.when(F.substr(text, F.col("start"), F.col("length")) != F.col("quote"), "moved").otherwise("verified")
    return held.select("item_id", state.alias("state"))


def cascade(start: DataFrame, steps: list[tuple[str, DataFrame, str, str, str]]) -> DataFrame:
    """(kind, id, depth) of everything that hangs on ``start`` (kind, id).

    A step is (from kind, link table, from column, to column, to kind); steps come in
    order of dependence, each a semi-join on what was reached before.
    """
    reached = start.select("kind", F.col("id").cast("string").alias("id"), F.lit(0).alias("depth"))
    for n, (source, table, a, b, target) in enumerate(steps, 1):
        ids = reached.where(F.col("kind") == source).select("id").distinct()
        hit = table.select(F.col(a).cast("string").alias("id"), F.col(b).cast("string").alias("to")).join(ids, "id", "left_semi")
        reached = reached.unionByName(hit.select(F.lit(target).alias("kind"), F.col("to").alias("id"), F.lit(n).alias("depth")).where("id is not null").distinct())
    return reached.groupBy("kind", "id").agg(F.min("depth").alias("depth"))


def impact_counts(reached: DataFrame) -> DataFrame:
    return reached.groupBy("kind").agg(F.count("*").alias("n"), F.min("depth").alias("depth"))


def purge_blockers(source: Column, blockers: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(blocker, n): what still holds on to a source; it can be purged when all are zero."""
    out = None
    for name, (rows, column) in blockers.items():
        one = rows.agg(F.count_if(column == source).alias("n")).select(F.lit(name).alias("blocker"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def exclusive(refs: DataFrame, owner: str, item: str) -> DataFrame:
    """(owner, item) of items that only one owner refers to: what goes with it."""
    per = refs.groupBy(item).agg(F.count_distinct(owner).alias("n"), F.min(owner).alias(owner))
    return per.where("n = 1").select(owner, item)


def invalidate(results: DataFrame, inputs: DataFrame, changed: DataFrame, key: str, by: str) -> DataFrame:
    """Results with ``status`` stale where an input (key, by) is among ``changed`` (by)."""
    hit = inputs.join(changed.select(by).distinct(), by, "left_semi").select(key).distinct().withColumn("hit", F.lit(True))
    return results.join(hit, key, "left").withColumn("status", F.when(F.col("hit"), "stale").otherwise("active")).drop("hit")
