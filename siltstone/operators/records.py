"""What is kept of retrieval runs and topics: routes and items of every run, versions of every topic.

Runs are appended as three tables under one folder: runs, candidates (every route's
rows with rank and score, and whether the context took them) and items. A run is there
once its row is: candidates and items are written first, and readers join the runs.
Topics are versions that only grow: an update names the version it knows, and another
one in between is an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.generations import GenerationStore

RUN = "run_id string, query string, mode string, n_candidates long, n_items long"


def candidate_rows(routes: dict[str, DataFrame], taken: DataFrame, key: str) -> DataFrame:
    """(route, key, rank, score, selected) of all routes (key, rank, score): selected if ``taken`` (key) has it."""
    out = None
    for name, rows in routes.items():
        one = rows.select(F.lit(name).alias("route"), key, F.col("rank").cast("long").alias("rank"), F.col("score").cast("double").alias("score"))
        out = one if out is None else out.unionByName(one)
    marked = taken.select(key).distinct().withColumn("selected", F.lit(True))
    return out.join(marked, key, "left").withColumn("selected", F.coalesce("selected", F.lit(False))).select("route", key, "rank", "score", "selected")


class RetrievalRecords:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, query: str, mode: str, candidates: DataFrame, items: DataFrame) -> str:
        """Keep a run's ``candidate_rows`` and its context's items; both are cut results, a few hundred rows. Returns the run's id."""
        run = uuid.uuid4().hex
        for name, rows in (("candidates", candidates), ("items", items)):
            rows.write.mode("errorifexists").parquet(f"{self.root}/{name}/run_id={run}")
        counts = [self.spark.read.parquet(f"{self.root}/{name}/run_id={run}").count() for name in ("candidates", "items")]
        self.spark.createDataFrame([(run, query, mode, *counts)], RUN).coalesce(1).write.mode("append").parquet(f"{self.root}/runs")
        return run

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(f"{self.root}/runs")

    def of(self, run: str, name: str) -> DataFrame:
        """``candidates`` or ``items`` of a run; ``LookupError`` if the run was never finished."""
        if self.runs().where(F.col("run_id") == run).isEmpty():
            raise LookupError(f"no run {run}")
        return self.spark.read.parquet(f"{self.root}/{name}/run_id={run}")


class TopicVersions:
    """Topics' reports by version; the table of a version is never rewritten."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = GenerationStore(spark, f"{root.rstrip('/')}/topics")

    def version(self) -> int:
        return int(self.store.current() or 0)

    def publish(self, reports: DataFrame, known: int) -> int:
        """A new version after the one that the caller knows; ``ValueError`` if that isn't the latest."""
        if known != self.version():
            raise ValueError(f"topics are at version {self.version()}, not {known}")
        self.store.write(str(known + 1), reports)
        self.store.activate(str(known + 1))
        return known + 1

    def report(self, version: int | None = None) -> DataFrame:
        return self.store.read(str(version or self.version()))

    def history(self, key: str, digest: Column) -> DataFrame:
        """(version, key, change): of each version's topics, against the version before: added, modified, unchanged or removed."""
        every = None
        for v in range(1, self.version() + 1):
            one = self.report(v).select(F.lit(v).cast("long").alias("version"), key, digest.alias("digest"))
            every = one if every is None else every.unionByName(one)
        before = every.select((F.col("version") + 1).alias("version"), key, F.col("digest").alias("old")).where(F.col("version") <= self.version())
        both = every.join(before, ["version", key], "full_outer")
        change = F.when(F.col("old").isNull(), "added").when(F.col("digest").isNull(), "removed").when(F.col("old") == F.col("digest"), "unchanged").otherwise("modified")
        return both.select("version", key, change.alias("change"))


def moderated(relations: DataFrame, decisions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``relations`` (key, status) with the status of the last decision (key, decision, order...) on each: confirm, reject or none."""
    last = decisions.groupBy(key).agg(F.max_by("decision", F.struct(*order)).alias("decision"))
    status = F.when(F.col("decision") == "confirm", "user_confirmed").when(F.col("decision") == "reject", "rejected").otherwise(F.col("status"))
    return relations.join(last, key, "left").withColumn("status", status).drop("decision")


def merged_entities(aliases: DataFrame, finals: DataFrame) -> DataFrame:
    """(entity_id, alias): the aliases of entities that still stand, those of what was merged into them (entity, final) among them.

    A null ``final`` is a cycle of merges and an error.
    """
    held = aliases.join(finals.select(F.col("entity").alias("entity_id"), "final", F.lit(True).alias("moved")), "entity_id", "left")
    into = F.when(F.col("moved") & F.col("final").isNull(), F.raise_error(F.lit("a cycle of merges"))).otherwise(F.coalesce("final", "entity_id"))
    return held.select(into.alias("entity_id"), "alias").distinct()


def unsupported(statements: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(check, id): statements (statement_id) of which no citation (statement_id, evidence_key) has its evidence."""
    held = citations.join(evidence.select("evidence_key"), "evidence_key", "left_semi").select("statement_id")
    return statements.select("statement_id").join(held, "statement_id", "left_anti").select(F.lit("unsupported_statement").alias("check"), F.col("statement_id").cast("string").alias("id"))


def cross_document(links: DataFrame, children: DataFrame, child: str, parent: str) -> DataFrame:
    """(check, id): links (child, parent) whose child (child, parent) belongs elsewhere."""
    own = children.select(child, F.col(parent).alias("own"))
    return links.select(child, parent).join(own, child).where(~F.col("own").eqNullSafe(F.col(parent))).select(F.lit("cross_document").alias("check"), F.col(child).cast("string").alias("id")).distinct()


def gaps_in_sequence(rows: DataFrame, of: str, sequence: str) -> DataFrame:
    """(check, id): series whose numbers aren't 1, 2, 3, ... each once."""
    per = rows.groupBy(of).agg(F.count("*").alias("_n"), F.count_distinct(sequence).alias("_different"), F.min(sequence).alias("_first"), F.max(sequence).alias("_last"))
    return per.where("_n <> _different or _first <> 1 or _last <> _n").select(F.lit("sequence").alias("check"), F.col(of).cast("string").alias("id"))


def documents_listed(documents: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, n_chunks, tokens, first_line, last_line): documents with what their chunks (key, token_estimate, source_start_line, source_end_line) add up to."""
    per = chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.sum("token_estimate").alias("tokens"), F.min("source_start_line").alias("first_line"), F.max("source_end_line").alias("last_line"))
    zero = F.lit(0).cast("long")
    return documents.select(key).join(per, key, "left").select(key, F.coalesce("n_chunks", zero).alias("n_chunks"), F.coalesce("tokens", zero).alias("tokens"), "first_line", "last_line")
