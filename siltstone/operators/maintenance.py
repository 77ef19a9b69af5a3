"""Runs, restores, purges, sentinels and lookups by line."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import ordered


def config_fingerprint(versions: dict[str, str], config: dict) -> str:
    """One digest of parser, normalizer and chunker versions and their settings."""
    return hashlib.sha256(json.dumps([versions, config], sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def space_fingerprint(definition: dict) -> str:
    """A vector space's digest, whatever the order of its fields."""
    return hashlib.sha256(json.dumps(definition, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def run_key(snapshot: Column, config: str) -> Column:
    return F.sha2(F.concat_ws("\n", snapshot, F.lit(config)), 256)


def build_candidates(sources: DataFrame, runs: DataFrame, config: str) -> DataFrame:
    """Sources (source_id, snapshot_id) whose present snapshot has no ready run (run_key, state) under this configuration."""
    ready = runs.where("state = 'ready'").select("run_key").distinct()
    return sources.withColumn("run_key", run_key(F.col("snapshot_id"), config)).join(ready, "run_key", "left_anti")


#: Lines of a bin, as a power of two.
BIN_BITS = 6


def chunk_at_line(lines: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Each line's chunk (key, ordinal, start_line, end_line): the first that holds the line, else the document's first.

    A range join by bins of lines: a line meets only the chunks that reach into its bin.
    """
    first = chunks.groupBy(key).agg(F.min("ordinal").alias("first"))
    bins = F.sequence(F.shiftright("start_line", BIN_BITS), F.shiftright(F.greatest("start_line", "end_line"), BIN_BITS))
    held = chunks.select(key, "ordinal", "start_line", "end_line", F.explode(bins).alias("_bin"))
    hit = lines.select(key, "line", F.shiftright("line", BIN_BITS).alias("_bin")).join(held, [key, "_bin"], "left").groupBy(key, "line")
    held = hit.agg(F.min(F.when(F.col("line").between(F.col("start_line"), F.col("end_line")), F.col("ordinal"))).alias("inside"))
    return held.join(first, key, "left").select(key, "line", F.coalesce("inside", "first").alias("ordinal"), F.col("inside").isNotNull().alias("inside"))


def percentiles(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of each group, which may be of any size: equal values are counted first, then counts are summed in order."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    placed = ordered.running_sum(counts, keys, [value], "_c")
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_total")).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [placed[k].eqNullSafe(totals[f"_{k}"]) for k in keys])
    held = placed.join(totals, same).drop(*(f"_{k}" for k in keys))
    at = lambda r: F.greatest(F.lit(1), F.ceil(F.lit(r) * F.col("_total")))
    inside = lambda r: (at(r) > F.col("before")) & (at(r) <= F.col("before") + F.col("_c"))
    return held.groupBy(*keys).agg(*[F.max(F.when(inside(r), F.col(value))).alias(name) for name, r in ranks.items()])


def restorable(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of resources whose last operation (kind, before, after) is a delete, the changes that bring them back."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct("kind", "before", "after"), F.struct(*order)).alias("last"))
    return last.where("last.kind = 'delete'").select(*keys, F.col("last.after").alias("before"), F.col("last.before").alias("after"))


def purge(rows: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """``rows`` without the doomed keys, to be written as the next generation."""
    return rows.join(doomed.select(key).distinct(), key, "left_anti")


def snapshot_entries(entries: DataFrame, blobs: DataFrame, snapshots: DataFrame, source: str) -> DataFrame:
    """The entries of a source's latest snapshot (snapshot_id, source_id, sequence) with their blobs (sha256, size_bytes)."""
    last = snapshots.where(F.col("source_id") == source).agg(F.max_by("snapshot_id", "sequence").alias("snapshot_id"))
    held = entries.join(F.broadcast(last), "snapshot_id")  # one row
    return held.join(blobs.select(F.col("sha256").alias("blob_sha256"), "size_bytes"), "blob_sha256", "left")


def drift(sentinels: DataFrame, baseline: DataFrame) -> DataFrame:
    """(sentinel, state) of fixed texts' embedding hashes against those kept: baseline, match or drift."""
    held = sentinels.join(baseline.select("sentinel", F.col("vector_hash").alias("old")), "sentinel", "left")
    state = F.when(F.col("old").isNull(), "baseline").when(F.col("old") == F.col("vector_hash"), "match").otherwise("drift")
    return held.select("sentinel", state.alias("state"))


class QueryCache:
    """Embeddings of the ``most`` queries asked last, by space and text, with the hits of those held."""

    def __init__(self, embed, most: int = 10_000):
        self.embed, self.most, self.held, self.hits = embed, most, {}, {}

    def get(self, space: str, query: str) -> list[float]:
        key = (space, query)
        self.hits[key] = self.hits.get(key, -1) + 1
        self.held[key] = self.held.pop(key) if key in self.held else self.embed(query)
        if len(self.held) > self.most:
            oldest = next(iter(self.held))
            del self.held[oldest], self.hits[oldest]
        return self.held[key]


def scan_metrics(changes: DataFrame) -> DataFrame:
    """n_created, n_modified, n_deleted, n_renamed of classified changes; what was restored counts as modified."""
    of = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return changes.agg(of("created").alias("n_created"), of("modified", "restored").alias("n_modified"), of("deleted").alias("n_deleted"), of("renamed").alias("n_renamed"))


#: The longest listing that is asked for at once.
MOST_LISTED = 1000


def feed(events: DataFrame, order: list[str], most: int = 100, only: dict[str, str] | None = None) -> DataFrame:
    """The latest events, newest first, at most ``MOST_LISTED``: a top-k report. ``only``: column values they must have."""
    for column, value in (only or {}).items():
        events = events.where(F.col(column) == value)
    return events.orderBy(*[F.desc(c) for c in order]).limit(min(most, MOST_LISTED))


def dependents(targets: dict[str, tuple[DataFrame, str]], links: list[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """(kind, id, dependent, n): how many rows of each kind hang directly on every resource, zeros left out.

    ``targets``: kind to (table, id column). ``links``: (kind, dependent kind, table, column with the resource's id).
    """
    out = None
    for kind, dependent, rows, column in links:
        held, key = targets[kind]
        per = rows.groupBy(F.col(column).cast("string").alias("id")).agg(F.count("*").alias("n"))
        per = per.join(held.select(F.col(key).cast("string").alias("id")), "id", "left_semi").select(F.lit(kind).alias("kind"), "id", F.lit(dependent).alias("dependent"), "n")
        out = per if out is None else out.unionByName(per)
    return out


def operation_diff(log: DataFrame, resource: list[str], order: list[str]) -> DataFrame:
    """resource, first_before, last_after, n: what all operations on a resource changed, together."""
    step = F.struct(*order)
    return log.groupBy(*resource).agg(F.min_by("before", step).alias("first_before"), F.max_by("after", step).alias("last_after"), F.count("*").alias("n"))
