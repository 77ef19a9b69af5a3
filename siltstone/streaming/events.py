"""Structured Streaming: event hints, sessions, change batches and delete grace."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from siltstone.sources.scratch import written


def hint_buckets(events: DataFrame, ts: str, keys: list[str], width: str = "250 milliseconds", late: str | None = None) -> DataFrame:
    """Hints per key and bucket of time. On a stream, ``late`` is how long a bucket waits; batches need none."""
    if late and events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("bucket"), "n")


def dedupe_hints(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first of equal hints within the time that state is kept for."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def sessions(events: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """(key, session_start, session_end, n): runs of events with no gap of ``gap`` or more between them."""
    grouped = events.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
    return grouped.select(key, F.col("s.start").alias("session_start"), F.col("last").alias("session_end"), "n")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their ``rank`` from 1 in a total order: ``order``, then a hash of the whole row; equal rows take any of their ranks.

    Range partitions are sorted and written, then counted; a row's rank is its place and
    the counts of the partitions before. Where the bounds lie doesn't change it, so
    neither do the number of partitions nor the sample that the bounds come from.
    """
    whole = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)
    placed = rows.withColumn("_h", whole).repartitionByRange(*order, "_h").sortWithinPartitions(*order, "_h").withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_at", 33)))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    counts = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(counts), "_part").withColumn("rank", F.col("_before") + within + 1).drop("_part", "_before", "_at")


def change_batches(changes: DataFrame, order: list[str], most: int = 500) -> DataFrame:
    """Changes in numbered ``batch``es of ``most`` with the batch's ``key``: a digest of its number and rows.

    The same changes give the same batches and keys on any number of partitions.
    """
    rows = ranked(changes, order).withColumn("batch", F.floor((F.col("rank") - 1) / most))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "_h"))), lambda x: x["_h"])  # ``most`` at most
    keys = rows.groupBy("batch").agg(F.sha2(F.concat_ws("\n", F.col("batch").cast("string"), F.array_join(lines, "\n")), 256).alias("key"))
    return rows.join(keys, "batch").drop("_h", "rank")


class Receipts:
    """Which batches have been handed over. A batch that comes again meets its receipt."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def keys(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/receipts")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema("key string").parquet(str(path)) if there else self.spark.createDataFrame([], "key string")

    def hand_over(self, batches: DataFrame) -> DataFrame:
        """Write batches without a receipt, one folder each, then their receipts; returns the keys that were new.

        A crash in between leaves folders without a receipt, which the next hand-over replaces by the same rows.
        """
        new = written(batches.join(self.keys(), "key", "left_anti"))
        new.write.partitionBy("key").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.root}/batches")
        keys = new.select("key").distinct()
        keys.write.mode("append").parquet(f"{self.root}/receipts")
        return keys

    def delivered(self) -> DataFrame:
        """Rows of batches with a receipt."""
        return self.spark.read.parquet(f"{self.root}/batches").join(self.keys().distinct(), "key", "left_semi")


def without_own_writes(changes: DataFrame, receipts: DataFrame, ttl_seconds: int = 30) -> DataFrame:
    """Changes (path, hash, at) that no receipt (path, hash, written_at) of this engine's own writes explains."""
    r = receipts.select("path", "hash", "written_at")
    fresh = (changes["at"] >= r["written_at"]) & (F.unix_micros(changes["at"]) - F.unix_micros(r["written_at"]) <= ttl_seconds * 1_000_000)
    return changes.join(r, (changes["path"] == r["path"]) & (changes["hash"] == r["hash"]) & fresh, "left_anti")


def _grace(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, grace_ms: int) -> Iterator[pd.DataFrame]:
    """Missing paths become deleted when their grace has passed without a sighting."""
    columns = ["path", "kind", "at"]
    if state.hasTimedOut:
        (since,) = state.get
        state.remove()
        yield pd.DataFrame([(key[0], "deleted", pd.Timestamp(since, unit="ms"))], columns=columns)
        return
    rows = pd.concat(list(batches)).sort_values("ts")
    out = []
    for seen, ts in zip(rows["present"], rows["ts"], strict=True):
        if seen:
            if state.exists:
                out.append((key[0], "returned", ts))
                state.remove()
        elif not state.exists:
            state.update((int(ts.timestamp() * 1000),))
            out.append((key[0], "missing_pending", ts))
    if state.exists:
        state.setTimeoutTimestamp(max(state.get[0] + grace_ms, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=columns)


def delete_grace(observations: DataFrame, late: str, grace_ms: int) -> DataFrame:
    """A stream of (path, present, ts) to missing_pending, returned and deleted events: the grace is an event-time timer per path."""
    stream = observations.withWatermark("ts", late)
    return stream.groupBy("path").applyInPandasWithState(
        lambda k, b, s: _grace(k, b, s, grace_ms), "path string, kind string, at timestamp", "since long", "append", GroupStateTimeout.EventTimeTimeout
    )


def write_once(batch: DataFrame, batch_id: int, path: str) -> None:
    """A ``foreachBatch`` sink whose repeat of a batch replaces that batch alone."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def due(connections: DataFrame, now, most: int = 20) -> DataFrame:
    """The connections to scan first."""
    return connections.where(F.col("next_scan_at") <= F.lit(now)).orderBy("next_scan_at", "connection_id").limit(most)


def session_rows(events: DataFrame, ts: str, key: str, gap_seconds: int) -> DataFrame:
    """Each event with its session's number within its key: for batches, by the time since the event before."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    new = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w)) >= gap_seconds * 1_000_000).cast("long")
    return events.withColumn("session", F.sum(F.coalesce(new, F.lit(1))).over(w))
