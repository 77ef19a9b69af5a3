"""A graph built in layers: each is a base with overlays, and only what changed is built.

A layer makes rows from documents, one document at a time. It keeps (key, version,
part, gone) beside its rows: what it has built of which version in which part. A build
compares the documents with that by key, writes an overlay of the changed ones and
marks removals; a layer whose input digest is the one it was built from writes
nothing. Rows are resolved by a keyed merge: a row counts if its part is its document's
latest. The parts and digests of all layers become current together, by one pointer,
after ``check``; a build that fails leaves the generation before.

Documents need distinct keys that aren't null.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources import digests
from siltstone.sources.generations import GenerationStore

STATE = "layer string, digest string, parts array<string>"


class LayeredGraph:
    """``layers``: name to a function from documents (key, version, ...) to rows with ``key``, in order of building."""

    def __init__(self, spark: SparkSession, root: str, key: str, layers: dict[str, Callable[[DataFrame], DataFrame]]):
        self.spark, self.root, self.key, self.layers = spark, root.rstrip("/"), key, layers
        self.store = GenerationStore(spark, f"{self.root}/generations")

    def _path(self, layer: str, part: str, name: str) -> str:
        return f"{self.root}/layer={layer}/part={part}/{name}"

    def state(self) -> dict:
        """layer to (digest, parts) of the current generation."""
        return {r.layer: (r.digest, list(r.parts)) for r in self.store.read().collect()} if self.store.current() else {}  # a row a layer

    def _read(self, layer: str, parts: list[str], name: str) -> DataFrame | None:
        out = None
        for i, p in enumerate(parts):
            one = self.spark.read.parquet(self._path(layer, p, name)).withColumn("part", F.lit(i))
            out = one if out is None else out.unionByName(one)
        return out

    def _latest(self, layer: str, parts: list[str]) -> DataFrame | None:
        keys = self._read(layer, parts, "keys")
        if keys is None or len(parts) == 1:
            return keys
        last = keys.groupBy(self.key).agg(F.max_by(F.struct("version", "part", "gone"), "part").alias("k"))
        return last.select(self.key, "k.version", "k.part", "k.gone")

    def rows(self, layer: str) -> DataFrame:
        """A layer's rows in the current generation."""
        _, parts = self.state()[layer]
        rows = self._read(layer, parts, "rows")
        if len(parts) == 1:
            return rows.drop("part")
        live = self._latest(layer, parts).where("not gone").select(self.key, "part")
        return rows.join(live, [self.key, "part"], "left_semi").drop("part")

    def build(self, docs: DataFrame, only: list[str] | None = None, check: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
        """Bring the layers (or ``only`` these) up to ``docs``; returns how many documents each has built anew.

        ``check`` gets the rows of every changed overlay and returns bad ones.
        """
        digest = digests.root(docs, self.key, "version").first().watermark
        state, built = self.state(), {}
        for layer, make in self.layers.items():
            if only is not None and layer not in only:
                continue
            before, parts = state.get(layer, (None, []))
            built[layer] = 0
            if before == digest:
                continue
            known, part = self._latest(layer, parts), uuid.uuid4().hex
            live = known.where("not gone").select(self.key, F.col("version").alias("old")) if known is not None else None
            changed = docs if live is None else docs.join(live, (docs[self.key] == live[self.key]) & (docs["version"] == live["old"]), "left_anti")
            gone = None if live is None else live.join(docs.select(self.key), self.key, "left_anti")
            keys = changed.select(self.key, "version", F.lit(False).alias("gone"))
            if gone is not None:
                keys = keys.unionByName(gone.select(self.key, F.col("old").alias("version"), F.lit(True).alias("gone")))
            keys.write.parquet(self._path(layer, part, "keys"))
            make(changed).write.parquet(self._path(layer, part, "rows"))
            if check and not (bad := check(self.spark.read.parquet(self._path(layer, part, "rows")))).isEmpty():
                raise ValueError(f"layer {layer} has bad rows, such as {bad.first()}")
            built[layer] = self.spark.read.parquet(self._path(layer, part, "keys")).where("not gone").count()
            state[layer] = (digest, [*parts, part])
        self._publish(state)
        return built

    def _publish(self, state: dict) -> None:
        generation = uuid.uuid4().hex
        self.store.write(generation, self.spark.createDataFrame([(k, d, p) for k, (d, p) in state.items()], STATE).coalesce(1))
        self.store.activate(generation)

    def compact(self, layer: str) -> None:
        """One base in place of a layer's base and overlays."""
        digest, parts = self.state()[layer]
        part = uuid.uuid4().hex
        self.rows(layer).write.parquet(self._path(layer, part, "rows"))
        self._latest(layer, parts).where("not gone").select(self.key, "version", "gone").write.parquet(self._path(layer, part, "keys"))
        self._publish(self.state() | {layer: (digest, [part])})
