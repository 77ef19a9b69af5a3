"""Vector spaces on disk: coarse cells, probing with an exact rerank, a gated life, resumable builds.

A space's vectors are stored at unit length, partitioned by the cell of their nearest
centroid. Centroids come from spherical k-means on at most ``SAMPLE`` vectors picked by
a hash of their key, so the driver's work has a fixed bound; every vector is stored and
found. With each cell its size and the least cosine to its centroid are kept.

A search reads the cells whose centroids are nearest to the query and ranks their
vectors exactly; ``probes_for`` measures how many cells a wanted recall takes. An exact search goes on with every cell that could still hold a better
vector: no vector of a cell is closer to the query than the angle to the centroid less
the cell's widest angle.

The registry of spaces is one small table behind a pointer: a space is building, ready,
deprecated or deleted, and at most one is active. Null keys, null or zero vectors, and
vectors that aren't finite are refused by ``write``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.vectors import dot, literal, norm
from siltstone.operators import vector
from siltstone.sources.generations import GenerationStore
from siltstone.sources.scratch import written

#: Vectors that centroids are trained on, rounds of k-means, most cells.
SAMPLE, TURNS, MOST_CELLS = 20_000, 12, 4096
#: Vectors that are held against all centroids at once.
SCORED = 1024
REGISTRY = "space string, state string, active boolean, fingerprint string, dimensions int, version int"


def centroids(vectors: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors; fewer than asked where vectors are fewer."""
    rng = np.random.default_rng(seed)
    found = vectors[np.sort(rng.choice(len(vectors), min(cells, len(vectors)), replace=False))]
    for _ in range(TURNS):
        own = np.argmax(vectors @ found.T, axis=1)
        total = np.zeros_like(found)
        np.add.at(total, own, vectors)
        size = np.linalg.norm(total, axis=1)
        found = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], found)
    return found


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.float64)


class VectorSpaces:
    """All spaces under one folder, over keys of one type."""

    def __init__(self, spark: SparkSession, root: str, key: str = "chunk_id", kind: str = "long"):
        self.spark, self.root, self.key, self.kind = spark, root.rstrip("/"), key, kind
        self.store = GenerationStore(spark, f"{self.root}/registry")

    # -- life ---------------------------------------------------------------

    def registry(self) -> DataFrame:
        return self.store.read() if self.store.current() else self.spark.createDataFrame([], REGISTRY)

    def _entry(self, space: str):
        found = self.registry().where(F.col("space") == space).first()
        if found is None:
            raise LookupError(f"no space {space}")
        return found

    def _put(self, rows: list[tuple]) -> None:
        """A registry with these entries in place of those of their spaces."""
        fresh = self.spark.createDataFrame(rows, REGISTRY)
        kept = self.registry().where(~F.col("space").isin([r[0] for r in rows]))
        generation = uuid.uuid4().hex
        self.store.write(generation, kept.unionByName(fresh).coalesce(1))
        self.store.activate(generation)

    def create(self, space: str, fingerprint: str, dimensions: int) -> None:
        if self.registry().where(F.col("space") == space).first():
            raise ValueError(f"space {space} exists")
        self._put([(space, "building", False, fingerprint, dimensions, 1)])

    def active(self) -> str | None:
        found = self.registry().where("active").first()
        return found.space if found else None

    def coverage(self, space: str, chunks: DataFrame) -> DataFrame:
        """expected, covered, stored of chunks (key, content_hash)."""
        return vector.coverage(*[rows.select(F.col(self.key).alias("chunk_id"), "content_hash") for rows in (chunks, self.vectors(space))])

    def activate(self, space: str, chunks: DataFrame) -> None:
        """Make a space the active one, if it covers every chunk; the active one before is deprecated."""
        entry = self._entry(space)
        if entry.state not in ("ready", "deprecated"):
            raise ValueError(f"space {space} is {entry.state}")
        own = self.coverage(space, chunks).first()
        if not own.expected or own.covered != own.expected:
            raise ValueError(f"space {space} covers {own.covered} of {own.expected}")
        before = self.registry().where(F.col("active") & (F.col("space") != space)).collect()  # one at most
        rows = [(r.space, "deprecated", False, r.fingerprint, r.dimensions, r.version + 1) for r in before]
        self._put([*rows, (space, "ready", True, entry.fingerprint, entry.dimensions, entry.version + 1)])

    def delete(self, space: str) -> None:
        """Its vectors go; the registry keeps its name. The active space can't be deleted."""
        entry = self._entry(space)
        if entry.active:
            raise ValueError(f"space {space} is active")
        self._put([(space, "deleted", False, entry.fingerprint, entry.dimensions, entry.version + 1)])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(space, ""))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # -- storage ------------------------------------------------------------

    def _path(self, space: str, name: str) -> str:
        return f"{self.root}/space={space}/{name}".rstrip("/")

    def write(self, space: str, rows: DataFrame, cells: int | None = None) -> None:
        """Store (key, content_hash, embedding); the space becomes ready."""
        entry, key = self._entry(space), self.key
        if entry.state != "building":
            raise ValueError(f"space {space} is {entry.state}")
        size = norm("embedding")
        bad = F.col(key).isNull() | F.col("embedding").isNull() | (F.size("embedding") != entry.dimensions) | F.isnan(size) | (size == 0) | (size == float("inf"))
        # the length as an array of one, or it would be worked out anew for each component
        scaled = F.transform(F.array(size), lambda s: F.transform("embedding", lambda x: (x / s).cast("float")))[0]
        unit = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("invalid vector"))).otherwise(scaled)
        held = written(rows.select(key, "content_hash", unit.alias("v")))
        total = held.count()
        wanted = cells or min(MOST_CELLS, max(1, int(total**0.5)))
        picked = held if total <= SAMPLE else held.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * 0.9 * SAMPLE / total))
        table = picked.select(key, "v").limit(SAMPLE).toArrow().sort_by(key)
        middle = centroids(_matrix(table.column("v").combine_chunks(), entry.dimensions), wanted) if total else np.zeros((0, entry.dimensions))

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in (batch.slice(at, SCORED) for at in range(0, batch.num_rows, SCORED)):
                    score = _matrix(rows.column("v"), middle.shape[1]) @ middle.T
                    own = score.argmax(axis=1)
                    near = score[np.arange(len(own)), own]
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(own.astype(np.int32)), pa.array(near)], [*batch.schema.names, "cell", "near"])

        dealt = held.mapInArrow(assigned, f"{key} {self.kind}, content_hash string, v array<float>, cell int, near double").hint("rebalance", "cell")
        dealt.write.partitionBy("cell").parquet(self._path(space, "vectors"))
        sizes = self.vectors(space).groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least"))
        named = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(middle)], "cell int, centroid array<double>")
        named.join(sizes, "cell").coalesce(1).write.parquet(self._path(space, "cells"))
        self._put([(space, "ready", False, entry.fingerprint, entry.dimensions, entry.version + 1)])

    def vectors(self, space: str) -> DataFrame:
        return self.spark.read.schema(f"{self.key} {self.kind}, content_hash string, v array<float>, near double, cell int").parquet(self._path(space, "vectors"))

    def cells(self, space: str) -> list:
        """(cell, centroid, n, least) of every cell that has vectors: ``MOST_CELLS`` at most."""
        return self.spark.read.parquet(self._path(space, "cells")).orderBy("cell").collect()

    # -- search -------------------------------------------------------------

    def search(self, query: list[float], most: int = 20, probes: int = 8, exact: bool = False, space: str | None = None) -> DataFrame:
        """key, similarity of the best ``most`` in the ``probes`` nearest cells, or in all that matter if ``exact``."""
        space = space or self.active()
        if space is None:
            raise LookupError("no space is active")
        found = self.cells(space)
        q = np.asarray(query, float) / np.linalg.norm(query)
        near = np.array([float(np.dot(q, c.centroid)) for c in found])
        order = np.argsort(-near, kind="stable")
        read = [found[i].cell for i in order[:probes]]
        best = self._scored(space, read, q, most)
        if exact:
            held = [r.similarity for r in best.collect()]  # ``most`` at most
            floor = held[-1] if len(held) == most else -1.0
            angle = np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip([c.least for c in found], -1, 1))
            bound = np.cos(np.maximum(angle, 0)) + 1e-6
            read = sorted({*read, *(c.cell for c, b in zip(found, bound, strict=True) if b >= floor)})
            best = self._scored(space, read, q, most)
        return best

    def _scored(self, space: str, cells: list[int], q: np.ndarray, most: int) -> DataFrame:
        rows = self.vectors(space).where(F.col("cell").isin(cells)).select(self.key, dot(F.col("v"), literal(q)).alias("similarity"))
        return rows.orderBy(F.round("similarity", 9).desc(), self.key).limit(most)

    def probes_for(self, space: str, share: float = 0.95, most: int = 8, asked: int = 256) -> int:
        """The fewest cells to probe that bring ``share`` of the ``most`` nearest of about ``asked`` stored vectors, found exactly."""
        found, held, key = self.cells(space), self.vectors(space), self.key
        total = sum(c.n for c in found)
        picked = held if total <= asked else held.where(F.pmod(F.xxhash64(key, F.lit(2)), F.lit(1 << 40)) < int((1 << 40) * asked / total))
        sample = picked.select(key, "v").limit(2 * asked).toArrow()
        if not len(sample):
            return 1
        middle = np.array([c.centroid for c in found])
        q, ids = _matrix(sample.column("v").combine_chunks(), middle.shape[1]), sample.column(key).to_pylist()

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = q @ _matrix(batch.column("v"), middle.shape[1]).T
                at = {k: i for i, k in enumerate(batch.column(key).to_pylist())}
                for row, k in enumerate(ids):
                    if k in at:
                        score[row, at[k]] = -9
                top = np.argsort(-score, axis=1, kind="stable")[:, :most]
                rows = np.repeat(np.arange(len(q)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), batch.column("cell").take(pa.array(top.ravel())), pa.array(score[rows, top.ravel()])], ["q", "cell", "s"])

        near = held.select(key, "v", "cell").mapInArrow(nearest, "q int, cell int, s double").where("s > -2")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "cell"))
        best = near.withColumn("place", place).where(F.col("place") <= most).select("q", "cell").collect()  # ``most`` for each asked
        order = np.argsort(np.argsort(-(q @ middle.T), axis=1, kind="stable"), axis=1)
        column = {c.cell: i for i, c in enumerate(found)}
        ranks = np.sort([order[r.q, column[r.cell]] for r in best]) if best else np.zeros(1, int)
        return int(ranks[min(len(ranks) - 1, int(np.ceil(share * len(ranks))) - 1)]) + 1

    def neighbors(self, space: str, most: int = 8, probes: int = 8, block: int = vector.BLOCK) -> DataFrame:
        """key, neighbor, similarity, rank of every vector's best in its ``probes`` nearest cells, and in any as near as the last of them.

        Cells that are near each other lie in one block of a bounded size, a cell larger
        than that in several. A block moves once to each block that one of its vectors
        probes, however many cells of it: as often as there are blocks at most.
        """
        found, key = self.cells(space), self.key
        middle = np.array([c.centroid for c in found]).reshape(len(found), -1)
        place = np.zeros(max((c.cell for c in found), default=0) + 1, np.int64)
        place[[c.cell for c in found]] = np.arange(len(found))
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        first, parts = _blocks(middle, np.array([c.n for c in found], np.int64), block, tasks)
        by_block = np.argsort(first, kind="stable")
        numbers, starts = np.unique(first[by_block], return_index=True)
        many = np.zeros(max(first, default=0) + 1, np.int64)
        many[first] = parts
        probes = min(probes, len(found))
        held = self.vectors(space).select(F.col(key).alias("id"), "v", "cell")

        def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for rows in (batch.slice(at, SCORED) for at in range(0, batch.num_rows, SCORED)):
                    score = _matrix(rows.column("v"), middle.shape[1]) @ middle.T
                    reach = np.partition(score, -probes, axis=1)[:, -probes] - 1e-12  # products differ in their last digits
                    yield rows, place[rows.column("cell").to_numpy()], score, reach

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, own, _, reach in reached(batches):
                columns = [*rows.columns[:2], *map(pa.array, (own.astype(np.int32), reach, first[own], parts[own]))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "cell", "reach", "first", "parts"])

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, own, score, reach in reached(batches):
                row, at = np.nonzero(np.logical_or.reduceat((score >= reach[:, None])[:, by_block], starts, axis=1))
                b, o = np.divmod(np.unique(first[own[row]] * (first.max() + 1) + numbers[at]), first.max() + 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b, many[b], o, many[o])], ["b", "bs", "o", "os"])

        rows = held.mapInArrow(dealt, f"id {self.kind}, v array<float>, cell int, reach double, first long, parts long")
        rows = rows.withColumn("b", F.col("first") + F.pmod(F.xxhash64("id"), "parts"))
        packed = rows.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("id", "v", "cell", "reach"))).alias("rows"))
        every = lambda c: F.explode(F.sequence(F.col(c), F.col(c) + F.col(f"{c}s") - 1)).alias(c)
        pairs = held.mapInArrow(met, "b long, bs long, o long, os long").distinct()
        pairs = written(pairs.select(every("b"), "o", "os").select("b", every("o")))
        left = packed.join(pairs, "b").select("b", "o", F.col("rows").alias("a"))
        right = packed.select(F.col("b").alias("o"), F.col("rows").alias("c")).join(pairs, "o")
        return vector.best_of_blocks(left.hint("merge").join(right, ["b", "o"]).select("a", "c"), key, most, middle)


def _blocks(middle: np.ndarray, sizes: np.ndarray, block: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its block's number and 1, or the first and the number of its blocks, if it is larger than one."""
    total = int(sizes.sum())
    most = total if total <= min(block, vector.ANSWERING) else max(1, min(block, int(total / (2 * tasks**0.5))))
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // max(most, 1)))
    coarse = centroids(middle, max(1, total // max(most, 1))) if total else middle
    number, held = -1, most
    for i in np.argsort(np.argmax(middle @ coarse.T, axis=1), kind="stable") if total else []:
        if held + sizes[i] > most:
            number, held = number + 1, 0
        first[i], held = number, held + sizes[i]
        number += int(parts[i]) - 1
    return first, parts


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """n_queries, n_wanted, n_found: how many of the exact neighbours (key, neighbor) were found."""
    both = exact.select(key, "neighbor").join(found.select(key, "neighbor", F.lit(1).alias("hit")), [key, "neighbor"], "left")
    return both.agg(F.count_distinct(key).alias("n_queries"), F.count("*").alias("n_wanted"), F.count("hit").alias("n_found"))


class EmbeddingBuild:
    """Embeddings by content hash in batches that are there whole or not at all.

    A batch is a folder that counts once Spark has committed it. What a space has
    already embedded is anti-joined, so a build that was killed goes on with the rest,
    and equal contents are embedded once.
    """

    def __init__(self, spark: SparkSession, root: str, space: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/{space}"

    def _finished(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(s.getPath().getParent().toString() for s in found)

    def done(self) -> DataFrame:
        """content_hash, embedding of finished batches."""
        paths = self._finished()
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], "content_hash string, embedding array<float>")

    def left(self, chunks: DataFrame) -> DataFrame:
        """Chunks (chunk_id, content_hash, ...) without an embedding of their hash."""
        return chunks.join(self.done().select("content_hash"), "content_hash", "left_anti")

    def run(self, chunks: DataFrame, embed, text: str, size: int = 1_000_000, stop_after: int | None = None) -> int:
        """Embed what is left in batches of about ``size`` contents; at most ``stop_after`` batches. Returns how many were written."""
        todo = written(self.left(chunks).groupBy("content_hash").agg(F.min(text).alias(text)))
        batches = -(-todo.count() // size)
        for b in range(batches if stop_after is None else min(batches, stop_after)):
            own = todo.where(batch_of(F.col("content_hash"), batches) == b)
            own.select("content_hash", embed(F.col(text)).alias("embedding")).write.parquet(f"{self.root}/{uuid.uuid4().hex}")
        return batches if stop_after is None else min(batches, stop_after)


def batch_of(content_hash: Column, batches: int) -> Column:
    """The batch of a hexadecimal hash, by its first eight digits."""
    return F.conv(F.substring(content_hash, 1, 8), 16, 10).cast("long") % batches
