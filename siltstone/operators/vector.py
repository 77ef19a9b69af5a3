"""Vector search: exact nearest neighbours, semantic neighbours, upkeep of spaces."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.vectors import cosine

#: Vectors in one block of a blocked comparison: each goes to every other block, so that many are worth it.
BLOCK = 65_536
#: Vectors of a block that ask, and that answer at most, in one matrix product; how many answer in the first.
ASKING, ANSWERING, FIRST = 512, 4096, 256


def nearest(vectors: DataFrame, query: list[float], key: str, vector: str, most: int = 100) -> DataFrame:
    """Exact cosine search: key, similarity of the best ``most``. The query is in the plan; only each task's best rows move."""
    scored = vectors.select(key, cosine(F.col(vector), query).alias("similarity")).where("similarity is not null and not isnan(similarity)")
    return scored.orderBy(F.round("similarity", 9).desc(), key).limit(most)


def semantic_neighbors(vectors: DataFrame, key: str, vector: str, most: int = 8, block: int = BLOCK) -> DataFrame:
    """For each vector its ``most`` nearest others: key, neighbor, similarity, rank.

    Vectors are dealt into blocks of a bounded size; each pair of blocks is a row,
    compared by matrix products that keep only a row's best, so the pairs of single
    vectors never exist as rows. The work is that of the exact comparison asked for.
    """
    total = vectors.count()
    # spread by hash into twice as many as hold them, so that none is much larger than asked, and into enough for all tasks
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 1 if total <= min(block, ANSWERING) else max(2 * -(-total // block), math.ceil(2 * tasks**0.5))
    held = vectors.where(F.size(vector) > 0).select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("b"), F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    packed = held.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("rows"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = packed.select("b", F.col("rows").alias("a"), every.alias("o"))
    right = packed.select(F.col("b").alias("o"), F.col("rows").alias("c"), every.alias("b"))
    # by pair: a block's number alone would bring all its pairs to one task
    return best_of_blocks(left.hint("merge").join(right, ["b", "o"]).select("a", "c"), key, most)


def best_of_blocks(pairs: DataFrame, key: str, most: int, middle: np.ndarray | None = None) -> DataFrame:
    """key, neighbor, similarity, rank from pairs of blocks: ``a`` asks, ``c`` answers; both are arrays of (id, v) in order of id.

    With ``middle``, the centroids of cells by number, both have each vector's ``cell``
    and its ``reach`` too: cells whose centroids it meets with a lower product don't answer it.

    Single precision picks what may be among a row's best, double precision scores it.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, c = batch.column("a")[i].values, batch.column("c")[i].values
                raw, y = _stacked(a.field("v")), _unit(_stacked(c.field("v")))
                x, xi, yi = _unit(raw), a.field("id").to_numpy(), c.field("id").to_numpy()
                if middle is not None:  # those who ask the same cells, one after another
                    order = np.argsort(a.field("cell").to_numpy(), kind="stable")
                    raw, x, xi, reach = raw[order], x[order], xi[order], a.field("reach").to_numpy()[order, None]
                    cells, of = np.unique(c.field("cell").to_numpy(), return_inverse=True)
                usable = np.isfinite(y).all(axis=1)
                for at in range(0, len(xi), ASKING):
                    ids, within, used = xi[at : at + ASKING], None, usable
                    if middle is not None:
                        within = raw[at : at + ASKING] @ middle[cells].T >= reach[at : at + ASKING]
                        used = usable & within.any(axis=0)[of]
                    column = np.flatnonzero(used)
                    answers, names = (y, yi) if used.all() else (y[column], yi[column])
                    own, top, score = _best(x[at : at + ASKING], ids, answers, names, most, None if within is None else (within, of[column]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(names[top]), pa.array(score)], [key, "neighbor", "similarity"])

    scored = pairs.mapInArrow(best, f"{key} long, neighbor long, similarity double")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.round("similarity", 9).desc(), "neighbor"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def _best(x: np.ndarray, ids: np.ndarray, y: np.ndarray, names: np.ndarray, most: int, probed: tuple | None) -> tuple:
    """Rows of ``x``, of ``y`` and their products, ``most`` a row: the best that aren't the row itself, of the cells that it probes."""
    x4, y4 = x.astype(np.float32), y.astype(np.float32)
    slack = 2e-9 + (x.shape[1] + 8) * 2.0**-23  # what single precision, and rounding to nine digits, may change
    own, top, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor, on = np.full(len(x), -np.inf), 0
    while on < len(y):
        # a few answers first: what is worse than a row's k-th score so far is never scored or sorted
        end = min(len(y), on + (min(ANSWERING, 3 * on) or FIRST))
        product = x4 @ y4[on:end].T
        if not on:
            if probed:
                product[~probed[0][:, probed[1][:end]]] = -np.inf
            if end > most:  # one more, as it may be the row itself
                floor = np.partition(product, end - most - 1, axis=1)[:, end - most - 1] - slack
        row, column = np.divmod(np.flatnonzero(product >= (floor - slack).astype(np.float32)[:, None]), end - on)
        keep = names[on + column] != ids[row]
        if probed:
            keep &= probed[0][row, probed[1][on + column]]
        row, column = row[keep], column[keep]
        if len(row) * 16 > product.size:
            found = (x @ y[on:end].T)[row, column]
        else:
            found = np.einsum("ij,ij->i", x[row], y[on + column])
        on_top = found >= floor[row] - 2e-9  # and what may round to it
        own, top, score = (np.concatenate(p) for p in ((own, row[on_top]), (top, on + column[on_top]), (score, found[on_top])))
        # in order of rounded scores, then of ids, in which they come
        order = np.argsort(4.0 * own - np.round(score, 9), kind="stable")
        own, top, score = own[order], top[order], score[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        own, top, score, place = (p[place < most] for p in (own, top, score, place))
        last = place == most - 1
        floor[own[last]] = score[last]
        on = end
    return own, top, score


def _stacked(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    if len(vectors) and vectors.value_lengths().unique().to_pylist() != [len(vectors[0])]:
        raise ValueError("vectors of different lengths")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def coverage(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """expected, covered, stored: chunks, chunks with an embedding of their present hash, embeddings."""
    both = chunks.select("chunk_id", "content_hash").join(embedded.select("chunk_id", F.col("content_hash").alias("embedded_hash")), "chunk_id", "full_outer")
    return both.agg(
        F.count_if(F.col("content_hash").isNotNull()).alias("expected"),
        F.count_if(F.col("content_hash") == F.col("embedded_hash")).alias("covered"),
        F.count_if(F.col("embedded_hash").isNotNull()).alias("stored"),
    )


def stale(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Embeddings to drop or redo and chunks to embed: chunk_id, state of gone, stale or missing."""
    both = chunks.select("chunk_id", "content_hash").join(embedded.select("chunk_id", F.col("content_hash").alias("embedded_hash")), "chunk_id", "full_outer")
    state = F.when(F.col("content_hash").isNull(), "gone").when(F.col("embedded_hash").isNull(), "missing").when(F.col("content_hash") != F.col("embedded_hash"), "stale")
    return both.select("chunk_id", state.alias("state")).where("state is not null")


def embed_missing(chunks: DataFrame, embedded: DataFrame, embed, text: str) -> DataFrame:
    """Embeddings for chunks that have none of their present hash; the rest are left alone."""
    todo = chunks.join(embedded.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")
    return todo.select("chunk_id", "content_hash", embed(F.col(text)).alias("embedding"))


def embedding_input(title, path, content):
    """Title, path and content joined by lines, without empty ones."""
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (title, path, content)])


def query_input(instruction: str, query: str) -> str:
    """What is embedded for a query: its space's instruction, then the query in NFKC."""
    return f"{instruction}\nQuery: {unicodedata.normalize('NFKC', query).strip()}"


def compare_spaces(chunks: DataFrame, one: DataFrame, other: DataFrame, fingerprints: tuple[str, str]) -> DataFrame:
    """Coverage of two spaces side by side; their scores compare only under one fingerprint."""
    a, b = (coverage(chunks, s).select(*[F.col(c).alias(f"{c}_{i}") for c in ("expected", "covered", "stored")]) for i, s in ((1, one), (2, other)))
    return a.join(b).withColumn("comparable", F.lit(fingerprints[0] == fingerprints[1]))
