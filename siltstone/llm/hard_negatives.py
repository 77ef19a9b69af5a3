"""Hard negatives for contrastive training, by a vector-approximation file.

For every anchor the nearest rows of its label are its positives, and for every
positive the nearest rows of other labels whose score lies in a window below the
positive's score are its hard negatives. Scores are integer inner products of
quantised vectors and every answer is exact.

The vector-approximation file keeps one byte a dimension: the number of the cell that
a component lies in, ``CELLS`` cells of equal width between that dimension's least and
greatest value. For an anchor a table of each dimension's cells gives the least and
the greatest product a cell allows, so a row's score is bounded from both sides by
adding table entries. Only rows whose bounds can still reach an anchor's best, or
enter one of its windows, are scored exactly:

* positives: rows whose upper bound reaches the k-th best score or lower bound so far;
* negatives: rows whose bounds meet the window and whose upper bound reaches the k-th
  best among those found or certain to be inside.

Anchors are a share of all rows, so nothing is broadcast: rows are dealt evenly into
groups of about ``ROWS``, anchors into groups of about ``ANCHORS``, and each task
takes one group of both. It holds these alone, and hands on the best of each anchor,
which a window ranks over all groups. Of rows of equal label and vector only the
first few by id can come first, so large groups of copies are cut to these (ranked
before the shuffle); copies are still anchors.

Rows with a null vec_id, label, vector or component, or one that is not finite, take
no part. Of rows that share a vec_id the one of the smallest label, then smallest
vector, stands for all. Shorter vectors are filled with zeros. Equal scores go by
smaller vec_id. Anchors without positives, and positives without negatives, give no
rows; neither does an empty table. Scores beyond 62 bits raise. Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import materialize, renamed

CELLS = 256
#: Rows and anchors of a task's groups; rows and anchors whose bounds are held at once.
ROWS, ANCHORS = 1 << 14, 1 << 12
ROW_SLICE, ANCHOR_SLICE = 2048, 64
MOST_TASKS = 20_000
LOWEST = -(1 << 62)

PAIR = "anchor_id long, other_id long, score long"
NEGATIVE = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and v, the floors of ``scale`` times the components, of the ``embedding`` rows that take part."""
    found = renamed(rows, vec_id="vec_id", label="label", embedding="e")
    inside = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    found = found.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & inside)
    return found.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("e", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def one_each(rows: DataFrame) -> DataFrame:
    """One row for each vec_id."""
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def first_copies(rows: DataFrame, most: int) -> DataFrame:
    """Of rows equal in label and vector the first ``most`` by vec_id; Spark cuts them before the shuffle too."""
    order = Window.partitionBy("label", "v").orderBy("vec_id")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


class Cells:
    """The cells of every dimension: their least and greatest values."""

    def __init__(self, least: list[int], greatest: list[int]):
        self.least = np.array(least, np.int64)
        self.width = (np.array(greatest, np.int64) - self.least) // CELLS + 1
        self.low = self.least[:, None] + np.arange(CELLS) * self.width[:, None]
        self.high = self.low + self.width[:, None] - 1
        self.size = max([0, *map(abs, least), *map(abs, greatest)]) + int(self.width.max(initial=1))

    def approximate(self, v: np.ndarray) -> np.ndarray:
        return ((v - self.least) // self.width).astype(np.uint8)

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product by dimension, cell and anchor."""
        bound = self.size * int(np.abs(anchors).max(initial=0)) * max(1, len(self.least))
        if bound >= 1 << 62:
            raise OverflowError("scores need more than 62 bits")
        a = anchors.T[:, None, :].astype(np.int32 if bound < 1 << 30 else np.int64)
        x, y = a * self.low[:, :, None].astype(a.dtype), a * self.high[:, :, None].astype(a.dtype)
        return np.minimum(x, y), np.maximum(x, y)

    @staticmethod
    def bounds(tables: tuple[np.ndarray, np.ndarray], cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of rows (by their cells) and anchors (by their tables)."""
        out = []
        for t in tables:
            total = np.zeros((len(cells), t.shape[2]), t.dtype)
            for d in range(len(t)):
                total += t[d][cells[:, d]]
            out.append(total)
        return out[0], out[1]


def file_of(rows: DataFrame) -> tuple[Cells, int]:
    """The cells of a table's dimensions, from one row of least and greatest values for each, and its number of rows."""
    sides = rows.select(F.posexplode("v")).groupBy("pos").agg(F.min("col").alias("a"), F.max("col").alias("b")).orderBy("pos").collect()
    return Cells([min(0, r.a) for r in sides], [max(0, r.b) for r in sides]), rows.count()


def _vectors(column: pa.ChunkedArray, size: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    counts, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), size), np.int64)
    out[np.arange(size) < counts[:, None]] = flat
    return out


def _kth(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """By anchor, the k-th greatest of the allowed scores; ``LOWEST`` where there are fewer."""
    if len(scores) < k:
        return np.full(scores.shape[1], LOWEST)
    kept = np.where(allowed, scores, np.iinfo(scores.dtype).min)
    found = np.partition(kept, len(kept) - k, axis=0)[len(kept) - k].astype(np.int64)
    return np.where(found == np.iinfo(scores.dtype).min, LOWEST, found)


class Best:
    """The k best (score, smaller id) of each of n queries, as rows come in."""

    def __init__(self, n: int, k: int):
        self.k, self.at = k, np.full(n, LOWEST)
        self.query = self.score = self.id = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = (np.concatenate(c) for c in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, q, "left")
        place = np.arange(len(q)) - first
        keep = place < self.k
        last = place == self.k - 1
        self.at[q[last]] = s[last]
        self.query, self.score, self.id = q[keep], s[keep], i[keep]


def _group(left: pa.Table, right: pa.Table, size: int):
    """Rows' and anchors' ids, labels and vectors."""
    for t in (left, right):
        yield t.column("vec_id").to_numpy(), t.column("label").to_numpy(), _vectors(t.column("v"), size)


def _searched(cells: Cells, left: pa.Table, right: pa.Table, take) -> None:
    """Call ``take`` with every slice of both groups and the bounds of their scores."""
    (ids, labels, v), (a_ids, a_labels, a) = _group(left, right, len(cells.least))
    approximations = cells.approximate(v)
    for at in range(0, len(a), ANCHOR_SLICE):
        own = slice(at, at + ANCHOR_SLICE)
        tables = cells.tables(a[own])
        for start in range(0, len(v), ROW_SLICE):
            rows = slice(start, start + ROW_SLICE)
            low, high = cells.bounds(tables, approximations[rows])
            alike = labels[rows][:, None] == a_labels[own]
            itself = ids[rows][:, None] == a_ids[own]

            def exact(may: np.ndarray, v=v[rows], a=a[own], ids=ids[rows], at=at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                r, q = np.nonzero(may)
                return q + at, np.einsum("ij,ij->i", v[r], a[q]), ids[r]

            take(own, low, high, alike, itself, exact)


def _positives(cells: Cells, most: int):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        best = Best(len(right), most)

        def take(own, low, high, alike, itself, exact):
            may = alike & ~itself
            may &= high >= np.maximum(best.at[own], _kth(low, may, most))
            best.add(*exact(may))

        _searched(cells, left, right, take)
        anchors = right.column("vec_id").to_numpy()
        return pa.table({"anchor_id": anchors[best.query], "other_id": best.id, "score": best.score})

    return cell


def _negatives(cells: Cells, most: int, lowest: int, highest: int):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = [[(p["score"], p["other_id"]) for p in own] for own in right.column("positives").to_pylist()]
        width = max(map(len, pairs), default=0)
        scores = np.array([[p[0] for p in own] + [0] * (width - len(own)) for own in pairs], np.int64).reshape(len(pairs), width)
        names = np.array([[p[1] for p in own] + [0] * (width - len(own)) for own in pairs], np.int64).reshape(len(pairs), width)
        there = np.arange(width) < np.array([len(own) for own in pairs])[:, None]
        floor, top = -((-lowest * scores) // 100), highest * scores // 100
        top = np.where(there, top, floor - 1)
        best = [Best(len(right), most) for _ in range(width)]

        def take(own, low, high, alike, itself, exact):
            for w in range(width):
                a, b = floor[own, w], top[own, w]
                may = ~alike & (high >= a) & (low <= b)
                sure = may & (low >= a) & (high <= b)
                may &= high >= np.maximum(best[w].at[own], _kth(low, sure, most))
                q, s, i = exact(may)
                inside = (s >= floor[q, w]) & (s <= top[q, w])
                best[w].add(q[inside], s[inside], i[inside])

        _searched(cells, left, right, take)
        anchors = right.column("vec_id").to_numpy()
        parts = [{"anchor_id": anchors[x.query], "positive_id": names[x.query, w], "positive_score": scores[x.query, w], "negative_id": x.id, "negative_score": x.score} for w, x in enumerate(best)]
        kinds = [c.split()[0] for c in NEGATIVE.split(", ")]
        return pa.table({c: pa.array(np.concatenate([np.zeros(0, np.int64), *(p[c] for p in parts)])) for c in kinds})

    return cell


def _dealt(rows: DataFrame, own: int, groups: int, others: int, mine_first: bool) -> DataFrame:
    """A copy of ``rows`` for each group of the other side, by the number of the pair of groups."""
    group = F.pmod(F.xxhash64("vec_id"), F.lit(own))
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    cell = F.col("g") * groups + F.col("o") if mine_first else F.col("o") * others + F.col("g")
    return rows.withColumn("g", group).withColumn("o", other).withColumn("cell", cell).drop("g", "o")


def searched(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, cell, schema: str) -> DataFrame:
    """``cell`` over every pair of a group of rows and a group of anchors."""
    r, a = -(-n_rows // ROWS), -(-n_anchors // ANCHORS)
    tasks = min(r * a, MOST_TASKS)  # named, as few bytes are much work here and would be put together
    left, right = (_dealt(rows, r, a, a, True).repartition(tasks, "cell"), _dealt(anchors, a, r, a, False).repartition(tasks, "cell"))
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(cell, schema)


def first(rows: DataFrame, by: list[str], score: str, other: str, most: int) -> DataFrame:
    """The ``most`` greatest scores, then smallest ids, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), other)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, lowest: int = 30, highest: int = 90) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, v as whole numbers) for which ``is_anchor`` holds.

    A negative's score lies from ``lowest`` to ``highest`` per cent of the positive's.
    """
    spark = rows.sparkSession
    clean = materialize(one_each(rows), "vectors")
    anchors = clean.where(is_anchor)
    kept = materialize(first_copies(clean, max(positives + 1, negatives)), "vector-file")
    cells, n_rows = file_of(kept)
    n_anchors = anchors.count()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n_rows or not n_anchors:
        return empty
    near = searched(kept, anchors, n_rows, n_anchors, _positives(cells, positives), PAIR)
    near = first(near, ["anchor_id"], "score", "other_id", positives).groupBy("anchor_id").agg(F.collect_list(F.struct("other_id", "score")).alias("positives"))
    asked = materialize(anchors.join(near, anchors.vec_id == near.anchor_id).drop("anchor_id"), "anchors")
    n_asked = asked.count()
    if not n_asked:
        return empty
    found = searched(kept, asked, n_rows, n_asked, _negatives(cells, negatives, lowest, highest), NEGATIVE)
    return first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(*empty.columns)


def op13(embeddings: DataFrame) -> DataFrame:
    rows = quantised(embeddings)
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)
