"""Repeated substrings by distributed prefix doubling on an anchored suffix array.

Which bytes lie in a string of ``length`` bytes that also starts earlier? A
suffix array answers this by ranking every start's prefixes at growing offsets.
Here a rank is a 64-bit name: names of 1, 2, 4, ... bytes come from pairs of
names half as long, within a task, as a pair's name needs no sort. Sorting serves
only to find equal ranks, and only starts that may still be repeated go on:

1. Of the ``length``-byte window at each start only the anchor is ranked, the
   place in it whose ``gram``-byte prefix has the least name. Equal windows have
   equal anchors at equal places, so an anchor whose name is unique in the corpus
   settles all its windows (about 35 at the defaults): they are unique.
2. Windows that follow each other and share an anchor are one block. Blocks of
   one anchor name are sorted by the pair of names at both ends, which spell the
   whole block: equal blocks after the first are repeats throughout.
3. For different blocks of one anchor name the ranks grow by half the rest to
   either side; windows on a side that is unique there are unique.
4. What is left is ranked start by start, by the pair of names that covers all
   ``length`` bytes. Spark sorts these pairs; every start but the first of its
   rank is a repeat.

Every task first does steps 2 and 4 on its own rows and sends on one row for each
rank, so copies by the thousand reach the exchange as one row a task. Names are
64 bits, and rows are taken for equal on 96 bits or more.

Nulls and empties: a null text is empty; texts shorter than ``length`` lose
nothing. Matches never cross documents. A row is known by its doc_id and a hash
of its text, and documents are in the order of these two: of rows that share a
doc_id and differ the one of the smaller hash is the earlier, and rows equal in
both are one document, keep the same and don't repeat each other. A null doc_id
sorts first. Texts of any length are judged whole, in overlapping slices. An
empty table gives no rows. Extra columns are ignored, or kept where texts are
cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import map_arrow, materialize, renamed

#: Text bytes whose names are held at once, and block rows that are combined at once.
SLICE, COMBINE = 2 << 20, 400_000
#: Different blocks of one anchor name in one task beyond which they go to step 4 without step 3.
MANY = 64
#: Rows of one anchor name that the receiving task holds; of a longer run every block goes to step 4 without step 3.
HELD = 1 << 20
LEAST = -(1 << 63)
REP, GONE, OPEN, SEEN = 0, 1, 2, 3

U = np.uint64
LETTERS = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two names in a row."""
    x = a * U(0x9E3779B97F4A7C15)
    x += b * U(0xC2B2AE3D27D4EB4F)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


class Layout:
    """How a block's row packs its start (31 bits), its windows' number, its anchor's place, bits of both contexts, and its kind."""

    def __init__(self, length: int):
        if not 4 <= length < 1 << 14:
            raise ValueError("length must be from 4 to 16383")
        self.size = max(7, length.bit_length())
        self.context = (29 - 2 * self.size) // 2 if self.size > 7 else 8

    def pack(self, start: np.ndarray, n: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        most = U((1 << self.context) - 1)
        out = start << self.size | n
        out = out << self.size | x
        out = out << self.context | (left & most).astype(np.int64)
        return (out << self.context | (right & most).astype(np.int64)) << 2

    def start(self, place: np.ndarray) -> np.ndarray:
        return place >> 2 + 2 * (self.context + self.size)

    def n(self, place: np.ndarray) -> np.ndarray:
        return place >> 2 + 2 * self.context + self.size & (1 << self.size) - 1

    def x(self, place: np.ndarray) -> np.ndarray:
        return place >> 2 + 2 * self.context & (1 << self.size) - 1

    def left(self, place: np.ndarray) -> np.ndarray:
        return place >> 2 + self.context & (1 << self.context) - 1

    def right(self, place: np.ndarray) -> np.ndarray:
        return place >> 2 & (1 << self.context) - 1


class Names:
    """Names of all starts of a byte array, doubled up to ``gram`` and twice that."""

    def __init__(self, data: np.ndarray, length: int):
        self.length = length
        self.gram = 1 << (length // 2).bit_length() - 1
        self.side = (length - self.gram) // 2
        names, h = LETTERS[data], 1
        while h < self.gram:
            names, h = pair(names[:-h], names[h:]), 2 * h
        self.short = names
        self.long = pair(names[:-h], names[h:])

    def whole(self, at: np.ndarray) -> np.ndarray:
        """Of ``length`` bytes."""
        return pair(self.long[at], self.long[at + (self.length - 2 * self.gram)])

    def context(self, at: np.ndarray) -> np.ndarray:
        """Of ``gram + side`` bytes; starts out of range have none."""
        size = self.gram + self.side
        first = self.short if size <= 2 * self.gram else self.long
        ok = (at >= 0) & (at + size - self.gram < len(self.short)) & (at < len(first))
        at = np.where(ok, at, 0)
        return np.where(ok, pair(first[at], self.short[np.minimum(at + size - self.gram, len(self.short) - 1)]), U(0))

    def anchors(self) -> np.ndarray:
        """For each window, the place of its least short name, the first of equals."""
        n = len(self.short)
        least = (self.short & ~U(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
        w, h = self.length - self.gram + 1, 1
        while h * 2 <= w:
            least, h = np.minimum(least[:-h], least[h:]), 2 * h
        if w > h:
            least = np.minimum(least[: h - w], least[w - h :])
        return (least & U(0xFFFFFF)).astype(np.int64)


def slices(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A column's bytes about SLICE at a time: bytes, and for each text in it the row, its first byte there, its first byte in the text.

    The last number of the second array is the end. A text longer than a slice is
    cut where the next slice's windows begin.
    """
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        if offsets[row + 1] - offsets[row] > SLICE:
            for at in range(0, offsets[row + 1] - offsets[row] - length + 1, SLICE):
                stop = min(offsets[row] + at + SLICE + length - 1, offsets[row + 1])
                yield data[offsets[row] + at : stop], np.array([row]), np.array([0, stop - offsets[row] - at]), np.array([at])
            row += 1
            continue
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        yield data[offsets[row] : offsets[stop]], np.arange(row, stop), offsets[row : stop + 1] - offsets[row], np.zeros(stop - row, np.int64)
        row = stop


def _blocks(data: np.ndarray, bounds: np.ndarray, base: np.ndarray, length: int, layout: Layout) -> tuple[np.ndarray, ...]:
    """A slice's blocks: anchor name, block name, text in the slice, and the packed place."""
    names = Names(data, length)
    anchor = names.anchors()
    open_ = np.zeros(len(data) + 1, np.int32)
    long_enough = np.diff(bounds) >= length
    np.add.at(open_, bounds[:-1][long_enough], 1)
    np.add.at(open_, bounds[1:][long_enough] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(open_)[: len(anchor)] > 0)
    at = anchor[start]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])) if len(start) else start
    lo, x = start[first], at[first]
    n = np.diff(np.append(first, len(start)))
    block = pair(pair(names.whole(lo), names.whole(lo + n - 1)), ((x - lo) << 20 | n).astype(np.uint64))
    text = np.searchsorted(bounds, lo, "right") - 1
    place = layout.pack(lo - bounds[text] + base[text], n, x - lo, names.context(x - names.side), names.context(x))
    return names.short[x], block, text, place


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where any key differs from the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _mark(start: np.ndarray, n: np.ndarray, kind: int) -> np.ndarray:
    return start << 32 | n << 2 | kind


Rows = list[np.ndarray]


def _settle(rows: Rows, layout: Layout, side: int, final: bool, hot: bool = False) -> tuple[np.ndarray, ...]:
    """Steps 2 and 3 on rows (fp, bh, d, e, place) in that order.

    Returns which rows are repeats, which stay representatives, and marks (d, e,
    mark) of windows for step 4. Before the exchange (``final`` false) step 3 is
    left to it. All rows of a ``hot`` run go to step 4.
    """
    fp, bh, d, e, place = rows
    run = _runs(fp)
    new = run | _runs(bh)
    head = np.maximum.accumulate(np.where(new, np.arange(len(fp)), 0))
    start = layout.start(place)
    gone = ~new & ((d != d[head]) | (e != e[head]) | (start != start[head]))
    run_no = np.cumsum(run) - 1
    classes = np.bincount(run_no, weights=new).astype(np.int64) if len(fp) else np.zeros(0, np.int64)
    seen = np.bincount(run_no, weights=(place & 3) == SEEN) > 0 if len(fp) else np.zeros(0, bool)
    lead = new & ((place & 3) != SEEN)
    many = classes[run_no] > (1 if final else MANY)
    if not final or hot:
        i = np.flatnonzero(lead & (many | hot))
        return gone, lead & ~many, d[i], e[i], _mark(start[i], layout.n(place[i]), OPEN), fp[i[_runs(run_no[i])]] if len(i) else fp[:0]
    i = np.flatnonzero(lead & (many | seen[run_no]))
    r, p = run_no[i], place[i]
    x, n, lo = layout.x(p), layout.n(p), start[i]

    def shared(context: np.ndarray) -> np.ndarray:
        key = r << layout.context | context
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key), bool)
        eq = key[order][1:] == key[order][:-1]
        same[order[1:]] |= eq
        same[order[:-1]] |= eq
        return same | seen[r]

    cut = np.clip(x - side + 1, 0, n)  # windows that begin at least ``side`` before the anchor
    left, right = shared(layout.left(p)) & (cut > 0), shared(layout.right(p)) & (cut < n)
    marks = np.concatenate([_mark(lo[left], cut[left], OPEN), _mark((lo + cut)[right], (n - cut)[right], OPEN)])
    both = lambda c: np.concatenate([c[i][left], c[i][right]])
    return gone, lead, both(d), both(e), marks, fp[:0]


def _scatter(d: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """An even exchange key for rows that only pass through."""
    return pair(d.view(np.uint64), mark.view(np.uint64)).view(np.int64)


ROW = "fp long, bh long, d long, e long, place long"
ROW_NAMES = ["fp", "bh", "d", "e", "place"]


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _send(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Anchored blocks of whole texts, combined within the task."""
    held: list[tuple[np.ndarray, ...]] = []
    layout = Layout(length)

    def combined() -> pa.RecordBatch:
        rows = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        order = np.lexsort(rows[::-1])
        rows = [c[order] for c in rows]
        gone, stay, open_d, open_e, open_mark, seen = _settle(rows, layout, 0, False)
        fp, bh, d, e, place = rows
        lost = _merged(d[gone], e[gone], layout.start(place[gone]), layout.n(place[gone]))
        pass_d, pass_e, passing = (np.concatenate(c) for c in zip(lost, (open_d, open_e, open_mark), strict=True))
        none, skip = np.zeros(len(seen), np.int64), np.zeros(len(passing), np.int64)
        return _batch(
            [
                np.concatenate([fp[stay].view(np.int64), seen.view(np.int64), _scatter(pass_d, passing)]),
                np.concatenate([bh[stay].view(np.int64), none, skip]),
                np.concatenate([d[stay], none + LEAST, pass_d]),
                np.concatenate([e[stay], none + LEAST, pass_e]),
                np.concatenate([place[stay], none + SEEN, passing]),
            ],
            ROW_NAMES,
        )

    n = 0
    for batch in batches:
        d, e = batch.column("d").to_numpy(), batch.column("e").to_numpy()
        for data, rows, bounds, base in slices(batch.column("text"), length):
            if len(data) < length:
                continue
            fp, bh, text, place = _blocks(data, bounds, base, length, layout)
            held.append((fp, bh, d[rows[text]], e[rows[text]], place))
            n += len(fp)
            if n >= COMBINE:
                yield combined()
                n = 0
    if n:
        yield combined()


def _merged(d: np.ndarray, e: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of repeats, those that follow each other in a document made one."""
    order = np.lexsort((start, e, d))
    d, e, start, n = d[order], e[order], start[order], n[order]
    new = _runs(d, e)
    new[1:] |= start[1:] > start[:-1] + n[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1 if len(d) else first
    return d[first], e[first], _mark(start[first], start[last] + n[last] - start[first], GONE)


MARK = "d long, e long, mark long"
MARK_NAMES = ["d", "e", "mark"]


def _receive(batches: Iterator[pa.RecordBatch], length: int, side: int) -> Iterator[pa.RecordBatch]:
    """Steps 2 and 3 on a sorted partition, of which at most HELD rows and a batch are held."""
    layout = Layout(length)
    held = [np.zeros(0, np.int64)] * 5
    hot = False  # the run held is the rest of one that was too long

    def marks(rows: Rows, hot: bool) -> pa.RecordBatch:
        gone, _, open_d, open_e, open_mark, _ = _settle(rows, layout, side, True, hot)
        _, _, d, e, place = rows
        lost = _mark(layout.start(place[gone]), layout.n(place[gone]), GONE)
        return _batch([np.concatenate([d[gone], open_d]), np.concatenate([e[gone], open_e]), np.concatenate([lost, open_mark])], MARK_NAMES)

    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in ROW_NAMES]
        kind = rows[4] & 3
        passing = (kind == GONE) | (kind == OPEN)
        yield _batch([c[passing] for c in rows[2:]], MARK_NAMES)
        rows = [np.concatenate([h, r[~passing]]) for h, r in zip(held, rows, strict=True)]
        first = np.flatnonzero(_runs(rows[0]))
        if hot and len(first) > 1:
            yield marks([r[: first[1]] for r in rows], True)
            rows = [r[first[1] :] for r in rows]
            first = first[1:] - first[1]
            hot = False
        last = first[-1] if len(first) else 0
        if last:
            yield marks([r[:last] for r in rows], False)
        held = [r[last:] for r in rows]
        if len(held[0]) > HELD:
            yield marks(held, True)
            # its last block's first row tells later repeats; marking that row once more changes nothing
            head = np.flatnonzero(_runs(held[0], held[1]))[-1:]
            held, hot = [h[head] for h in held], True
    if len(held[0]):
        yield marks(held, hot)


WINDOW = "r1 long, r2 int, d long, e long, mark long"
WINDOW_NAMES = ["r1", "r2", "d", "e", "mark"]


def _rank(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The whole ranks of the windows that are still open, combined within the task."""
    held: list[tuple[np.ndarray, ...]] = []

    def combined() -> pa.RecordBatch:
        r1, r2, d, e, start = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((start, e, d, r2, r1))
        r1, r2, d, e, start = r1[order], r2[order], d[order], e[order], start[order]
        gone, new = _later(r1, r2, d, e, start)
        pass_d, pass_e, passing = _merged(d[gone], e[gone], start[gone], np.ones(gone.sum(), np.int64))
        return _batch(
            [
                np.concatenate([r1[new], _scatter(pass_d, passing)]),
                np.concatenate([r2[new], np.zeros(len(passing), np.int32)]),
                np.concatenate([d[new], pass_d]),
                np.concatenate([e[new], pass_e]),
                np.concatenate([_mark(start[new], 1, REP), passing]),
            ],
            WINDOW_NAMES,
        )

    n = 0
    for batch in batches:
        d, e = batch.column("d").to_numpy(), batch.column("e").to_numpy()
        marks = batch.column("marks")
        mark_ends = marks.offsets.to_numpy().astype(np.int64) - marks.offsets[0].as_py()
        mark = marks.flatten().to_numpy()
        for data, rows, bounds, base in slices(batch.column("text"), length):
            if len(data) < length:
                continue
            names = Names(data, length)
            a, b = mark_ends[rows[0]], mark_ends[rows[-1] + 1]
            text = np.repeat(np.arange(len(rows)), np.diff(mark_ends[rows[0] : rows[-1] + 2]))
            count = mark[a:b] >> 2 & (1 << 30) - 1
            text = np.repeat(text, count)
            start = np.repeat(mark[a:b] >> 32, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = start - base[text] + bounds[text]
            here = (at >= bounds[text]) & (at + length <= bounds[text + 1])
            text, start, at = text[here], start[here], at[here]
            one, two = names.long[at], names.long[at + (length - 2 * names.gram)]
            held.append((pair(one, two).view(np.int64), (pair(two, one) >> U(33)).astype(np.int32), d[rows[text]], e[rows[text]], start))
            n += len(at)
            if n >= 2 * COMBINE:
                yield combined()
                n = 0
    if n:
        yield combined()


def _later(r1: np.ndarray, r2: np.ndarray, d: np.ndarray, e: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted ranked starts: those after the first of their rank, and the first ones."""
    new = _runs(r1, r2)
    head = np.maximum.accumulate(np.where(new, np.arange(len(r1)), 0))
    return ~new & ((d != d[head]) | (e != e[head]) | (start != start[head])), new


def _rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64, np.int64)]
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in WINDOW_NAMES]
        passing = rows[4] & 3 == GONE
        yield _batch([c[passing] for c in rows[2:]], MARK_NAMES)
        rows = [np.concatenate([h, r[~passing]]) for h, r in zip(held, rows, strict=True)]
        gone, new = _later(*rows)
        yield _batch([rows[2][gone], rows[3][gone], rows[4][gone] | GONE], MARK_NAMES)
        last = np.flatnonzero(new)[-1:]  # only a rank's first row is needed to know the rest by
        held = [c[last] for c in rows]


def repeats(docs: DataFrame, length: int) -> DataFrame:
    """d, e, marks: for each document with repeats, the runs of starts whose windows also start earlier."""
    Layout(length)
    side = (length - (1 << (length // 2).bit_length() - 1)) // 2
    blocks = map_arrow(docs, lambda it: _send(it, length), ROW)
    sorted_blocks = blocks.repartition("fp").sortWithinPartitions(*ROW_NAMES)
    marks = materialize(map_arrow(sorted_blocks, lambda it: _receive(it, length, side), MARK), "marks")
    todo = marks.where(F.col("mark").bitwiseAND(F.lit(3)) == OPEN).groupBy("d", "e").agg(F.collect_list("mark").alias("marks"))
    starts = map_arrow(docs.join(todo, ["d", "e"]).select("d", "e", "text", "marks"), lambda it: _rank(it, length), WINDOW)
    ranked = starts.repartition("r1").sortWithinPartitions(*WINDOW_NAMES)
    later = materialize(map_arrow(ranked, _rerank, MARK), "later")
    gone = marks.where(F.col("mark").bitwiseAND(F.lit(3)) == GONE).unionByName(later)
    return gone.groupBy("d", "e").agg(F.collect_list("mark").alias("marks"))


def _removed(n: int, marks: np.ndarray | None, length: int) -> np.ndarray:
    """Which of a text's n bytes are covered."""
    if marks is None or not len(marks):
        return np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int32)
    start = np.minimum(marks >> 32, n)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + (marks >> 2 & (1 << 30) - 1) + length - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray | None]]:
    for text, marks in zip(batch.column("text"), batch.column("marks"), strict=True):
        buffer = text.as_buffer()
        yield (buffer.to_pybytes() if buffer else b""), (marks.values.to_numpy() if marks.is_valid else None)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """d, e, text, doc_id: rows by doc_id and a hash of the text."""
    own = renamed(docs, **{doc_id: "doc_id", text: "text"})
    whole = F.coalesce("text", F.lit(""))
    return own.select(F.coalesce("doc_id", F.lit(LEAST)).alias("d"), F.xxhash64(whole).alias("e"), whole.alias("text"), "doc_id")


def digests(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What each document loses and a digest of what it keeps."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for data, marks in _texts(batch):
                gone = _removed(len(data), marks, length)
                n = int(gone.sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if n else data
                spans = int(gone[0]) + np.count_nonzero(gone[1:] & ~gone[:-1]) if n else 0
                for column, value in zip(out, (len(data), n, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = keyed(docs, doc_id, text)
    found = repeats(own.select("d", "e", "text"), length)
    return map_arrow(own.join(found, ["d", "e"], "left").select("doc_id", "text", "marks"), rows, DIGEST)


def cut_texts(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut from its texts; bytes of a character that was cut through go too.

    Null texts stay null. All other columns are kept as they are.
    """
    found = repeats(keyed(docs, doc_id, text).select("d", "e", "text"), length)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own_key = F.coalesce(F.col(f"`{doc_id}`"), F.lit(LEAST)).alias("d"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("e")
    joined = docs.select(row, *own_key).join(found, ["d", "e"], "left").select("row", "marks")
    place = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("row").flatten()
            texts = columns[place].to_pylist()
            for i, marks in enumerate(batch.column("marks")):
                if marks.is_valid and texts[i]:
                    data = np.frombuffer(texts[i].encode(), np.uint8)
                    texts[i] = data[~_removed(len(data), marks.values.to_numpy(), length)].tobytes().decode(errors="ignore")
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, docs_names)

    docs_names = docs.columns
    return map_arrow(joined, rows, docs.schema)
