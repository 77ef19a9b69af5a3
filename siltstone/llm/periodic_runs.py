"""Periodic runs of words, by Lyndon arrays on the ordered alphabet of a text's words.

A run is a longest stretch of words that repeats itself at some smallest period at
least twice. Every run holds a Lyndon root: from the leftmost root's start ``i`` the
next smaller suffix lies one period ahead, for one of the two orders of the alphabet
(a text's end is smaller than any word in both). So the runs follow from the edges
(i, next smaller suffix of i): how far the suffixes at both ends agree, and how far
the words before both ends agree, say where the run ends and starts.

``lyndon`` walks a text once from left to right with the stack of smaller suffixes.
Each comparison of suffixes is an edge, and its extension is kept. The stretch that
reaches furthest right copies an earlier one, so a comparison inside it has the
extension of its copy, and words are compared only beyond that stretch: linear time
for any ordered alphabet, without suffix arrays, trees or hashes of substrings.

That walk costs microseconds a word, so texts are first looked at many together:
``unsettled`` finds the same edges for all texts at once by jumping pointers, and
settles texts whose every extension ends within ``CAP`` words and is too short for a
run. Only the others are walked. Both ways give the same runs.

Nulls and empties: a null text has no words; a null doc_id is kept and its text is
judged like any other. Repeated rows are separate rows. Texts are judged whole; a
task holds a batch's texts and the numbers of ``SLICE`` words or of one longer text.
Runs of equal start are ordered by period; no two are equal in both. An empty table
gives no rows. Extra columns are ignored by ``runs`` and ``digests`` and kept by
``collapse``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.common import map_arrow, renamed

#: Words that a run has at least, besides two periods.
LEAST = 12
#: Words whose numbers are held together, words that ``unsettled`` compares at a pair of ends, and its rounds; beyond either a text is walked.
SLICE, CAP, ROUNDS = 1 << 18, 64, 400
END = -1

Run = tuple[int, int, int]


def lyndon(x: list[int]) -> tuple[list[int], list[int]]:
    """Next smaller suffix of every suffix of ``x``, and how many words both share.

    ``x`` ends with a value that is smaller than all others; it has no suffix of its
    own, and as a next smaller suffix it shares nothing.
    """
    n = len(x) - 1
    nss, reach = [n] * n, [0] * n
    pss, back = [-1] * n, [0] * n
    far = box = shift = 0  # x[box:far] equals the same words `shift` earlier, and no match reaches beyond far
    for j in range(1, n):
        i, same, known = j - 1, 0, False
        while True:
            if not known:
                if x[i + same] == x[j + same]:
                    k = same
                    if i >= box and j + k < far:
                        a, b = i - shift, j - shift
                        copy = reach[a] if nss[a] == b else back[b] if pss[b] == a else -1
                        if copy >= 0:
                            k = min(copy, far - j)
                    if j + k >= far or x[i + k] == x[j + k]:
                        while x[i + k] == x[j + k]:
                            k += 1
                    if j + k > far:
                        far, box, shift = j + k, j, j - i
                    same = k
            if x[i + same] < x[j + same]:
                pss[j], back[j] = i, same
                break
            nss[i], reach[i] = j, same
            below, shared = pss[i], back[i]
            if below < 0:
                break
            if same > shared:  # so the word after the shared ones is greater here than at the suffix below
                pss[j], back[j] = below, shared
                break
            i, known = below, same < shared
    return nss, reach


def runs_of(x: list[int], least: int = LEAST) -> list[Run]:
    """(start, length, period) of the runs of numbers of 1 and up, by start and period."""
    found: set[Run] = set()
    top = max(x, default=0) + 1
    for y in ([*x, 0], [*(top - v for v in x), 0]):
        seen = set()
        for i, (j, right) in enumerate(zip(*lyndon(y), strict=True)):
            if right:
                period = j - i
                need = max(least - period, period) - right
                if need < period and (period, j + right) not in seen:
                    seen.add((period, j + right))
                    left = 0
                    while left < i and y[i - 1 - left] == y[j - 1 - left]:
                        left += 1
                    if left >= need:
                        found.add((i - left, left + period + right, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _edges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a joined array that share a word: both ends, words shared; and starts that are left open."""
    after = np.arange(1, len(x) + 1)
    at = np.flatnonzero(x != END)
    found, left = [], []
    for _ in range(ROUNDS):
        if not len(at):
            break
        to = after[at]
        a, b = x[at], x[to]
        done = b < a
        tie = np.flatnonzero(a == b)
        if len(tie):
            i, j = at[tie], to[tie]
            smaller, same, going = np.ones(len(tie), bool), np.zeros(len(tie), np.int64), np.arange(len(tie))
            for k in range(1, CAP):
                u, v = x[i[going] + k], x[j[going] + k]
                off = u != v
                same[going[off]] = k
                smaller[going[off]] = v[off] < u[off]
                going = going[~off]
                if not len(going):
                    break
            left.append(i[going])
            edge = smaller & (same > 0)
            found.append((i[edge], j[edge], same[edge]))
            done[tie] = smaller
        at, to = at[~done], to[~done]
        after[at] = after[to]
    i, j, same = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return i, j, same, np.concatenate([*left, at])


def unsettled(texts: list[np.ndarray], least: int = LEAST) -> list[int]:
    """Which of these arrays of numbers of 1 and up may have a run."""
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    x = np.full(starts[-1] + CAP, END, np.int64)
    for s, t in zip(starts, texts, strict=False):
        x[s : s + len(t)] = t
    top, words = x.max() + 1, x != END
    open_: list[np.ndarray] = []
    for turn in range(2):
        if turn:
            x[words] = top - x[words]
        i, j, right, left = _edges(x)
        need = np.maximum(least - (j - i), j - i) - right
        may = need < j - i
        i, j, need = i[may], j[may], need[may]
        open_ += [left, i[need <= 0]]
        i, j, need = i[need > 0], j[need > 0], need[need > 0]
        for k in range(1, CAP + 1):
            same = x[i - k] == x[j - k]
            i, j, need = i[same], j[same], need[same]
            over = need <= k if k < CAP else np.ones(len(i), bool)
            open_.append(i[over])
            i, j, need = i[~over], j[~over], need[~over]
            if not len(i):
                break
    return np.unique(np.searchsorted(starts, np.concatenate(open_), "right") - 1).tolist()


def runs_of_all(texts: list[list[bytes]], least: int = LEAST) -> list[list[Run]]:
    """The runs of each of many texts of words."""
    number = defaultdict(count(1).__next__)
    ids = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in texts]
    out: list[list[Run]] = [[] for _ in texts]
    for k in unsettled(ids, least):
        out[k] = runs_of(ids[k].tolist(), least)
    return out


def kept(n: int, runs: list[Run]) -> list[tuple[int, int]]:
    """The stretches of ``n`` words that stay when every run keeps its first period only."""
    out, at = [], 0
    for start, stop in sorted((s + p, s + length) for s, length, p in runs):
        if start > at:
            out.append((at, start))
        at = max(at, stop)
    return [*out, (at, n)] if at < n else out


def periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, those of a tenth of all ids with a periodic end: the last ``n - a`` words repeat the first ``p`` of them."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _slices(ids: list, texts: list, prepare: Callable) -> Iterator[tuple[list[list[bytes]], list[list[Run]]]]:
    held, size = [], 0
    for k, text in zip(ids, texts, strict=True):
        held.append(prepare((text or "").encode("utf-8", "surrogatepass").split(), k))
        size += len(held[-1])
        if size >= SLICE:
            yield held, runs_of_all(held)
            held, size = [], 0
    if held:
        yield held, runs_of_all(held)


def _plain(words: list[bytes], _: int | None) -> list[bytes]:
    return words


def runs(docs: DataFrame) -> DataFrame:
    """One row for each run of words of ``docs`` (doc_id, text): doc_id, start, length, period."""

    def rows(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            at = 0
            for held, found in _slices(ids, batch.column("text").to_pylist(), _plain):
                flat = [(ids[at + k], *r) for k, own in enumerate(found) for r in own]
                at += len(held)
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "start", "length", "period"), r, strict=True)) for r in flat], pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "period")]))

    return map_arrow(renamed(docs, doc_id="doc_id", text="text"), rows, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with runs cut down to their first period; the text of a document without runs stays as it is, with its white space."""
    names = docs.columns
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])

    def rows(batches):
        for batch in batches:
            texts, out = batch.column(names.index("text")).to_pylist(), []
            for held, found in _slices(texts, texts, _plain):
                for words, own in zip(held, found, strict=True):
                    out.append(b" ".join(w for a, b in kept(len(words), own) for w in words[a:b]).decode("utf-8", "surrogatepass") if own else texts[len(out)])
            columns = batch.columns
            columns[names.index("text")] = pa.array(out, batch.column(names.index("text")).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, rows, schema)


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(docs: DataFrame) -> DataFrame:
    """A row for each document whose words ``periodic`` has changed: its runs' number, the longest run, and digests of runs and collapsed text."""
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def rows(batches):
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for held, found in _slices(ids, batch.column("text").to_pylist(), periodic):
                for words, own in zip(held, found, strict=True):
                    start, length, period = min(own, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
                    said = "".join(f"{s},{n},{p}\n" for s, n, p in own)
                    rest = b" ".join(w for a, b in kept(len(words), own) for w in words[a:b])
                    out.append((ids[len(out)], len(own), start, length, period, 1000 * length // period if own else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()))
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return map_arrow(renamed(docs, doc_id="doc_id", text="text"), rows, DIGEST)
