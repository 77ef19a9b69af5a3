"""Best-fit packing of token sequences by a configuration linear program.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of
piece lengths, at most ``capacity`` numbers at any input size, reaches the
driver. There multiplicative weights solve the covering program whose columns
are configurations (how many pieces of which lengths share one sequence): each
round prices lengths by how little they are covered, and a knapsack dynamic
program finds the configuration of the highest price. The fractional solution is
rounded to whole copies in a few ways, at any size of the input; what that leaves
is best-fit packed on the histogram, and the way of the fewest sequences is
taken. Pieces then find their places by rank: the r-th piece of a length
takes the r-th slot of that length, so no piece is sent anywhere.

Nulls and empties: a null text counts as empty and packs its end id alone.
Repeated rows are all packed. An empty table gives no rows. Extra columns are
ignored. A text of any length is cut into full pieces, the first may be shorter.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.bpe_words import ended, word_bpe
from siltstone.llm.common import map_arrow, materialize, renamed

#: Rounds of multiplicative weights. It bounds the driver's work, not the result: what a round leaves is best-fit packed.
ROUNDS = 400
#: Learning rate of the weights.
RATE = 0.5
#: Ways to round the fractional solution: the share of it that is taken, what is added before rounding down, and whether
#: only full sequences are. What a share below one leaves keeps short pieces for best fit to close gaps with.
ROUNDINGS = [(share, up, full) for share, up in ((0.95, 0.0), (1.0, 0.0), (1.0, 0.5), (1.0, 0.999)) for full in (True, False)]

Config = tuple[tuple[int, int], ...]
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local long"


def best_configuration(value: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack by dynamic programming: pieces per length, of the highest value that fits ``capacity``.

    ``value`` and ``most`` are by length; a choice beyond ``most`` is trimmed.
    """
    lengths = np.flatnonzero((value > 0) & (most > 0))
    if not len(lengths):
        return {}
    worth = value[lengths]
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            gains = best[c - lengths[:k]] + worth[:k]
            j = int(gains.argmax())
            if gains[j] > best[c]:
                best[c], pick[c] = gains[j], lengths[j]
    out: dict[int, int] = defaultdict(int)
    c = capacity
    while c > 0:
        if n := int(pick[c]):
            out[n] += 1
            c -= n
        else:
            c -= 1
    return {n: min(k, int(most[n])) for n, k in out.items()}


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    """Best-fit decreasing on a histogram: sequences of the same content are one entry with a count."""
    rooms: list[dict[Config, int]] = [defaultdict(int) for _ in range(capacity + 1)]
    done: dict[Config, int] = defaultdict(int)

    def put(config: Config, n: int, room: int) -> None:
        if n:
            (rooms[room] if room else done)[config] += n

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        room = length
        while left and room < capacity:
            if not rooms[room]:
                room += 1
                continue
            config, n = rooms[room].popitem()
            each = room // length
            full = min(n, left // each)
            put((*config, (length, each)), full, room - each * length)
            left -= full * each
            n -= full
            if n and 0 < left < each:
                put((*config, (length, left)), 1, room - left * length)
                n, left = n - 1, 0
            put(config, n, room)
        each = capacity // length
        put(((length, each),), left // each, capacity - each * length)
        if rest := left % each:
            put(((length, rest),), 1, capacity - rest * length)
    return [(config, n) for group in [done, *rooms] for config, n in group.items()]


def fractional(demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[Config, float]:
    """Multiplicative weights: configurations whose fractional copies cover ``demand`` about evenly."""
    lengths = np.arange(capacity + 1)
    step = float(demand @ lengths) / capacity / rounds
    chosen: dict[Config, float] = defaultdict(float)
    if not step:
        return chosen
    covered = np.zeros(capacity + 1)
    need = np.maximum(demand, 1)
    most = np.minimum(demand, np.maximum(demand / step, 1)).astype(np.int64)
    for t in range(1, rounds + 1):
        # lengths that lag behind t / rounds of their demand weigh exponentially more
        lag = t / rounds - covered / need
        weight = np.where(demand > 0, lengths * np.exp(np.clip(RATE * rounds * lag / 8, -30, 30)), 0.0)
        config = best_configuration(weight, most, capacity)
        for length, n in config.items():
            covered[length] += n * step
        chosen[tuple(sorted(config.items(), reverse=True))] += step
    return chosen


def plan(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[Config, int]]:
    """Configurations with copies that hold exactly ``counts[length]`` pieces of each length."""
    demand = np.array(counts, np.int64)
    whole: list[tuple[Config, int]] = [(((capacity, 1),), int(demand[capacity]))] if demand[capacity] else []
    demand[capacity] = 0
    filled = lambda config: sum(length * n for length, n in config)
    order = sorted(fractional(demand, capacity, rounds).items(), key=lambda x: (-filled(x[0]), -x[1], x[0]))
    plans = [best_fit(demand, capacity)]
    for share, up, full in ROUNDINGS if order else []:
        left = demand.copy()
        out: list[tuple[Config, int]] = []
        for config, copies in order:
            copies = min([int(copies * share + up + 1e-9), *(int(left[length]) // n for length, n in config)])
            if copies and not (full and filled(config) < capacity):
                out.append((config, copies))
                for length, n in config:
                    left[length] -= copies * n
        plans.append(out + best_fit(left, capacity))
    return whole + min(plans, key=lambda configs: sum(n for _, n in configs))


def slots(configs: list[tuple[Config, int]]) -> dict[str, np.ndarray]:
    """For each length, its runs of slots in order of rank: first rank, slots a sequence, first sequence, offset."""
    rows = []
    sequence = 0
    for config, copies in configs:
        offset = 0
        for length, n in config:
            rows.append((length, n, sequence, offset, copies * n))
            offset += length * n
        sequence += copies
    rows.sort(key=lambda r: (r[0], r[2]))
    table = np.array(rows, np.int64).reshape(-1, 5)
    ends = np.cumsum(table[:, 4])
    first = ends - table[:, 4]
    starts = np.flatnonzero(np.diff(table[:, 0], prepend=-1))
    base = np.repeat(first[starts], np.diff([*starts, len(table)])) if len(table) else first
    return {"key": table[:, 0] * RANKS + first - base, "rank": first - base, "each": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


RANKS = 1 << 48


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    bpe = word_bpe(tokenizer)
    part = TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    for batch in batches:
        ids, at = ended(*bpe.encode_column(batch.column("text")), end_id)
        ids = ids.astype("<u4")
        rows = []
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            own = ids[at[i] : at[i + 1]]
            cut = 0
            for piece in range(-(-len(own) // capacity)):
                stop = (len(own) - 1) % capacity + 1 + piece * capacity
                rows.append((doc_id, piece, cut, stop - cut, zlib.crc32(own[cut:stop]), part, int(seen[stop - cut])))
                seen[stop - cut] += 1
                cut = stop
        columns = list(zip(*rows, strict=True)) or [()] * 7
        types = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its partition."""
    own = renamed(docs, **{doc_id: "doc_id", text: "text"})
    return map_arrow(own, lambda it: _pieces(it, tokenizer, end_id, capacity), PIECE)


def assign(cut: DataFrame, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to written pieces.

    A piece's rank among all of its length is its rank in its partition plus the
    counts of earlier partitions, so no length's pieces ever meet in one task.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    held = cut.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity, rounds)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    bases = bases.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local")).drop("base", "local", "part")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.searchsorted(table["key"], length * RANKS + rank, "right") - 1
            slot = rank - table["rank"][run]
            each = table["each"][run]
            sequence = table["sequence"][run] + slot // each
            offset = table["offset"][run] + slot % each * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_arrow(ranked, place, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack whole documents; one row per piece with its sequence and its place there."""
    return assign(materialize(pieces(docs, tokenizer, end_id, capacity, doc_id, text), "pieces"), capacity)
