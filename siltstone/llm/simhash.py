"""SimHash near-duplicates found by covering locality-sensitive hashing.

Every bit place is given a non-zero vector of radius + 1 bits. For each non-zero
vector v there is one table, keyed by the fingerprint's bits whose vectors have an
odd product with v. Any ``radius`` differing places span less than the whole
space, so some v is orthogonal to all of them and that table's key has none of
them: every pair within the radius meets in at least one of 2^(radius+1) - 1
tables, and pairs that meet are compared in full. No link is lost or guessed.

Tables hold distinct fingerprints only, range-sorted by (table, key,
fingerprint), so a large bucket spreads over several tasks; its blocks are then
compared pair by pair, the pairs dealt out by their blocks. Tasks emit spanning
forests, never all pairs. Components come from alternating large and small stars
on written tables; what a large component is joined with is written first, so
Spark broadcasts it if it is small and can split the join if not.

Nulls and empties: a text without words, or null, has fingerprint zero and is
linked like any other. Repeated rows are separate rows of one fingerprint; where
one row of a group stays, rows are told apart by doc_id and text, and of rows
equal in both any one stays. A null doc_id is no representative, and its rows
stay. An empty table gives no rows. Extra columns are ignored, or kept with the
rows that stay. Texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import discard, map_arrow, materialize, renamed

BITS = 64
SEED = 42
#: Fingerprints that are compared in memory at once.
BLOCK = 16_384


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The tables' masks: 2^(radius+1) - 1 sets of places, about half of them each."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of lower-cased words' shingles, repeats included; fewer words are one shingle, none gives none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)], np.uint64)


def _print(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int) -> int:
    """Of lower-cased words' shingles, repeats included; fewer words are one shingle, none gives zero."""
    return _print(shingles(text, shingle))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint as a signed 64-bit number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(fingerprint(t, shingle)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("e"), pa.array(prints, pa.int64())], ["doc_id", "e", "fp"])

    own = renamed(docs, **{doc_id: "doc_id", text: "text"}).withColumn("e", F.xxhash64("text"))
    return map_arrow(own, rows, "doc_id long, e long, fp long")


def forest(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that span the components of distinct fingerprints under distance <= radius.

    Each member is compared with those not reached yet, so a dense bucket costs little more than its size.
    """
    bits = x.view(np.uint64)
    left = np.arange(len(x))
    edges = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                edges.extend((int(x[j]), int(x[at])) for j in found)
    return edges


FOUND = "a long, b long, t int, key long, members array<long>"
FOUND_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("t", pa.int32()), ("key", pa.int64()), ("members", pa.list_(pa.int64()))])


def _found(edges: list[tuple[int, int]], blocks: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    none_e, none_b = [None] * len(edges), [None] * len(blocks)
    columns = [
        [a for a, _ in edges] + none_b,
        [b for _, b in edges] + none_b,
        none_e + [t for t, _, _ in blocks],
        none_e + [k for _, k, _ in blocks],
        none_e + [m for _, _, m in blocks],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND_ARROW, strict=True)], schema=FOUND_ARROW)


def _buckets(batches: Iterator[pa.RecordBatch], radius: int, block: int) -> Iterator[pa.RecordBatch]:
    """Links within the runs of one (table, key) of a sorted partition.

    A run that may go on in another partition, or is longer than a block, is also
    handed on as blocks.
    """
    t = key = fp = np.zeros(0, np.int64)
    open_run = True  # the first run may have begun in the partition before
    for batch in batches:
        t = np.concatenate([t, batch.column("t").to_numpy()])
        key = np.concatenate([key, batch.column("key").to_numpy()])
        fp = np.concatenate([fp, batch.column("fp").to_numpy()])
        starts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])]))
        sizes = np.diff(starts)  # the last run stays
        edges: list[tuple[int, int]] = []
        blocks: list[tuple[int, int, np.ndarray]] = []
        if len(sizes) and open_run:
            blocks.append((int(t[0]), int(key[0]), fp[: sizes[0]]))
            open_run = False
        two = starts[:-1][sizes == 2]
        two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius]
        edges.extend(zip(fp[two + 1].tolist(), fp[two].tolist(), strict=True))
        for i in np.flatnonzero(sizes > 2):
            edges.extend(forest(fp[starts[i] : starts[i] + sizes[i]], radius))
        last = starts[-1] if len(starts) else 0
        while len(fp) - last > block:
            blocks.append((int(t[last]), int(key[last]), fp[last : last + block]))
            edges.extend(forest(blocks[-1][2], radius))
            last += block
            open_run = True  # the rest of this run belongs to those blocks
        t, key, fp = t[last:], key[last:], fp[last:]
        if edges or blocks:
            yield _found(edges, blocks)
    if len(fp):
        yield _found(forest(fp, radius), [(int(t[0]), int(key[0]), fp)])


def links(prints: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that span the components of the distinct values of ``fp`` under the radius."""
    distinct = prints.select("fp").distinct()
    keyed = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks(radius))])
    spread = distinct.select("fp", F.explode(keyed).alias("k")).select(F.col("k.t").alias("t"), F.col("k.key").alias("key"), "fp")
    ordered = spread.repartitionByRange("t", "key", "fp").sortWithinPartitions("t", "key", "fp")
    found = materialize(map_arrow(ordered, lambda it: _buckets(it, radius, block), FOUND), "links")
    blocks = found.where("members is not null").select("t", "key", "members")
    # a block is named by its first member; only names are paired by bucket, members come to each pair by name
    one = blocks.select("t", "key", F.col("members")[0].alias("x"), F.col("members").alias("one"))
    other = one.withColumnsRenamed({"x": "y", "one": "other"})
    names = materialize(one.select("t", "key", "x").join(other.select("t", "key", "y"), ["t", "key"]).where("x < y"), "block-pairs")
    pairs = names.join(one, ["t", "key", "x"]).join(other, ["t", "key", "y"]).select("one", "other")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                both = np.concatenate([batch.column(c)[i].values.to_numpy() for c in ("one", "other")])
                edges = forest(both, radius)
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return found.where("a is not null").select("a", "b").unionByName(map_arrow(pairs, cross, "a long, b long")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; the root is the component's smallest node.

    Alternating large and small stars; each round is a written table. A hub's
    edges are aggregated before they move, and its least neighbour is written
    before it is joined, so Spark can broadcast that or split a hub's partition.
    """
    up = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = materialize(edges.where("a != b").select(*up).distinct(), "edges")
    for _ in range(most_rounds):
        ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionAll(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if open_ends.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))  # few rows for each: after large stars only local minima have many
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def rooted(rows: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """``rows`` with root, the component of their ``key`` under the edges, and component_id, its smallest doc_id."""
    roots = components(edges).withColumnRenamed("node", key)
    least = rows.groupBy(key).agg(F.min("doc_id").alias("least")).join(roots, key, "left")
    least = materialize(least.withColumn("root", F.coalesce("root", key)), "rooted")
    heads = materialize(least.groupBy("root").agg(F.min("least").alias("component_id")), "heads")
    classes = materialize(least.join(heads, "root").select(key, "root", "component_id"), "classes")
    return rows.join(classes, key)


def one_of_each(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row for each root in ``groups`` (doc_id, e, root): the smallest doc_id's, of these the smallest hash's."""
    named = groups.where("doc_id is not null")
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", "e")).alias("k")).select(F.col("k.doc_id").alias("d"), F.col("k.e").alias("e"))
    first = materialize(first.distinct(), "first")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(f"`{doc_id}`").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("e"))
    again = named.select(F.col("doc_id").alias("d"), "e").join(first, ["d", "e"], "left_semi").groupBy("d", "e").count().where("count > 1").select("d", "e")
    again = materialize(again, "again")
    kept = keyed.join(first, ["d", "e"], "left_semi")
    if not again.isEmpty():
        kept = kept.join(again, ["d", "e"], "left_anti").unionByName(keyed.join(again, ["d", "e"], "left_semi").dropDuplicates(["d", "e"]))
    return kept.unionByName(keyed.where("d is null")).select("row.*")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """doc_id, e, fp, root, component_id (the smallest doc_id reachable) for every row of ``docs``."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    return rooted(prints, "fp", links(prints, radius, block))


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id. Rows of a null doc_id stay."""
    return one_of_each(docs, near_duplicates(docs, shingle, radius))


def op2(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs, shingle=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Shared prefix shingles that a pair of similar sets has at least, where the sets are that large.
SHARED = 4
#: Texts that are sampled for the order of shingles, and how often a frequent one occurs in them.
SAMPLED, FREQUENT, MOST_FREQUENT = 10_000, 8, 500_000
SETS = "doc_id long, e long, sid long, fp long, n int, shingles array<long>"
#: Sets of the largest component that the others are tried with for their many links, and how often.
HUBS, STARS = 2, 1
#: Pairs that a task gives out at once.
PAIRS = 200_000
#: Sets of one shingle that are compared in memory at once; more are dealt into blocks, and pairs of blocks are compared.
BUCKET = 4096


#: Bits of the filter that spares texts without candidates the hashing.
FILTER = 1 << 24


def _filter(hashes: DataFrame) -> np.ndarray:
    """Words with the bits of these texts' hashes ``e`` set; the driver gets at most FILTER / 32 rows."""
    place = F.col("e").bitwiseAND(F.lit(FILTER - 1))
    words = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER // 32, np.uint32)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def _sets(docs: DataFrame, shingle: int, only: np.ndarray | None = None) -> DataFrame:
    """Every row's set of shingles, the set's own hash and the fingerprint; with a filter, at least of the texts in it, each once a task.

    The filter is asked before a text is hashed, so texts without candidates cost a look.

    Sets take more room than texts, so they are computed again where they are needed and never written whole.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                if only is not None:
                    e = part.column("e").to_numpy()
                    place = e & (FILTER - 1)
                    inside = (only[place >> 5] >> (place & 31).astype(np.uint32) & 1).astype(bool)
                    part = part.filter(pa.array(inside))
                    part = part.filter(pa.array(_unseen(part.column("e").to_pylist(), seen)))
                hashes = [shingles(t, shingle) for t in part.column("text").to_pylist()]
                sets = [np.unique(h) for h in hashes]
                columns = [
                    part.column("doc_id"),
                    part.column("e"),
                    pa.array([_signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in sets], pa.int64()),
                    pa.array([_signed(_print(h)) for h in hashes], pa.int64()),
                    pa.array(list(map(len, sets)), pa.int32()),
                    pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "e", "sid", "fp", "n", "shingles"])

    return map_arrow(renamed(docs, doc_id="doc_id", text="text").withColumn("e", F.xxhash64("text")), rows, SETS)


def _unseen(sids: list[int], seen: set[int]) -> np.ndarray:
    """Which of a task's sets come for the first time; exact copies of a text then cost one row a task."""
    new = np.zeros(len(sids), bool)
    for i, sid in enumerate(sids):
        if sid not in seen:
            seen.add(sid)
            new[i] = True
    return new


def _least_shared(n, tenths: int):
    """The least overlap that a set of n has with a set of that similarity, in whole numbers."""
    return (n * tenths + 9) // 10


def _shared(docs: DataFrame, total: int, shingle: int, tenths: int) -> DataFrame:
    """(h, sid, pos): the shingles in the prefixes of two distinct sets or more, and their place in the set's order.

    Shingles have one order for all sets, frequent ones last; any order is exact.
    Two sets of the similarity have SHARED shingles (or as many as the smaller
    bound allows) in common among the first n - bound + SHARED of each. Of the k-th that
    they have in common both have at least overlap - k + 1 left, itself among them, so a
    shingle further back needn't pair them.
    """
    share = min(1.0, SAMPLED / max(1, total))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    often = _sets(sample, shingle).select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "h").limit(MOST_FREQUENT)
    frequent = np.sort(often.select("h").toArrow().column("h").to_numpy())

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                part = part.filter(pa.array(_unseen(part.column("sid").to_pylist(), seen)))
                firsts = []
                for x in part.column("shingles"):
                    x = x.values.to_numpy()
                    if len(frequent) and len(x):
                        late = frequent[np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)] == x
                        x = np.concatenate([x[~late], x[late]])
                    bound = _least_shared(len(x), tenths)
                    firsts.append(x[: len(x) - bound + min(SHARED, bound)])
                sizes = np.array([len(x) for x in firsts], np.int64)
                sids = np.repeat(part.column("sid").to_numpy(), sizes)
                pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*firsts, np.zeros(0, np.int64)])), pa.array(sids), pa.array(pos.astype(np.int32))], ["h", "sid", "pos"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, sid, pos = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        for batch in _then_none(batches):
            if batch is not None:
                h, sid, pos = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((h, "h"), (sid, "sid"), (pos, "pos")))
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])])[: len(h)]
                h, sid, pos = h[new], sid[new], pos[new]
            whole = len(h) if batch is None else int(np.searchsorted(h, h[-1])) if len(h) else 0
            x, y, z = h[:whole], sid[:whole], pos[:whole]
            h, sid, pos = h[whole:], sid[whole:], pos[whole:]
            same = x[1:] == x[:-1]
            several = np.concatenate([[False], same])[: len(x)] | np.concatenate([same, [False]])[: len(x)]
            yield pa.RecordBatch.from_arrays([pa.array(x[several]), pa.array(y[several]), pa.array(z[several])], ["h", "sid", "pos"])

    pieces = map_arrow(_sets(docs, shingle).select("sid", "shingles"), prefixes, "h long, sid long, pos int")
    return map_arrow(pieces.repartition("h").sortWithinPartitions("h", "sid"), runs, "h long, sid long, pos int")


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity is at least that, counted exactly on the sets, which are computed for these pairs only."""
    pairs = materialize(pairs, "candidates")
    if pairs.isEmpty():
        return pairs
    ends = materialize(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), "ends")
    texts = rows.select("e", "sid").join(ends, "sid", "left_semi").groupBy("sid").agg(F.min("e").alias("e"))  # one text of each set is enough
    sets = _sets(docs, shingle, _filter(texts)).select("sid", "shingles").join(ends, "sid", "left_semi").dropDuplicates(["sid"])
    sets = materialize(sets, "compared")
    one = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(one, "a").join(other, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    verified = materialize(both.where(F.col("common") * 10 >= tenths * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b"), "verified")
    discard(pairs, ends, sets)
    return verified


def _buckets_of(shared: DataFrame, named: DataFrame, stars: bool) -> DataFrame:
    """m: the sets (sid, root, fp, n, block, degree, pos) of one shingle, or of a pair of its blocks, where they are of different components.

    A shingle of more than BUCKET sets has them dealt into blocks, each of which
    meets every other block (with ``stars`` only itself).
    """
    hot = shared.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > BUCKET)
    hot = materialize(hot.select("h", F.ceil(F.col("c") / BUCKET).cast("int").alias("k")), "hot")
    members = shared.join(named, "sid").join(hot, "h", "left").withColumn("block", F.pmod(F.xxhash64("sid"), F.coalesce("k", F.lit(1))).cast("int"))
    others = F.array("block") if stars else F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)
    members = members.withColumn("other", F.explode(others))
    group = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    dealt = members.select("h", *group, "root", F.struct("sid", "root", "fp", "n", "block", "degree", "pos").alias("one"))
    return dealt.groupBy("h", "i", "j").agg(F.collect_list("one").alias("m"), F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("m")


class _Pairs:
    """Pairs of a batch's sets, given out in few record batches."""

    def __init__(self, sid: np.ndarray, bound: np.ndarray):
        self.sid, self.bound, self.rows = sid, bound, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, one: np.ndarray, other: np.ndarray) -> None:
        self.parts.append((one, other))
        self.rows += len(one)

    def taken(self) -> pa.RecordBatch:
        one, other = (np.concatenate([p[k] for p in self.parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
        self.parts, self.rows = [], 0
        a, b = np.minimum(self.sid[one], self.sid[other]), np.maximum(self.sid[one], self.sid[other])
        need = np.minimum(SHARED, np.minimum(self.bound[one], self.bound[other]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(need)], ["a", "b", "need"])


def _pairs(shared: DataFrame, named: DataFrame, roots: DataFrame, links_: DataFrame, tenths: int, stars: bool) -> DataFrame:
    """Pairs of different components that share a prefix shingle: all that the sizes allow, or each with some of the largest component.

    These are the nearest by fingerprint and the HUBS with the most links (a, b) so far:
    copies with edits of their own are often nearer to what they were copied from than to each other.
    """
    degrees = links_.select(F.col("a").alias("sid")).unionAll(links_.select(F.col("b").alias("sid"))).groupBy("sid").agg(F.count("*").alias("degree"))
    named = named.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = named.join(degrees, "sid", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("m")
            flat = lists.flatten()
            sid, root, fp, n, block, degree, pos = (flat.field(c).to_numpy().astype(np.int64) for c in ("sid", "root", "fp", "n", "block", "degree", "pos"))
            bound = _least_shared(n, tenths)
            sizes = lists.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            two = starts[sizes == 2]

            def fitting(i, j, root=root, n=n, bound=bound, pos=pos):
                """Different components, sizes near enough, and early enough to be one of a similar pair's first SHARED common shingles."""
                overlap = -(-tenths * (n[i] + n[j]) // (10 + tenths))
                early = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= overlap - (SHARED - 1)
                return (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= np.maximum(bound[i], bound[j])) & early

            fits = fitting(two, two + 1)
            out = _Pairs(sid, bound)
            out.add(two if stars else two[fits], two + 1 if stars else two[fits] + 1)
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                at = np.arange(start, start + size)
                if stars:
                    values, counts = np.unique(root[at], return_counts=True)
                    home = at[root[at] == values[counts.argmax()]]
                    away = at[root[at] != values[counts.argmax()]]
                    out.add(away, home[[np.bitwise_count((fp[home] ^ fp[i]).view(np.uint64)).argmin() for i in away]])
                    for hub in home[np.lexsort((sid[home], -degree[home]))[:HUBS]]:
                        out.add(away, np.full(len(away), hub))
                else:
                    apart = block[at].min() < block[at].max()
                    for i in range(start, start + size - 1):
                        rest = at[i + 1 - start :]
                        fits = fitting(i, rest)
                        near = rest[fits & (block[rest] != block[i])] if apart else rest[fits]
                        if len(near):
                            out.add(np.full(len(near), i), near)
                        if out.rows >= PAIRS:
                            yield out.taken()
            yield out.taken()

    found = map_arrow(_buckets_of(shared, named, stars), rows, "a long, b long, need long").groupBy("a", "b").agg(F.count("*").alias("c"), F.min("need").alias("need"))
    return found.where("c >= need").select("a", "b")


def similar(docs: DataFrame, shingle: int = 5, radius: int = 6, tenths: int = 8) -> DataFrame:
    """doc_id, e, sid, root, component_id (the smallest doc_id reachable) for every row, by links of Jaccard similarity >= tenths / 10.

    Fingerprints within the radius are the first candidates. What they miss is
    found by prefix filtering, which loses no pair; sets already in one component
    are not compared again. Every link is verified on the sets of shingles.
    """
    rows = materialize(_sets(docs, shingle).select("doc_id", "e", "sid", "fp", "n"), "prints")
    shared = materialize(_shared(docs, rows.count(), shingle, tenths), "shared")
    heads = rows.groupBy("fp").agg(F.min("sid").alias("head"))
    near = links(rows, radius).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    same = rows.select("sid", "fp").join(heads, "fp").where("sid != head").select(F.col("sid").alias("a"), F.col("head").alias("b"))
    first = near.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same).distinct()
    edges = _verified(first, docs, rows, shingle, tenths)
    named = materialize(rows.groupBy("sid").agg(F.min("fp").alias("fp"), F.min("n").alias("n")), "sets")
    every = edges
    for stars in (*[True] * STARS, False):
        roots = components(edges)  # a forest of stars, from which the next components are soon found
        more = _verified(_pairs(shared, named, roots, every, tenths, stars), docs, rows, shingle, tenths)
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more.select("a", "b"))
        every = every.unionByName(more.select("a", "b"))
    found = rooted(rows.select("doc_id", "e", "sid"), "sid", edges)
    discard(shared, named)
    return found


def keep_one_similar(docs: DataFrame, shingle: int = 5, radius: int = 6, tenths: int = 8) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that of the smallest doc_id. Rows of a null doc_id stay."""
    return one_of_each(docs, similar(docs, shingle, radius, tenths))
