"""A stored trigram index, and searches that read its postings instead of the texts.

An index has generations. Each is a folder of three tables:

* ``postings``: (bucket, part, term, field, block, n_docs, n_places, docs, counts,
  places). A term is a
  trigram of lower-case characters as one number. A row holds one term's documents in
  one field and one block: their numbers in the block, how often each has the term and
  where, numbers and places as differences in as few bytes as they take. A block is what one
  task read at once and writes itself: building moves neither text nor postings from
  task to task. Files are partitioned by ``bucket``, a hash of the term, and sorted by
  term, in pages of a few rows: a query's terms name the folders and the pages that are
  read. ``merge`` deals a bucket's rows together. Folders from ``KEYS`` on have for each
  block the keys and lengths of its documents.
* ``documents``: (key, part, length, version, ...) with the lengths that scores need,
  a hash of the indexed fields, and columns to filter by.
* ``parts``: one row for each part, in order. A refresh adds a part with the changed
  documents and the keys that went, so nothing else is written; a posting counts only
  if its document's latest part is the posting's. ``merge`` writes one part again.

A word of the query is a phrase of trigrams. Its rarest trigrams that cover the word
are looked up; blocks that lack one of them are dropped by narrow columns before any
place is read; places, shifted by their offset in the word, must coincide. Scores are
those of ``fulltext.bm25`` on the same rows. The number of documents with a word is
not known before its blocks are matched, so bounds on a block's scores could skip
nothing and aren't kept.

A generation becomes current only if it covers the documents given: ``activate``
raises on keys missing, orphaned or stale. Null fields are empty; a null key is not
indexed; of rows that share a key the one of the smallest version counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.operators import fulltext
from siltstone.sources.generations import GenerationStore

#: Hash partitions of the terms, and characters of text in a block.
BUCKETS, BLOCK_CHARS = 64, 4 << 20
#: Characters of text for a task where the rows come in many small partitions: each task writes a file for each bucket.
TASK_CHARS = 32 * BLOCK_CHARS
#: Rows of a page of a file: what is read for a term, besides its own rows.
PAGE_ROWS = 256
#: Places of postings that are unpacked at once.
PLACES = 1 << 20
#: From this number on, the folders of the blocks' keys, dealt by block.
KEYS = BUCKETS
#: Bits of a character in a term's number.
BITS = 21


def term(three: str) -> int:
    a, b, c = map(ord, three)
    return (a << 2 * BITS) | (b << BITS) | c


def bucket_of(number: int, buckets: int = BUCKETS) -> int:
    return zlib.crc32(str(number).encode()) % buckets


def _steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences within groups that begin at ``starts``; the first of each stays."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out.astype(np.int32)


def _sums(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums within groups of these sizes."""
    total = np.cumsum(steps, dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    before = np.where(starts > 0, total[np.maximum(starts, 1) - 1], 0) if len(total) else starts
    return total - np.repeat(before, sizes)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers in as few bytes of seven bits as they take, the last of a number below 128; a row of them up to each of ``ends``."""
    size = sum((values >= 1 << bits).astype(np.int8) for bits in (7, 14, 21, 28)) + np.int8(1)
    stops = np.cumsum(size, dtype=np.int32)
    out = np.empty(int(stops[-1]) if len(stops) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        out[stops[has] - size[has] + k] = values[has] >> 7 * k & 127 | np.where(size[has] > k + 1, 128, 0)
    offsets = np.append(0, np.append(0, stops)[ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _unpacked(column: pa.Array) -> np.ndarray:
    """The numbers of ``_packed`` rows, one row's after another's."""
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    last = np.flatnonzero(data < 128)
    first = np.append(0, last[:-1] + 1)
    out = (data[first] & 127).astype(np.int64)
    for k in range(1, int((last - first).max()) + 1):
        has = np.flatnonzero(last - first >= k)
        out[has] |= (data[first[has] + k] & 127).astype(np.int64) << 7 * k
    return out


def _block(texts: list[str], block: int, field: str) -> dict[str, pa.Array]:
    """One row for each term: documents by their number in ``texts``, counts and places."""
    sizes = np.array([len(t) for t in texts], np.int32)
    grams = np.maximum(sizes - 2, 0)
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    # characters by their number among those of the block, in order: terms sort as narrow numbers
    number = np.zeros(int(c.max(initial=0)) + 1, np.int32)
    number[c] = 1
    chars = np.flatnonzero(number)
    number[chars] = np.arange(len(chars))
    c = number[c]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), grams)
    places = np.arange(len(doc), dtype=np.int32) - np.repeat(np.cumsum(grams, dtype=np.int32) - grams, grams)
    at = places + np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes, grams)
    n = len(chars)
    terms = np.zeros(len(at), np.uint32 if n**3 < 1 << 32 else np.int64)
    for i in range(3):
        terms *= terms.dtype.type(n)
        terms += c[at + i].astype(terms.dtype)
    del c, at, number
    order = np.argsort(terms, kind="stable")  # documents and places stay in order
    terms, places, doc = terms[order], places[order], doc[order]
    del order
    changed = np.ones(len(terms), bool)
    changed[1:] = terms[1:] != terms[:-1]
    new_term = np.flatnonzero(changed)
    changed[1:] |= doc[1:] != doc[:-1]
    new_doc = np.flatnonzero(changed)
    row_at, place_at = np.append(np.searchsorted(new_doc, new_term), len(new_doc)), np.append(new_term, len(doc))
    numbers = terms[new_term].astype(np.int64)
    numbers = (chars[numbers // n**2] << 2 * BITS) | (chars[numbers // n % n] << BITS) | chars[numbers % n] if len(numbers) else numbers
    return {
        "bucket": pa.array([bucket_of(x) for x in numbers.tolist()], pa.int32()), "term": pa.array(numbers), "field": pa.array([field] * len(numbers), pa.string()), "block": pa.array(np.full(len(numbers), block)),
        "n_docs": pa.array(np.diff(row_at).astype(np.int32)), "n_places": pa.array(np.diff(place_at).astype(np.int32)),
        "docs": _packed(_steps(doc[new_doc], row_at[:-1]), row_at[1:]), "counts": _packed(np.diff(np.append(new_doc, len(doc))), row_at[1:]), "places": _packed(_steps(places, new_doc), place_at[1:]),
    }


def posting_schema(kind: T.DataType) -> T.StructType:
    """Of postings whose keys are of this kind."""
    longs = T.ArrayType(T.IntegerType())
    schema = T.StructType().add("bucket", T.IntegerType()).add("term", T.LongType()).add("field", T.StringType()).add("block", T.LongType())
    for name in ("n_docs", "n_places"):
        schema = schema.add(name, T.IntegerType())
    for name in ("docs", "counts", "places"):
        schema = schema.add(name, T.BinaryType())
    return schema.add("keys", T.ArrayType(kind)).add("lengths", longs)


def postings(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The rows of ``posting_schema`` of rows with a key and lower-case fields."""
    schema = posting_schema(rows.schema[key].dataType)
    names = schema.names

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.array([pc.utf8_length(batch.column(f)).to_numpy() for f in fields], np.int64).reshape(len(fields), batch.num_rows)
            lengths, ends = np.maximum(sizes - 2, 0).sum(axis=0), np.cumsum(sizes.sum(axis=0))
            longs = pa.list_(pa.int32())
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_CHARS, "right")))
                kind = pa.list_(batch.schema.field(key).type)
                for f in fields:
                    own = _block(batch.column(f).slice(at, stop - at).to_pylist(), block, f)
                    n = len(own["term"])
                    own |= {"keys": pa.nulls(n, kind), "lengths": pa.nulls(n, longs)}
                    yield pa.RecordBatch.from_arrays([own[c] for c in names], names)
                whole = pa.array([0, stop - at], pa.int32())
                none, nothing = pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())
                ids, sizes_ = pa.ListArray.from_arrays(whole, batch.column(key).slice(at, stop - at)), pa.ListArray.from_arrays(whole, pa.array(lengths[at:stop].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([KEYS + (block ^ block >> 32) % BUCKETS], pa.int32()), pa.array([-1]), pa.array([""]), pa.array([block]), none, none, nothing, nothing, nothing, ids, sizes_], names)
                at, block = stop, block + 1

    cores, few = rows.sparkSession.sparkContext.defaultParallelism, rows.select(key, *fields)
    parts = few.rdd.getNumPartitions()
    if parts < cores:  # one small file, say
        few = few.repartition(cores)
    elif parts > 4 * cores:
        chars = few.agg(F.sum(reduce(lambda a, b: a + b, [F.length(f) for f in fields]))).first()[0] or 0
        few = few.coalesce(max(cores, -(-chars // TASK_CHARS)))  # moves no rows
    return few.mapInArrow(index, schema)


def _slices(batches: Iterator[pa.RecordBatch], most: int = PLACES) -> Iterator[pa.RecordBatch]:
    """Posting rows, so many at once as have ``most`` places together, one at least."""
    for batch in batches:
        ends = np.cumsum(batch.column("n_places").to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of posting rows: its number, and its places shifted by the term's offset in the word."""
    for batch in _slices(batches):
        per_row = batch.column("n_docs").to_numpy().astype(np.int64)
        counts = _unpacked(batch.column("counts"))
        doc = _sums(_unpacked(batch.column("docs")), per_row)
        row = np.repeat(np.arange(batch.num_rows), per_row)
        offset = batch.column("offset").to_numpy()[row]
        places = _sums(_unpacked(batch.column("places")), counts) - np.repeat(offset, counts)
        at = np.append(0, np.cumsum(counts)).astype(np.int32)
        taken = [batch.column(c).take(pa.array(row)) for c in ("word", "part", "field", "block", "needed")]
        yield pa.RecordBatch.from_arrays([*taken, pa.array(doc.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(places.astype(np.int32)))], ["word", "part", "field", "block", "needed", "doc", "places"])


def _living(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows with the documents alone whose numbers are in ``alive``; rows that have none left go."""
    for batch in _slices(batches):
        out = {c: [] for c in ("docs", "counts", "places")}
        keep, n_docs, n_places = [], [], []
        for i in range(batch.num_rows):
            docs, counts, places = (_unpacked(batch.column(c).slice(i, 1)) for c in out)
            numbers = np.cumsum(docs)
            live = np.isin(numbers, batch.column("alive")[i].values.to_numpy())
            if live.any():
                keep.append(i)
                out["docs"].append(np.diff(numbers[live], prepend=0))
                out["counts"].append(counts[live])
                out["places"].append(places[np.repeat(live, counts)])
                n_docs.append(int(live.sum()))
                n_places.append(len(out["places"][-1]))
        rest = [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("bucket", "term", "field", "block", "part")]
        lists = [_packed(np.concatenate([np.zeros(0, np.int64), *v]), np.cumsum([len(x) for x in v], dtype=np.int64)) for v in out.values()]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(n_docs, pa.int32()), pa.array(n_places, pa.int32()), *lists], ["bucket", "term", "field", "block", "part", "n_docs", "n_places", *out])


def _dealt(rows: DataFrame) -> DataFrame:
    """Posting rows by bucket, a bucket's blocks over several tasks where the session has more tasks than buckets."""
    tasks = max(BUCKETS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = F.pmod(F.xxhash64("block"), F.lit(-(-tasks // BUCKETS)))
    return rows.repartition(tasks, "bucket", share)


def _write_postings(rows: DataFrame, path: str, mode: str) -> None:
    """Every task's rows as its own files, one for each bucket, in order of terms."""
    ordered = rows.sortWithinPartitions("bucket", "term", "field", "block")
    ordered.write.partitionBy("bucket").option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_ROWS).mode(mode).parquet(path)


def cover(word: str, counts: dict[int, int]) -> list[tuple[int, int]]:
    """(term, offset) of trigrams that together hold every character of a word, rare ones first."""
    grams = sorted((counts.get(term(word[i : i + 3]), 0), i) for i in range(len(word) - 2))
    left, out = set(range(len(word))), []
    for _, i in grams:
        if left & {i, i + 1, i + 2}:
            left -= {i, i + 1, i + 2}
            out.append((term(word[i : i + 3]), i))
    return out


def _apart(places: Column, size: int) -> Column:
    """How many of these places can be taken from the left without overlap."""
    start = F.struct(F.lit(0).cast("int").alias("n"), F.lit(-size).cast("int").alias("last"))
    step = lambda s, p: F.when(p >= s["last"] + size, F.struct((s["n"] + 1).alias("n"), p.alias("last"))).otherwise(s)
    return F.aggregate(F.array_sort(places), start, step, lambda s: s["n"])


class TextIndex:
    """Generations of an index of ``fields`` under one folder; ``extra`` columns are kept to filter by."""

    def __init__(self, spark: SparkSession, root: str, key: str, fields: list[str], extra: list[str] | None = None):
        self.spark, self.root, self.key, self.fields, self.extra = spark, root.rstrip("/"), key, fields, extra or []
        self.store = GenerationStore(spark, f"{self.root}/parts")

    def _path(self, generation: str, name: str) -> str:
        return f"{self.root}/{name}/gen={generation}"

    def _lower(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col(self.key).isNotNull()).withColumns({f: F.lower(F.coalesce(f, F.lit(""))) for f in self.fields})

    def _version(self) -> Column:
        return F.xxhash64(*self.fields)

    def versions(self, rows: DataFrame) -> DataFrame:
        """One row for each key with the hash of its fields, their length and the columns to filter by."""
        low = self._lower(rows)
        length = reduce(lambda a, b: a + b, [F.greatest(F.length(f) - 2, F.lit(0)) for f in self.fields])
        return low.select(self.key, length.cast("int").alias("length"), self._version().alias("version"), *self.extra)

    def _once(self, rows: DataFrame) -> DataFrame:
        """Rows with distinct keys; tables whose keys are distinct already pass by ``unique``."""
        return rows.withColumn("_v", self._version()).withColumn("_n", F.row_number().over(Window.partitionBy(self.key).orderBy("_v"))).where("_n = 1").drop("_v", "_n")

    def _write(self, generation: str, part: int, rows: DataFrame, unique: bool) -> None:
        rows = rows if unique else self._once(rows)
        held = postings(self._lower(rows), self.key, self.fields).withColumn("part", F.lit(part))
        _write_postings(held, self._path(generation, "postings"), "append")
        self.versions(rows).withColumn("part", F.lit(part)).withColumn("gone", F.lit(False)).write.mode("append").parquet(self._path(generation, "documents"))

    def build(self, generation: str, rows: DataFrame, unique: bool = True) -> None:
        """A new generation of one part. It is not current before ``activate``."""
        self._write(generation, 0, rows, unique)
        self.store.write(generation, self.spark.createDataFrame([(0,)], "part int"))

    def refresh(self, generation: str, fresh: DataFrame, gone: DataFrame | None = None, unique: bool = True) -> None:
        """Another part: documents of ``fresh`` replace those of their keys, keys of ``gone`` go."""
        part = self.store.read(generation).agg(F.max("part")).first()[0] + 1
        self._write(generation, part, fresh, unique)
        if gone is not None:
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._documents(generation).schema if f.name not in (self.key, "part", "gone")]
            gone.select(self.key).distinct().select(self.key, *none, F.lit(part).alias("part"), F.lit(True).alias("gone")).write.mode("append").parquet(self._path(generation, "documents"))
        self.spark.createDataFrame([(part,)], "part int").write.mode("append").parquet(f"{self.root}/parts/gen={generation}")

    def _documents(self, generation: str) -> DataFrame:
        return self.spark.read.parquet(self._path(generation, "documents"))

    def documents(self, generation: str | None = None) -> DataFrame:
        """What is indexed at present: the latest part of each key that isn't gone."""
        generation = generation or self.current()
        rows, parts = self._documents(generation), self.store.read(generation)
        if parts.count() > 1:  # parts: one row each
            rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc("part"), "gone"))).where("_n = 1").drop("_n")
        return rows.where("not gone").drop("gone")

    def merge(self, generation: str, into: str) -> None:
        """A new generation of one part from the postings that count, without reading texts."""
        live = self.documents(generation)
        # blocks of different parts share numbers: the part tells them apart
        both = F.col("block") * F.lit(1 << 10) + F.col("part") % (1 << 10)
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._postings(generation).schema if f.name in ("keys", "lengths")]
        kept = self._living(generation).select("bucket", "term", "field", both.alias("block"), "n_docs", "n_places", "docs", "counts", "places", *none)
        names = self._postings(generation).where(F.col("bucket") >= KEYS).withColumn("block", both).select(*kept.columns)
        rows = kept.unionByName(names).withColumn("part", F.lit(0))
        _write_postings(_dealt(rows), self._path(into, "postings"), "errorifexists")
        live.withColumn("part", F.lit(0)).withColumn("gone", F.lit(False)).write.parquet(self._path(into, "documents"))
        self.store.write(into, self.spark.createDataFrame([(0,)], "part int"))

    def uncovered(self, generation: str, active: DataFrame) -> DataFrame:
        """(key, issue): documents that the index misses, holds without need, or holds in another version."""
        want = self.versions(active).select(self.key, F.col("version").alias("want"))
        both = want.join(self.documents(generation).select(self.key, F.col("version").alias("have")), self.key, "full_outer")
        issue = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "orphan").when(F.col("have") != F.col("want"), "stale")
        return both.select(self.key, issue.alias("issue")).where("issue is not null")

    def activate(self, generation: str, active: DataFrame) -> None:
        """Make a generation current; ``ValueError`` if it does not cover ``active``."""
        self.store.activate(generation, lambda _: self.uncovered(generation, active))

    def current(self) -> str | None:
        return self.store.current()

    def frequencies(self, words: list[str], generation: str) -> dict[int, int]:
        """Documents and fields that hold each trigram of the words, from one narrow column of their rows."""
        numbers = sorted({term(w[i : i + 3]) for w in words for i in range(len(w) - 2)})
        return {r.term: r.n for r in self._read(generation, numbers).groupBy("term").agg(F.sum("n_docs").alias("n")).collect()}

    def _numbers(self, generation: str) -> DataFrame:
        """(part, block, doc, key, length) of every document of every part: its number in its block."""
        names = self._postings(generation).where(F.col("bucket") >= KEYS)
        return names.select("part", "block", F.posexplode(F.arrays_zip("keys", "lengths")).alias("doc", "p")).select("part", "block", "doc", F.col("p.keys").alias(self.key), F.col("p.lengths").alias("length"))

    def _living(self, generation: str) -> DataFrame:
        """Postings of the documents that count; a block's living numbers are joined to its rows."""
        rows = self._postings(generation).where(F.col("bucket") < KEYS).drop("keys", "lengths")
        if self.store.read(generation).count() == 1:
            return rows
        live = self._numbers(generation).join(self.documents(generation).select(self.key, "part"), [self.key, "part"], "left_semi")
        alive = live.groupBy("part", "block").agg(F.collect_list("doc").alias("alive"))  # a block's documents
        joined = rows.join(alive, ["part", "block"]).select("bucket", "term", "field", "block", "part", "n_docs", "n_places", "docs", "counts", "places", "alive")
        return joined.mapInArrow(_living, "bucket int, term long, field string, block long, part int, n_docs int, n_places int, docs binary, counts binary, places binary")

    def terms(self, field: str, generation: str | None = None) -> DataFrame:
        """term, df, tf of every trigram of a field."""
        rows = self._living(generation or self.current()).where(F.col("field") == field)
        per = rows.groupBy("term").agg(F.sum("n_docs").alias("df"), F.sum("n_places").alias("tf"))
        of = lambda shift: F.lpad(F.hex(F.shiftright("term", shift).bitwiseAND(F.lit((1 << BITS) - 1))), 8, "0")
        return per.select(F.decode(F.unhex(F.concat(of(2 * BITS), of(BITS), of(0))), "UTF-32").alias("term"), "df", "tf")

    def _postings(self, generation: str) -> DataFrame:
        schema = posting_schema(self._documents(generation).schema[self.key].dataType).add("part", T.IntegerType())
        return self.spark.read.schema(schema).parquet(self._path(generation, "postings"))

    def _read(self, generation: str, numbers: list[int]) -> DataFrame:
        rows = self._postings(generation)
        return rows.where(F.col("bucket").isin(sorted({bucket_of(x) for x in numbers})) & F.col("term").isin(numbers))

    def occurrences(self, words: list[str], generation: str) -> DataFrame:
        """(word, key, field, part, length, tf) of every document that holds a word: ``word`` is its number in ``words``."""
        counts = self.frequencies(words, generation)
        asked = [(i, t, o, len(found)) for i, w in enumerate(words) for found in [cover(w, counts)] for t, o in found]
        wanted = F.broadcast(self.spark.createDataFrame(asked, "word int, term long, offset int, needed int"))  # a few rows for each word of the query
        read = self._read(generation, sorted({t for _, t, _, _ in asked}))
        where = ["word", "part", "field", "block"]
        # narrow: which blocks hold all of a word's trigrams
        whole = read.select("term", "field", "block", "part").join(wanted, "term").groupBy(*where, "needed").agg(F.count("*").alias("n")).where("n = needed").select(*where)
        rows = read.join(wanted, "term").join(whole, where, "left_semi")
        opened = rows.select(*where, "offset", "needed", "n_docs", "n_places", "docs", "counts", "places").mapInArrow(_opened, "word int, part int, field string, block long, needed int, doc int, places array<int>")
        met = opened.groupBy("word", "part", "field", "block", "doc", "needed").agg(F.collect_list("places").alias("all")).where(F.size("all") == F.col("needed"))
        places = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), F.col("all")[0], lambda a, b: F.array_intersect(a, b))
        met = met.select("word", "part", "field", "block", "doc", places.alias("places"))
        tf = reduce(lambda rest, i: F.when(F.col("word") == i, _apart(F.col("places"), len(words[i]))).otherwise(rest), range(len(words)), F.lit(0))
        met = met.select("word", "part", "field", "block", "doc", tf.alias("tf")).where("tf > 0")
        names = self._postings(generation).where(F.col("bucket") >= KEYS).select("part", "block", "keys", "lengths")
        return met.join(names, ["part", "block"]).select("word", "part", "field", F.col("keys")[F.col("doc")].alias(self.key), F.col("lengths")[F.col("doc")].alias("length"), "tf")

    def counted(self, words: list[str], weights: dict[str, float], generation: str, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """What ``fulltext.scores`` takes: term counts of the documents that hold a word, and statistics of all (that ``keep`` holds for)."""
        found = self.occurrences(words, generation)
        live = self.documents(generation)
        live = live.where(keep) if keep is not None else live
        if keep is not None or self.store.read(generation).count() > 1:
            found = found.join(live.select(self.key, "part"), [self.key, "part"], "left_semi")
        weight = reduce(lambda rest, f: F.when(F.col("field") == f, F.lit(weights[f])).otherwise(rest), weights, F.lit(0.0))
        tf = [F.sum(F.when(F.col("word") == i, weight * F.col("tf")).otherwise(F.lit(0.0))).alias(f"tf{i}") for i in range(len(words))]
        rows = found.groupBy(self.key).agg(F.max("length").cast("double").alias("dl"), *tf)
        some = rows.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
        return rows, live.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl")).join(F.broadcast(some))  # one row each

    def search(self, query: str, weights: dict[str, float], most: int = 100, keep: Column | None = None, generation: str | None = None) -> DataFrame:
        """key, score of the best ``most`` documents, from the postings alone. A query without a word of three characters is an error: see ``fulltext.substring``."""
        words = fulltext.query_tokens(query)
        if not words:
            raise ValueError("no word of three characters")
        generation = generation or self.current()
        if generation is None:
            raise LookupError(f"{self.root} has no current generation")
        return fulltext.scores(*self.counted(words, weights, generation, keep), len(words), self.key, most)
