"""Token ids on disk: one concatenated id array with Elias-Fano document boundaries.

A dataset is a folder of Parquet shards whose rows are segments. A segment holds
the ids of consecutive documents as one little-endian array in the narrowest
width that fits the vocabulary, and the documents' n + 1 boundaries as an
Elias-Fano code: the low bits packed, the high bits in unary, and every 256th
one's place sampled, so that select() finds any boundary without a table of
64-bit offsets. Segments follow ascending doc_id across the whole dataset.

Nulls and empties: a null text counts as empty and yields the end id alone; null
doc_ids come first. Repeated doc_ids keep all their rows, in any order among
themselves. An empty table gives an empty dataset. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.llm.bpe_words import ended, word_bpe
from siltstone.llm.common import map_arrow, renamed, scratch_path

#: A segment is closed when it holds this many ids; a longer document has one of its own.
SEGMENT_IDS = 1 << 20
#: Ones between two sampled places in the high bits.
SAMPLE = 256

SEGMENT = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("id_width", T.IntegerType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("boundaries", T.BinaryType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(max / n) bits each."""

    HEAD = struct.Struct("<QBQQ")

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples
        self._bits = np.frombuffer(high, np.uint8)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(places[-1]) if n else 0) + 1, np.uint8)
        high[places] = 1
        pack = lambda bits: np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, low_bits, pack(low), pack(high), places[::SAMPLE].astype("<u4" if len(high) < 1 << 32 else "<u8"))

    def to_bytes(self) -> bytes:
        head = self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high))
        return head + bytes([self.samples.itemsize]) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, n_low, n_high = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size + 1
        samples = np.frombuffer(data, f"<u{data[at - 1]}", offset=at + n_low + n_high)
        return cls(n, low_bits, data[at : at + n_low], data[at + n_low : at + n_low + n_high], samples)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first = i * self.low_bits
        window = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little")
        return window >> first % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place // 8
        word = int(self._bits[byte]) >> place % 8 << place % 8
        while left >= (ones := word.bit_count()):
            left -= ones
            byte += 1
            word = int(self._bits[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        """All values."""
        places = np.flatnonzero(np.unpackbits(self._bits, bitorder="little"))[: self.n]
        out = (places - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
            out |= bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out


def _segments(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    bpe = word_bpe(tokenizer)
    part = TaskContext.get().partitionId()
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # documents' names, ids, sizes
    seq = start = n_held = 0

    def segment() -> pa.RecordBatch:
        names, ids, sizes = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(sizes)])).to_bytes()
        values = ([part], [seq], [start], [n_held], [bpe.dtype.itemsize], [names], [bounds], [ids.tobytes()])
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], SEGMENT.names)

    for batch in batches:
        ids, at = ended(*bpe.encode_column(batch.column("text")), end_id)
        doc = 0
        while doc < batch.num_rows:
            # up to and with the document that fills the segment
            stop = min(int(np.searchsorted(at, at[doc] + SEGMENT_IDS - n_held)), batch.num_rows)
            held.append((batch.column("doc_id").slice(doc, stop - doc), ids[at[doc] : at[stop]], np.diff(at[doc : stop + 1])))
            n_held += int(at[stop] - at[doc])
            doc = stop
            if n_held >= SEGMENT_IDS:
                yield segment()
                seq, start, n_held, held = seq + 1, start + n_held, 0, []
    if held:
        yield segment()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each, and write a dataset in ascending doc_id order.

    Texts move once, in a range exchange on doc_id; ids go straight to their files.
    """
    ordered = renamed(docs, **{doc_id: "doc_id", text: "text"}).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    map_arrow(ordered, lambda it: _segments(it, tokenizer, end_id), SEGMENT).write.option("compression", "zstd").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A dataset's segments with ``start``, the ids of all segments before each.

    Only one row per written partition meets in the running sum, and it is those
    rows that are broadcast; the ids stay where they are.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_base"))
    return segments.join(F.broadcast(bases), "part").withColumn("start", F.col("part_base") + F.col("part_start")).drop("part_base")


DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long, ids_width int"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], f"<u{row['id_width']}").astype("<u4")
            at = EliasFano.from_bytes(row["boundaries"]).values()
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            n = len(crcs)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(at[:-1] + row["start"], pa.int64()),
                    "n_tokens": pa.array(np.diff(at), pa.int64()),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                    "ids_width": pa.array(np.full(n, row["id_width"], np.int32), pa.int32()),
                }
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a dataset, decoded from its files."""
    columns = ["start", "id_width", "doc_ids", "boundaries", "ids"]
    return map_arrow(read_segments(spark, path).select(*columns), _documents, DOCUMENT)


def read_ids(segment: dict, ordinal: int) -> np.ndarray:
    """The ids of one document of a segment row, found by two selects."""
    bounds = EliasFano.from_bytes(segment["boundaries"])
    ids = np.frombuffer(segment["ids"], f"<u{segment['id_width']}")
    return ids[bounds.select(ordinal) : bounds.select(ordinal + 1)]


def op1(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as a token dataset in the shared folder and return its documents as read back."""
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
