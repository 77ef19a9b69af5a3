"""Ogg media columns: verify, demultiplex, reassemble, and time.

``parse`` reads any Ogg physical stream: it checks every page's checksum, joins
packets from lacing values across continued pages, separates interleaved and
chained logical streams by serial number, and derives each packet's end time from
its page's granule position where the codec's rate is known (OggPCM here, Vorbis
and Opus by their identification headers). ``write_pcm`` makes the lossless form
used for texts: an OggPCM stream of 8-bit unsigned mono samples beside a second
logical stream of marks, one for each page of samples.

A damaged or foreign byte string gives a row with ``error`` set and what could be
read up to there; null media gives error "null". Empty and very long inputs,
repeated rows and empty tables need no special care; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import map_arrow, materialize, renamed

PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: Samples a packet, and a second.
PACKET, RATE = 4096, 8000
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
OPUS_RATE = 48_000


def checksum(*parts: bytes) -> int:
    """Ogg's CRC: polynomial 0x04C11DB7, most significant bit first, from zero, not inverted.

    zlib's runs the same polynomial from the other end, so bits go in and come out reversed.
    """
    crc = 0xFFFFFFFF
    for part in parts:
        crc = zlib.crc32(part.translate(REVERSED), crc)
    return int.from_bytes((crc ^ 0xFFFFFFFF).to_bytes(4, "little").translate(REVERSED), "big")


def page(packets: list[bytes], serial: int, number: int, granule: int, flags: int = 0) -> bytes:
    """One page of whole packets."""
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    body = b"".join(packets)
    head = PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head, body)) + head[26:] + body


def pcm_header(extra: int = 0) -> bytes:
    """OggPCM's main header: version 0.0, unsigned 8 bits, mono."""
    return b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, RATE, 8, 1, PACKET, extra)


def write_pcm(payload: bytes) -> bytes:
    """``payload`` as samples; page by page with the marks that tell a page's first sample and checksum."""
    serial = zlib.crc32(payload)
    other = serial ^ 0xFFFFFFFF
    out = [page([pcm_header()], serial, 0, 0, FIRST), page([b"MARK    "], other, 0, 0, FIRST)]
    size = PACKET * 15
    count = -(-len(payload) // size)
    for i in range(count):
        part = payload[i * size : (i + 1) * size]
        end = i * size + len(part)
        last = LAST if i == count - 1 else 0
        out.append(page([struct.pack("<QI", i * size, zlib.crc32(part))], other, i + 1, end, last))
        out.append(page([part[j : j + PACKET] for j in range(0, len(part), PACKET)], serial, i + 1, end, last))
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream: its packets, and the time at which each ends (None: not known)."""

    serial: int
    codec: str = ""
    rate: int = 0
    packets: list[bytes] = field(default_factory=list)
    ends: list[float | None] = field(default_factory=list)
    granule: int = 0
    pages: int = 0
    ended: bool = False
    _held: list[bytes] = field(default_factory=list)
    _next: int = 0
    _skip: int = 0

    def identify(self, packet: bytes) -> None:
        if packet[:8] == b"PCM     " and len(packet) >= 28:
            self.codec, self.rate = "pcm", struct.unpack_from(">I", packet, 16)[0]
        elif packet[:7] == b"\x01vorbis" and len(packet) >= 16:
            self.codec, self.rate = "vorbis", struct.unpack_from("<I", packet, 12)[0]
        elif packet[:8] == b"OpusHead" and len(packet) >= 12:
            self.codec, self.rate = "opus", OPUS_RATE
            self._skip = struct.unpack_from("<H", packet, 10)[0]
        elif packet[:8] == b"MARK    ":
            self.codec, self.rate = "marks", RATE

    def time(self, granule: int) -> float | None:
        return max(0, granule - self._skip) / self.rate if self.rate and granule >= 0 else None


def parse(data: bytes | None) -> tuple[list[Stream], str]:
    """The logical streams in order of their first pages, and what is wrong ("" if nothing is)."""
    if data is None:
        return [], "null"
    streams: list[Stream] = []
    live: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS":
            return streams, f"no page at byte {at}"
        if len(data) < at + PAGE.size:
            return streams, "page header cut short"
        _, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(data, at)
        lacing = data[at + PAGE.size : at + PAGE.size + n]
        body = at + PAGE.size + n
        end = body + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            return streams, "unknown version" if version else "page cut short"
        if checksum(data[at : at + 22], b"\0\0\0\0", data[at + 26 : end]) != crc:
            return streams, f"checksum of page {number} of stream {serial}"
        if flags & FIRST:
            live[serial] = Stream(serial)
            streams.append(live[serial])
        s = live.get(serial)
        if s is None or s.ended:
            return streams, f"page of unopened stream {serial}"
        if number != s._next or bool(flags & CONTINUED) != bool(s._held):
            return streams, f"gap before page {number} of stream {serial}"
        s._next, s.pages = number + 1, s.pages + 1
        whole = []
        place = body
        for size in lacing:
            s._held.append(data[place : place + size])
            place += size
            if size < 255:
                whole.append(b"".join(s._held))
                s._held = []
        if whole and not s.codec and not s.packets:
            s.identify(whole[0])
        s.packets += whole
        # a granule position is the end of the last packet that ends on its page
        s.ends += [None] * (len(whole) - 1) + [s.time(granule)] if whole else []
        if whole and granule >= 0:
            s.granule = granule
        s.ended = bool(flags & LAST)
        at = end
    if any(s._held for s in streams):
        return streams, "packet cut short"
    return streams, "" if streams else "no page"


def read_pcm(data: bytes) -> bytes:
    """The samples of ``write_pcm``, checked against the marks."""
    streams, error = parse(data)
    samples = next((s for s in streams if s.codec == "pcm"), None)
    marks = next((s for s in streams if s.codec == "marks"), None)
    if error or samples is None or marks is None:
        raise ValueError(error or "no samples")
    payload = b"".join(samples.packets[1:])
    starts = [*(struct.unpack("<QI", p) for p in marks.packets[1:]), (len(payload), 0)]
    for (first, crc), (stop, _) in zip(starts, starts[1:], strict=False):
        if zlib.crc32(payload[first:stop]) != crc:
            raise ValueError(f"samples from {first} on differ from their mark")
    return payload


def feature(streams: list[Stream]) -> str:
    """What the streams say of themselves, and an envelope of the samples."""
    parts = []
    for s in streams:
        end = next((t for t in reversed(s.ends) if t is not None), None)
        parts.append(f"{s.codec or 'unknown'}:pages={s.pages},packets={len(s.packets)},bytes={sum(map(len, s.packets))},end={-1.0 if end is None else end:.6f}")
        if s.codec == "pcm":
            x = np.frombuffer(b"".join(s.packets[1:]), np.uint8).astype(np.float64) - 128
            rms = np.sqrt((x * x).mean()) if len(x) else 0.0
            parts.append(f"rms={rms:.4f},peak={np.abs(x).max(initial=0):.0f},crossings={np.count_nonzero(np.diff(np.signbit(x)))}")
    return ";".join(parts)


INSPECTED = (
    "id long, error string, streams array<struct<serial:long, codec:string, rate:long, pages:long, packets:long, bytes:long, "
    "granule:long, ended:boolean, end_seconds:double, packet_ends:array<double>>>"
)


def inspect(media: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """One row per media value: its error, if any, and its logical streams with packet times."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                streams, error = parse(data)
                out.append(
                    {
                        "id": key,
                        "error": error or None,
                        "streams": [
                            {
                                "serial": s.serial, "codec": s.codec or None, "rate": s.rate, "pages": s.pages, "packets": len(s.packets),
                                "bytes": sum(map(len, s.packets)), "granule": s.granule, "ended": s.ended,
                                "end_seconds": s.time(s.granule), "packet_ends": s.ends,
                            }
                            for s in streams
                        ],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema)

    stream = pa.struct(
        [
            ("serial", pa.int64()), ("codec", pa.string()), ("rate", pa.int64()), ("pages", pa.int64()), ("packets", pa.int64()), ("bytes", pa.int64()),
            ("granule", pa.int64()), ("ended", pa.bool_()), ("end_seconds", pa.float64()), ("packet_ends", pa.list_(pa.float64())),
        ]
    )
    schema = pa.schema([("id", pa.int64()), ("error", pa.string()), ("streams", pa.list_(stream))])
    return map_arrow(renamed(media, **{id_column: "id", media_column: "media"}), rows, INSPECTED)


def pad(data: bytes, unit: int = 64) -> bytes:
    """Zero bytes up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        media = pa.array([write_pcm(pad(t)) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), media], ["doc_id", "n_bytes", "media"])


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in batch.column("media").to_pylist():
            payload = read_pcm(data)
            streams, _ = parse(data)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(streams)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        own = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *own], [x.split()[0] for x in DIGEST.split(", ")])


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts as a written table of Ogg values: doc_id, n_bytes, media. A null text counts as empty."""
    own = renamed(docs, **{doc_id: "doc_id", text: "text"})
    return materialize(map_arrow(own, _stored, "doc_id long, n_bytes long, media binary"), "media")


def op4(docs: DataFrame) -> DataFrame:
    return map_arrow(store_texts(docs), _digests, DIGEST).select(*[F.col(x.split()[0]) for x in DIGEST.split(", ")])
