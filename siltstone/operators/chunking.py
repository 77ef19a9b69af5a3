"""Blocks to chunks within a token budget."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.schemas import CHUNK

CJK = re.compile("[ᄀ-ᇿ⺀-⿕々〇〡-〩〸-〻ぁ-ゖゝ-ゟァ-ヺヽ-ヿㄱ-ㆎㇰ-ㇿ㐀-䶿一-鿿ꥠ-ꥼ가-힣豈-龎ｦ-ﾝ\U00020000-\U000323af]")
BLANK = re.compile(r"[\s﻿]")
#: Characters of chunks that a task holds as Python objects before it hands them on.
HELD = 1 << 20
SENTENCE = re.compile(r"(?<=[。！？.!?])\s*")


class Cost:
    """Token estimates of growing texts, in one pass over each part."""

    @staticmethod
    def parts(text: str) -> tuple[int, int]:
        cjk = len(CJK.findall(text))
        return cjk, len(BLANK.sub("", text)) - cjk

    @staticmethod
    def total(parts: tuple[int, int]) -> int:
        return parts[0] + -(-parts[1] // 4)


def estimate(text: str) -> int:
    return Cost.total(Cost.parts(text))


def _fill(parts: list[str], budget: int, joint: str) -> Iterator[str]:
    """Parts joined as long as they fit; blanks cost nothing, so a joint doesn't."""
    held: list[str] = []
    cost = (0, 0)
    for part in parts:
        own = Cost.parts(part)
        both = (cost[0] + own[0], cost[1] + own[1])
        if held and Cost.total(both) > budget:
            yield joint.join(held)
            held, both = [], own
        held.append(part)
        cost = both
    if held:
        yield joint.join(held)


def _fine(parts: list[str], budget: int, joint: str, finer) -> Iterator[str]:
    """Like _fill, where parts beyond the budget are cut finer by ``finer``."""
    run: list[str] = []
    for part in parts:
        if estimate(part) <= budget:
            run.append(part)
            continue
        yield from _fill(run, budget, joint)
        run = []
        yield from finer(part)
    yield from _fill(run, budget, joint)


def split_text(text: str, budget: int) -> list[str]:
    """Pieces of at most ``budget`` tokens: whole if it fits, else by lines, by sentences, by characters."""
    if estimate(text) <= budget:
        return [text]

    def characters(piece: str) -> Iterator[str]:
        return _fill(list(piece), budget, "")

    def sentences(line: str) -> Iterator[str]:
        pieces = [p for p in SENTENCE.split(line) if p]
        return _fine(pieces, budget, "", characters) if len(pieces) > 1 else characters(line)

    return list(_fine(text.split("\n"), budget, "\n", sentences))


def chunk_blocks(blocks: list[dict], most: int, overlap: int) -> list[dict]:
    """Greedy packing; a chunk begins with the last blocks of the one before, as far as ``overlap`` and the next block allow."""
    groups: list[list[dict]] = []
    held: deque[tuple[int, dict]] = deque()
    used = 0
    for block in blocks:
        for piece in split_text(block["text"], most):
            item = block | {"text": piece}
            cost = estimate(piece)
            if held and used + cost > most:
                groups.append([b for _, b in held])
                tail, spare = deque(), overlap
                for c, b in reversed(held):
                    if c > spare:
                        break
                    tail.appendleft((c, b))
                    spare -= c
                held, used = tail, sum(c for c, _ in tail)
                while held and used + cost > most:
                    used -= held.popleft()[0]
            held.append((cost, item))
            used += cost
    if held:
        groups.append([b for _, b in held])
    seen: Counter = Counter()
    out = []
    for ordinal, group in enumerate(groups):
        text = "\n\n".join(b["text"] for b in group).strip()
        path = next((list(b["heading_path"]) for b in reversed(group) if len(b["heading_path"])), [])
        key = " > ".join(path)
        kinds = {b["kind"] for b in group}
        out.append(
            {
                "ordinal": ordinal, "content_text": text, "content_hash": hashlib.sha256(text.encode()).hexdigest(),
                "block_kind": kinds.pop() if len(kinds) == 1 else "composite", "token_estimate": estimate(text), "heading_path": path,
                "source_start_line": min(b["source_start_line"] for b in group), "source_end_line": max(b["source_end_line"] for b in group),
                "anchor_key": hashlib.sha256(f"{key}\n{seen[key]}".encode()).hexdigest(),
            }
        )
        seen[key] += 1
    return out


def chunk(documents: DataFrame, most: int = 800, overlap: int = 80, key: str = "document_id", key_type: str = "string") -> DataFrame:
    """CHUNK rows for each document of (key, blocks). A document is one row, so nothing is shuffled; one at a time is held as Python objects."""
    kind = f"{key} {key_type}, {CHUNK}"
    schema = to_arrow_schema(T.StructType.fromDDL(kind))
    names = ["kind", "text", "heading_path", "source_start_line", "source_end_line"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, every = b.column(0), b.column(1).value_lengths(), b.column(1).flatten()
            columns = dict(zip((f.name for f in every.type), every.flatten(), strict=True))
            at, found, held = 0, [], 0
            for k, size in zip(keys, sizes, strict=True):
                n = size.as_py() or 0
                values = (columns[c].slice(at, n).to_pylist() for c in names)
                made = chunk_blocks([dict(zip(names, v, strict=True)) for v in zip(*values, strict=True)], most, overlap)
                found += [{key: k.as_py()} | c for c in made]
                at, held = at + n, held + sum(len(c["content_text"]) for c in made)
                if held >= HELD:
                    yield pa.RecordBatch.from_pylist(found, schema)
                    found, held = [], 0
            yield pa.RecordBatch.from_pylist(found, schema)

    used = F.transform("blocks", lambda x: F.struct(*[x[c].alias(c) for c in names]))
    return documents.select(key, used.alias("blocks")).mapInArrow(rows, kind)


def line_blocks(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Blank-line-free paragraphs: one block per line with words, as (key, block_no, line, text)."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line_text"))
    return lines.where(F.trim("line_text") != "").select(key, (F.col("at") + 1).alias("line"), F.trim("line_text").alias("text"))


def line_documents(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, blocks) for ``chunk``, a block for each line with words; made inside the row."""
    block = lambda x, i: F.struct(
        F.lit("paragraph").alias("kind"), x.alias("text"), F.expr("cast(array() as array<string>)").alias("heading_path"),
        (i + 1).alias("source_start_line"), (i + 1).alias("source_end_line"), F.expr("cast(map() as map<string,string>)").alias("metadata"),
    )
    return texts.select(key, F.filter(F.transform(F.split(text, "\n"), block), lambda b: F.trim(b["text"]) != "").alias("blocks"))
