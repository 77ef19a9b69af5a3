"""Mentions of entities by any of their aliases, and what names could mean.

Aliases and texts are compared as lower-case words of letters and digits. One automaton
over all aliases finds every one of them in a single pass over a text. Its aliases are
broadcast, so their characters are counted first: beyond ``MOST_CHARS`` they are dealt
by hash into parts that each stay below, and the texts pass once for each part.

Null or wordless aliases and texts mention nothing. Aliases that equal each other after
this folding are all found; repeated rows of one alias of an entity count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+")
#: Characters of aliases in one automaton.
MOST_CHARS = 16 << 20


def folded(text: str | None) -> str:
    """Lower-case words with a space before and after each."""
    words = WORDS.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


def _automaton(aliases: list[tuple[str, list]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for alias, ids in aliases:
        made.add_word(alias, (len(alias), alias, ids))
    made.make_automaton()
    return made


def _part(texts: DataFrame, key: str, kinds: tuple[str, str], aliases: list[tuple[str, list]]) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(aliases)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _automaton(held.value) if held.value else None
        for batch in batches:
            out = []
            for k, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen: dict[str, tuple] = {}
                for end, (size, alias, ids) in made.iter(folded(text)) if made else ():
                    first, n, _ = seen.get(alias, (end - size + 3, 0, None))
                    seen[alias] = (first, n + 1, ids)
                out += [(k, i, alias.strip(), first, n) for alias, (first, n, ids) in seen.items() for i in ids]
            columns = zip(*out, strict=True) if out else [()] * 5
            names = [key, "entity_id", "alias", "start", "n"]
            types = [batch.schema.field(key).type, None, pa.string(), pa.int64(), pa.int64()]
            types[1] = pa.int64() if kinds[1] == "bigint" else pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return texts.mapInArrow(find, f"{key} {kinds[0]}, entity_id {kinds[1]}, alias string, start long, n long")


def mentions(texts: DataFrame, aliases: DataFrame, key: str, text: str, most_chars: int = MOST_CHARS) -> DataFrame:
    """(key, entity_id, alias, start, n): where in the folded text (which begins with a space) an alias of (entity_id, alias) first stands, from 1, and how often."""
    fold = F.udf(folded)
    names = aliases.select("entity_id", fold("alias").alias("alias")).where("alias <> ''").groupBy("alias").agg(F.array_sort(F.collect_set("entity_id")).alias("ids"))
    size = names.agg(F.sum(F.length("alias") + 8 * F.size("ids"))).first()[0] or 0
    parts = max(1, -(-size * 5 // (4 * most_chars))) if size > most_chars else 1
    rows = texts.select(key, F.col(text).alias("text"))
    kinds = (dict(texts.dtypes)[key], dict(aliases.dtypes)["entity_id"])
    found = []
    for p in range(parts):
        own = names.where(F.pmod(F.xxhash64("alias"), F.lit(parts)) == p) if parts > 1 else names
        found.append(_part(rows, key, kinds, [(r.alias, r.ids) for r in own.collect()]))  # below ``most_chars``
    return reduce(lambda a, b: a.unionByName(b), found)


def candidates(references: DataFrame, aliases: DataFrame) -> DataFrame:
    """References (reference_id, target) with their state and the entities their name could mean: resolved, ambiguous or unresolved."""
    fold = F.udf(folded)
    names = aliases.select(fold("alias").alias("name"), "entity_id").where("name <> ''").distinct()
    held = references.select("reference_id", "target", fold("target").alias("name")).join(names, "name", "left")
    per = held.groupBy("reference_id", "target").agg(F.array_sort(F.collect_set("entity_id")).alias("candidates"))
    n = F.size("candidates")
    return per.select("reference_id", "target", "candidates", F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("state"))


def merge_aliases(aliases: DataFrame, merged: DataFrame) -> DataFrame:
    """Aliases (entity_id, alias) after merges (from_id, into_id): the merged entity's aliases are copied, each once."""
    moved = aliases.join(merged.select(F.col("from_id").alias("entity_id"), "into_id"), "entity_id").select(F.col("into_id").alias("entity_id"), "alias")
    return aliases.select("entity_id", "alias").unionByName(moved).distinct()
