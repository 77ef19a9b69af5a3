"""Quality rules as a learned decision list, in DataFrame and SQL functions only.

``statistics`` counts a text's words, symbols and repetitions inside the row with
array functions, so nothing is shuffled however a text repeats. ``learn`` runs
sequential covering on labelled statistics: it grows a conjunction of thresholds
by FOIL gain, prunes its tail on held-out rows, takes what it covers away, and
goes on; every count is one aggregation over the labelled table, and only counts
reach the driver. ``verdict`` turns the list into one CASE expression.

Nulls and empties: a null text has no words. A label of null is no label; without
labels the list is empty and rejects nothing. Repeated rows are separate rows. An
empty table gives no rows. Extra columns are ignored. Two different word triples
count as one only if their 64-bit hashes agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import BLANK, materialize, renamed

SYMBOLS = "#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks"]


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts named in STATISTICS."""
    own = renamed(docs, **{doc_id: "doc_id", text: "text"}).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    solid = F.regexp_replace("text", BLANK, "")
    some = lambda x: F.length(F.regexp_replace(x, BLANK, "")) > 0
    first = own.select(
        "doc_id",
        F.filter(F.split("text", BLANK), lambda x: F.length(x) > 0).alias("words"),
        F.filter(F.split("text", "\n"), some).alias("lines"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", "\\p{Lu}", ""))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("long").alias("n_marks"),
    )
    counts = ["word_chars", "n_symbols", "n_upper", "n_marks"]
    n = F.size("words")
    # each 3-word window's hash with its place; sorted, equal windows stand side by side
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))))
    second = first.select(
        "doc_id", *counts, n.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.coalesce(windows, F.expr("cast(array() as array<struct<h:bigint,i:int>>)"))).alias("sorted"),
    )
    twin = F.filter(
        "sorted",
        lambda s, k: F.coalesce(F.get("sorted", k - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get("sorted", k + 1)["h"] == s["h"], F.lit(False)),
    )
    third = second.select("doc_id", *counts, "n_words", "n_lines", "n_dup_lines", F.array_sort(F.transform(twin, lambda s: s["i"])).alias("twins"))
    # windows in order of place: each adds the words up to its end that the one before has not reached
    reach = F.aggregate(
        "twins",
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct((i + 2).alias("end"), (a["n"] + F.least(F.lit(3), i + 2 - a["end"])).alias("n")),
    )["n"]
    return third.withColumn("n_repeat_words", reach).select("doc_id", *STATISTICS)


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))


#: What rules are made of: a ratio of counts and the thresholds tried, on a fixed readable grid.
FEATURES: dict[str, tuple[str, str, list[float]]] = {
    "symbols a word": ("n_symbols", "n_words", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 1.5, 2.0]),
    "exclamation marks a word": ("n_marks", "n_words", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 1.5]),
    "capitals a character": ("n_upper", "word_chars", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8]),
    "repeated words": ("n_repeat_words", "n_words", [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45]),
    "repeated lines": ("n_dup_lines", "n_lines", [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7]),
    "characters a word": ("word_chars", "n_words", [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 12.0, 15.0]),
    "words a line": ("n_words", "n_lines", [2.0, 4.0, 8.0, 16.0, 64.0, 256.0]),
}


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        a, b, _ = FEATURES[self.feature]
        value = _ratio(a, b)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Literal, ...]
LITERALS = [Literal(f, above, t) for f, (_, _, grid) in FEATURES.items() for t in grid for above in (True, False)]


def covers(rule: Rule) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & literal.column()
    return out


def base_failed() -> Column:
    """The fixed rules: fewer than 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn(labelled: DataFrame, most_rules: int = 12, most_literals: int = 4, precision: float = 0.97, support: int = 3, hold_out: int = 3) -> list[Rule]:
    """An ordered list of conjunctions that reject, from STATISTICS and ``bad`` (boolean).

    One row in ``hold_out``, by doc_id hash, prunes; a rule is taken if there and
    in growth at least ``precision`` of what it covers is bad, and ``support`` rows are.
    """
    table = labelled.where("bad is not null").withColumn("prune", F.pmod(F.xxhash64("doc_id"), F.lit(hold_out)) == 0)
    table = materialize(table.select(*STATISTICS, "bad", "prune"), "labelled")
    rules: list[Rule] = []
    for _ in range(most_rules):
        left = table.where(~F.coalesce(_any(rules), F.lit(False))) if rules else table
        rule: Rule = ()
        grow = left.where(~F.col("prune"))
        p0, n0 = _counts(grow, [()])[0]
        while p0 and n0 and len(rule) < most_literals:
            options = [lit for lit in LITERALS if lit not in rule]
            best, gain = None, 0.0
            for literal, (p, n) in zip(options, _counts(grow.where(covers(rule)), [(x,) for x in options]), strict=True):
                value = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                if value > gain + 1e-9:
                    best, gain, counts = literal, value, (p, n)
            if best is None:
                break
            rule, (p0, n0) = (*rule, best), counts
        if not rule:
            break
        heads = [rule[:k] for k in range(1, len(rule) + 1)]
        held = _counts(left.where("prune"), heads)
        worth = [((p - n) / (p + n) if p + n else -1.0, -k) for k, (p, n) in enumerate(held)]
        rule = heads[-max(worth)[1]]
        (p, n) = _counts(left, [rule])[0]
        if p < support or p < precision * (p + n):
            break
        rules.append(rule)
    return rules


def _any(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | covers(rule)
    return out


def _counts(rows: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
    """For each rule the bad and the good rows that it covers, in one aggregation."""
    columns = []
    for i, rule in enumerate(rules):
        columns += [F.count_if(covers(rule) & F.col("bad")).alias(f"p{i}"), F.count_if(covers(rule) & ~F.col("bad")).alias(f"n{i}")]
    row = rows.agg(*columns).first()
    return [(row[f"p{i}"], row[f"n{i}"]) for i in range(len(rules))]


def verdict(rules: list[Rule]) -> Column:
    """True: kept. The first rule that covers a row decides."""
    out = None
    for rule in rules:
        out = (F if out is None else out).when(covers(rule), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """Statistics with base_failed and kept for every row of ``docs``, and the list learned from ``labels`` (doc_id, quality)."""
    table = materialize(statistics(docs), "statistics")
    known = labels.where("quality is not null").groupBy("doc_id").agg((F.max("quality") == 0).alias("bad"))
    rules = learn(table.where(~base_failed()).join(known, "doc_id"))
    out = table.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out, _ = judged(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
