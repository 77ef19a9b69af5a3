"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Targets are words per source: a share of all words by weight, held to ``most``
times what the source has, the excess shared again. Within a source, document
rates between 0 and ``most`` are those of least relative entropy to equal rates
under the source's token constraint: r = most / (1 + exp(-lambda * size / mean)),
exponentially tilted by size. The dual's lambda is found by Newton steps kept
within a bracket; each step is one grouped aggregation over (source, size) cells,
so a source that holds a third of all rows is reduced before it moves.

Rates become whole copies without chance: within a source, cells in order of size
take the whole numbers that their running sum of rates passes, which leaves an
error of the order of the longest document; then one pass from long to short
documents adds or removes the copies that fit into the error. Within a cell the
copies go to documents in order of a salted hash, by counting, so a cell of any
size is spread over tasks of at most about SALTED rows. Sums that decide are
decimal, so reruns agree. The sizes that a source's documents have meet in one
row: their number is bounded by the longest text, not by the rows.

Nulls and empties: a null text has no words; a null source is a source of its
own, last in order; documents without words are taken with zero words. Repeated
rows are mixed as separate documents; where they are written out, rows equal in
doc_id, text and source stand for each other. Texts of any length are counted
whole. An empty table gives no rows. Extra columns are ignored, or kept where
documents are repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import WORD, materialize, renamed

#: Parts that the documents of one cell are spread over: this many, or one for each SALTED rows of the table.
SALTS, SALTED = 64, 1 << 20
#: Rounds after which the loops give up with an error; both end far earlier, when nothing changes any more.
MOST_STEPS, MOST_SHARES = 200, 10_000

DECIMAL = "decimal(38,6)"


def word_count(text: Column | str, pattern: str = WORD) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents' sizes, without their texts, as a written table."""
    own = renamed(docs, **{doc_id: "doc_id", text: "text", source: "source"})
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    return materialize(own.select("doc_id", F.xxhash64("text", "source").alias("e"), "source", key.alias("key"), word_count("text").alias("size")), "sizes")


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``no``, a source's place in code-point order, null last: counted by range partitions, not in one task."""
    ordered = sources.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").sortWithinPartitions("last", "source")
    placed = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "sources")
    placed = placed.withColumn("part", F.shiftright("at", 33)).withColumn("local", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range partition
    bases = bases.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(bases), "part").withColumn("no", F.col("base") + F.col("local")).drop("part", "local", "at", "base", "last")


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """key, source_size, target: water-filled shares by weight under the cap."""
    sources = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    table = numbered(sources).select("key", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap"))
    table = materialize(table, "targets")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    for _ in range(MOST_SHARES):
        capped = F.col("cap") <= F.col("weight") * F.lit(level)
        row = table.agg(
            F.coalesce(F.sum(F.when(capped, F.col("cap")).cast(DECIMAL)), F.lit(0)).cast("double").alias("held"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight")).cast(DECIMAL)), F.lit(0)).cast("double").alias("weight"),
        ).first()
        if not row.weight or (new := max(0.0, total - row.held) / row.weight) <= level:
            break
        level = new
    else:
        raise RuntimeError(f"shares did not settle in {MOST_SHARES} rounds")
    return table.select("key", "source_size", "cap", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def tilts(cells: DataFrame, wanted: DataFrame, most: float) -> DataFrame:
    """key, mean, lambda for every source whose target is above zero and below its cap."""
    means = cells.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    none = F.lit(None).cast("double")
    state = wanted.where("target > 0 and target < cap").join(means, "key")
    state = materialize(state.select("key", "mean", "target", F.lit(0.0).alias("tilt"), none.alias("low"), none.alias("high"), F.lit(False).alias("done")), "tilt")
    for _ in range(MOST_STEPS):
        if state.where("not done").isEmpty():
            break
        z = F.col("size") / F.col("mean")
        rate = F.lit(most) / (1 + F.exp(-F.col("tilt") * z))
        mass = F.col("n") * F.col("size") * rate
        sums = cells.join(state.where("not done"), "key").groupBy("key").agg(
            F.sum(mass.cast(DECIMAL)).cast("double").alias("taken"),
            F.sum((mass * z * (1 - rate / F.lit(most))).cast(DECIMAL)).cast("double").alias("slope"),
        )
        at = state.join(sums, "key", "left").withColumn("off", F.col("taken") - F.col("target"))
        at = at.withColumn("high", F.when(F.col("off") > 0, F.col("tilt")).otherwise(F.col("high"))).withColumn("low", F.when(F.col("off") < 0, F.col("tilt")).otherwise(F.col("low")))
        newton = F.col("tilt") - F.col("off") / F.when(F.col("slope") > 0, F.col("slope"))
        inside = newton.isNotNull() & ~F.isnan(newton) & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        outside = F.when(F.col("high").isNull(), F.col("tilt") * 2 + 1).when(F.col("low").isNull(), F.col("tilt") * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        held = F.col("done") | F.coalesce(F.abs("off") <= F.greatest(F.lit(0.5), F.col("target") * 1e-9), F.lit(False))
        step = F.when(held, F.col("tilt")).when(inside & (F.abs(newton - F.col("tilt")) < 50), newton).otherwise(outside)
        state = materialize(at.select("key", "mean", "target", step.alias("tilt"), "low", "high", held.alias("done")), "tilt")
    else:
        raise RuntimeError(f"tilts did not settle in {MOST_STEPS} steps")
    return state.select("key", "mean", "tilt")


def cell_copies(cells: DataFrame, wanted: DataFrame, tilt: DataFrame, most: float) -> DataFrame:
    """key, size, n, m: how many copies all documents of a cell get together."""
    z = F.col("size") / F.col("mean")
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= F.col("cap"), F.lit(most)).otherwise(F.lit(most) / (1 + F.exp(-F.col("tilt") * z)))
    rated = cells.join(wanted, "key").join(tilt, "key", "left").withColumn("expected", F.col("n") * rate)
    upto = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    passed = F.floor(F.sum("expected").over(upto) + 0.5)
    order = Window.partitionBy("key").orderBy(F.desc("size"))
    first = rated.withColumn("passed", passed)
    first = first.withColumn("m", F.col("passed") - F.coalesce(F.lag("passed").over(order), F.lit(0)))
    first = first.withColumn("m", F.least(F.col("m"), F.floor(F.col("n") * F.lit(most))))
    first = materialize(first.select("key", "size", "n", "target", "m"), "copies")

    off = first.groupBy("key").agg((F.first("target") - F.sum(F.col("m") * F.col("size"))).alias("off"))
    room = F.when(F.col("off") > 0, F.floor(F.col("n") * F.lit(most)) - F.col("m")).otherwise(F.col("m"))
    fits = first.join(off, "key").withColumn("room", room).where("room > 0 and size <= abs(off)")
    listed = fits.groupBy("key").agg(F.first("off").alias("off"), F.sort_array(F.collect_list(F.struct("size", "room")), asc=False).alias("cells"))
    start = F.struct(F.abs("off").alias("left"), F.expr("cast(array() as array<struct<size:bigint,k:bigint>>)").alias("picks"))

    def pick(acc: Column, cell: Column) -> Column:
        k = F.least(cell["room"], F.floor(acc["left"] / cell["size"]))
        one = F.array(F.struct(cell["size"].alias("size"), k.alias("k")))
        return F.struct((acc["left"] - k * cell["size"]).alias("left"), F.when(k > 0, F.concat(acc["picks"], one)).otherwise(acc["picks"]).alias("picks"))

    picked = listed.select("key", F.signum("off").cast("long").alias("sign"), F.explode(F.aggregate("cells", start, pick)["picks"]).alias("p"))
    picked = picked.select("key", F.col("p.size").alias("size"), (F.col("p.k") * F.col("sign")).alias("more"))
    return first.join(picked, ["key", "size"], "left").select("key", "size", "n", (F.col("m") + F.coalesce("more", F.lit(0))).alias("m"))


def mix(sizes: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, e, source, size, source_size, target, copies for every row of ``sized``.

    ``most`` bounds a document's copies and a source's target; it should be whole.
    """
    wanted = targets(sizes, weights, share, most)
    cells = materialize(sizes.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")), "cells")
    copies = cell_copies(cells, wanted, tilts(cells, wanted, most), most)

    salts = max(SALTS, -(-sizes.count() // SALTED))
    sizes = sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "e"), F.lit(salts)))
    salted = sizes.groupBy("key", "size", "salt").agg(F.count("*").alias("own"))
    before = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salted = salted.withColumn("base", F.coalesce(F.sum("own").over(before), F.lit(0)))
    salted = salted.join(copies, ["key", "size"], "left").join(wanted.select("key", "source_size", "target"), "key")
    rank = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy(F.xxhash64("doc_id"), "doc_id", "e")) - 1
    ranked = sizes.withColumn("rank", rank).join(salted.drop("own"), ["key", "size", "salt"])
    more = (F.col("base") + F.col("rank") < F.col("m") % F.col("n")).cast("long")
    number = F.coalesce(F.floor(F.col("m") / F.col("n")) + more, F.lit(0))
    return ranked.select("doc_id", "e", "source", "size", "source_size", "target", number.alias("copies"))


def repeated(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` as the mix takes them: a document's row as often as it has copies, with all its columns.

    Rows equal in doc_id, text and source come as often as all of them together,
    in the likeness of one.
    """
    none = F.lit(-(1 << 63))
    copies = mix(sized(docs), weights, share, most).groupBy(F.coalesce("doc_id", none).alias("d"), "e")
    copies = materialize(copies.agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"), "taken")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    taken = docs.select(row, F.coalesce("doc_id", none).alias("d"), F.xxhash64("text", "source").alias("e")).join(copies, ["d", "e"])
    again = copies.where("rows > 1")
    if not again.isEmpty():
        taken = taken.where("rows = 1").unionByName(taken.where("rows > 1").dropDuplicates(["d", "e"]))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op5(docs: DataFrame) -> DataFrame:
    out = mix(sized(docs), [3, 1, 2], share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
