"""Running sums and rows before, within keys of any size.

A window over a key sorts all its rows in one task. Here rows are dealt by ranges of
(key, order), so a large key is spread over many tasks; each task's part of a key is
windowed alone, and what parts hand on to the next, one row for each part of a key,
is windowed after. Keys are compared with nulls equal. Order must tell a key's rows
apart where the result is to be unique.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.sources.scratch import written


def dealt(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_part``, the number of the range that they lie in: equal (by, order) share one."""
    return written(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))


def _joined(rows: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    named = carried.withColumnsRenamed({c: f"_{c}" for c in by} | {"_part": "__part"})
    same = [rows["_part"] == named["__part"], *(rows[c].eqNullSafe(named[f"_{c}"]) for c in by)]
    return rows.join(named, reduce(lambda a, b: a & b, same)).drop("__part", *(f"_{c}" for c in by))


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``position`` in their key, from 1, and ``before``, the sum of ``value`` over the rows before."""
    held = dealt(rows, by, order)
    own = Window.partitionBy(*by, "_part").orderBy(*order)
    parts = held.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of a key
    zero = F.lit(0)
    parts = parts.withColumns({"_rows": F.coalesce(F.sum("_n").over(earlier), zero), "_sum": F.coalesce(F.sum("_s").over(earlier), zero)}).drop("_n", "_s")
    inner = held.withColumns({"_at": F.row_number().over(own), "_own": F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, -1)), zero)})
    out = _joined(inner, parts, by)
    return out.withColumns({"position": (F.col("_at") + F.col("_rows")).cast("long"), "before": F.col("_own") + F.col("_sum")}).drop("_part", "_at", "_own", "_rows", "_sum")


def previous(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``previous``, a struct of the row before in their key; null for the first."""
    held = dealt(rows, by, order)
    row, place = F.struct(*columns), F.struct(*order)
    own = Window.partitionBy(*by, "_part").orderBy(*order)
    last = held.groupBy(*by, "_part").agg(F.max_by(row, place).alias("_last"))
    last = last.withColumn("_last", F.lag("_last").over(Window.partitionBy(*by).orderBy("_part")))  # a row for each part of a key
    inner = held.withColumns({"_at": F.row_number().over(own), "_own": F.lag(row).over(own)})
    return _joined(inner, last, by).withColumn("previous", F.when(F.col("_at") == 1, F.col("_last")).otherwise(F.col("_own"))).drop("_part", "_at", "_own", "_last")
