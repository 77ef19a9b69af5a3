"""Digests of tables as trees, so that two tables are compared by descending where they differ.

A row is the line ``key:version``. Lines are dealt to leaves by the head of their own
hash; a leaf's digest is that of its lines in order, an inner node's that of its
children's. The tree is as deep as it must be for about ``LEAF`` lines a leaf and has
16 children a node, so no group grows with the table. Equal lines are one line with a
count. Null keys and versions are empty in a line. An empty table is a root of no lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.scratch import written

#: Lines of a leaf, on average at most.
LEAF = 128


def depth_for(n: int, leaf: int = LEAF) -> int:
    """Levels below the root for ``n`` lines."""
    depth = 0
    while n > leaf * 16**depth:
        depth += 1
    return depth


def lines(rows: DataFrame, key: str, version: str) -> DataFrame:
    """(line, hash, n) of the distinct lines."""
    line = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(version).cast("string"), F.lit("")))
    return rows.groupBy(line.alias("line")).agg(F.count("*").alias("n")).withColumn("hash", F.sha2("line", 256))


def tree(found: DataFrame, depth: int) -> DataFrame:
    """(level, prefix, digest, n) of every node over ``lines``: level 0 is the root."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "n"))), lambda x: F.concat(x["line"], F.lit("*"), x["n"].cast("string"))), "\n")
    level = written(found.groupBy(F.substring("hash", 1, depth).alias("prefix")).agg(F.sha2(said, 256).alias("digest"), F.sum("n").alias("n")))
    out = level.withColumn("level", F.lit(depth))
    for d in range(depth - 1, -1, -1):
        said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: F.concat(x["prefix"], F.lit(":"), x["digest"])), "\n")
        level = level.groupBy(F.substring("prefix", 1, d).alias("prefix")).agg(F.sha2(said, 256).alias("digest"), F.sum("n").alias("n"))
        level = written(level) if d % 3 == 0 else level
        out = out.unionByName(level.withColumn("level", F.lit(d)))
    return out.select("level", "prefix", "digest", "n")


def digest_tree(rows: DataFrame, key: str, version: str, depth: int | None = None, leaf: int = LEAF) -> DataFrame:
    """The tree of a table; give two tables the same depth to compare them."""
    found = lines(rows, key, version)
    if depth is None:
        depth = depth_for(rows.count(), leaf)
    return tree(found, depth)


def root(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row: watermark, n. Equal tables, equal watermark."""
    nodes = digest_tree(rows, key, version).where("level = 0")
    return nodes.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("watermark"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def differences(a: DataFrame, b: DataFrame, key: str, version: str, leaf: int = LEAF) -> tuple[DataFrame, int]:
    """Lines (line, n_a, n_b) that two tables don't hold equally often, and how many leaves were opened.

    Only nodes below a differing parent are compared, and only the lines of differing leaves meet.
    """
    depth = depth_for(max(a.count(), b.count()), leaf)
    la, lb = (written(lines(t, key, version)) for t in (a, b))
    ta, tb = tree(la, depth), tree(lb, depth)
    differ = None
    for d in range(depth + 1):
        own = ta.where(F.col("level") == d).select("prefix", F.col("digest").alias("x")).join(tb.where(F.col("level") == d).select("prefix", F.col("digest").alias("y")), "prefix", "full_outer")
        if differ is not None:
            own = own.join(differ.select(F.col("prefix").alias("parent")), F.substring("prefix", 1, d - 1) == F.col("parent"), "left_semi")
        differ = written(own.where(~F.col("x").eqNullSafe(F.col("y"))).select("prefix"))
        if differ.isEmpty():
            break
    opened = differ.count()
    at = lambda t, n: t.join(differ, F.substring("hash", 1, depth) == F.col("prefix"), "left_semi").select("line", F.col("n").alias(n))
    both = at(la, "n_a").join(at(lb, "n_b"), "line", "full_outer").select("line", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return both.where("n_a <> n_b"), opened
