"""Managed copies and backups: files as ranges of bytes with chained digests.

A backup is two tables under one root. ``ranges`` has every file's bytes in pieces of
``RANGE``: (path, no, bytes). ``manifest`` has a row for each file: path, size, number
of pieces and ``chain``, the digest of the digests of its pieces in order. Copying and
verifying work piece by piece; only digests of one file's pieces ever meet. A restore
verifies everything first, into a root of its own, and refuses if anything is missing,
surplus or changed. Empty files have no pieces and the chain of none.

Paths are kept relative; one that is absolute or climbs out of its folder is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = 1 << 20


def safe(path: Column) -> Column:
    """The path, or an error if it leaves its folder."""
    bad = path.rlike(r"(^|[/\\])\.\.([/\\]|$)") | path.rlike(r"^([/\\]|[A-Za-z]:)") | path.contains("\u0000") | (path == "") | path.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("path leaves its folder: "), F.coalesce(path, F.lit("null"))))).otherwise(path)


def ranges(entries: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, no, bytes) of entries (logical_path, content)."""
    pieces = F.ceil(F.length("content") / size).cast("int")
    numbers = F.when(pieces > 0, F.sequence(F.lit(0), pieces - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    each = entries.select(safe(F.col("logical_path")).alias("path"), "content", F.explode(numbers).alias("no"))
    return each.select("path", "no", F.substr("content", F.col("no") * size + 1, F.lit(size)).alias("bytes"))


def manifest(pieces: DataFrame) -> DataFrame:
    """(path, size, n, chain) of files with pieces."""
    each = pieces.select("path", "no", F.length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("digest"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("no", "digest"))), lambda x: F.concat_ws(":", x["no"].cast("string"), x["digest"]))
    return each.groupBy("path").agg(F.sum("size").alias("size"), F.count("*").cast("int").alias("n"), F.sha2(F.array_join(ordered, "\n"), 256).alias("chain"))


class Backup:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def take(self, entries: DataFrame, size: int = RANGE) -> None:
        """Copy entries (logical_path, content); a root is used once."""
        pieces = ranges(entries, size)
        pieces.write.mode("errorifexists").parquet(f"{self.root}/ranges")
        own = entries.select(safe(F.col("logical_path")).alias("path"), F.length("content").cast("long").alias("size"))
        # digests of what was read, not of what was written: the copy is held against its source
        held = own.join(manifest(pieces).drop("size"), "path", "left")
        none = F.sha2(F.lit(""), 256)
        held.select("path", "size", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("chain", none).alias("chain")).write.parquet(f"{self.root}/manifest")

    def issues(self) -> DataFrame:
        """(path, issue) of files that aren't as the manifest says: missing, surplus or changed."""
        want = self.spark.read.parquet(f"{self.root}/manifest")
        have = manifest(self.spark.read.parquet(f"{self.root}/ranges")).select("path", F.col("size").alias("s"), F.col("n").alias("m"), F.col("chain").alias("c"))
        both = want.join(have, "path", "full_outer")
        same = (F.col("size") == F.coalesce("s", F.lit(0))) & (F.col("n") == F.coalesce("m", F.lit(0))) & (F.col("chain") == F.coalesce("c", F.sha2(F.lit(""), 256)))
        issue = F.when(F.col("size").isNull(), "surplus").when((F.col("n") > 0) & F.col("m").isNull(), "missing").when(~same, "changed")
        return both.select("path", issue.alias("issue")).where("issue is not null")

    def restore(self) -> DataFrame:
        """(logical_path, content) of every file; ``ValueError`` unless all are whole. Only one file's pieces meet in a row."""
        if bad := self.issues().take(1):
            raise ValueError(f"the backup is not whole: {bad[0].path} is {bad[0].issue}")
        pieces = self.spark.read.parquet(f"{self.root}/ranges")
        joined = F.transform(F.array_sort(F.collect_list(F.struct("no", "bytes"))), lambda x: x["bytes"])
        empty = F.lit(b"")
        whole = pieces.groupBy("path").agg(F.aggregate(joined, empty, lambda a, b: F.concat(a, b)).alias("content"))
        files = self.spark.read.parquet(f"{self.root}/manifest").select("path")
        return files.join(whole, "path", "left").select(F.col("path").alias("logical_path"), F.coalesce("content", empty).alias("content"))


class Managed:
    """Contents by hash: equal bytes are kept once, and a path is only a name in a table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, source: str, entries: DataFrame) -> DataFrame:
        """Copy a source's entries (logical_path, content); returns (logical_path, blob_sha256). Contents that are there are not written again."""
        named = entries.select(safe(F.col("logical_path")).alias("logical_path"), F.sha2("content", 256).alias("blob_sha256"), "content")
        new = named.select("blob_sha256", "content").dropDuplicates(["blob_sha256"])
        if self._there("blobs"):
            new = new.join(self.blobs().select("blob_sha256"), "blob_sha256", "left_anti")
        new.write.mode("append").parquet(f"{self.root}/blobs")
        named.drop("content").write.mode("errorifexists").parquet(f"{self.root}/entries/source={source}")
        return self.spark.read.parquet(f"{self.root}/entries/source={source}")

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def blobs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/blobs")
