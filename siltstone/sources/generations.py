"""Generations: tables written whole, checked, and then made current by one pointer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources import digests


class GenerationStore:
    """Versions of a table under one folder, of which a one-row pointer names the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, generation: str) -> str:
        return f"{self.root}/gen={generation}"

    def write(self, generation: str, rows: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """A new version; one that exists is never overwritten."""
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self._path(generation))
        return self.read(generation)

    def activate(self, generation: str, check: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Make a version current if ``check`` finds no bad rows in it; the one before is kept."""
        if check and not (bad := check(self.read(generation))).isEmpty():
            raise ValueError(f"generation {generation} has bad rows, such as {bad.first()}")
        pointer = self.spark.createDataFrame([(generation, self.current())], "generation string, previous string")
        # written whole beside the old one, which then makes way: at any moment one of the two can be read
        pointer.coalesce(1).write.mode("overwrite").json(f"{self.root}/pointer-next")
        fs, old = self._at("pointer")
        _, new = self._at("pointer-next")
        fs.delete(old, True)
        fs.rename(new, old)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def current(self) -> str | None:
        for name in ("pointer", "pointer-next"):
            fs, path = self._at(f"{name}/_SUCCESS")
            if fs.exists(path):
                return self.spark.read.schema("generation string").json(f"{self.root}/{name}").first().generation
        return None

    def read(self, generation: str | None = None) -> DataFrame:
        found = generation or self.current()
        if found is None:
            raise LookupError(f"{self.root} has no current generation")
        return self.spark.read.parquet(self._path(found))

    def refresh(self, generation: str, fresh: DataFrame, key: str) -> DataFrame:
        """A new version in which rows of the keys in ``fresh`` are replaced, as by a partial rebuild."""
        old = self.read().join(fresh.select(key).distinct(), key, "left_anti")
        return self.write(generation, old.unionByName(fresh))


def upsert(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``fresh`` in place of those with their keys."""
    return current.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def insert_ignore(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``fresh`` only where their keys are new."""
    return current.unionByName(fresh.dropDuplicates(keys).join(current.select(*keys).distinct(), keys, "left_anti"))


def watermark(rows: DataFrame, key: str, version: str) -> DataFrame:
    """watermark, n: a digest of all ``key:version`` lines: equal inputs, equal digest. See ``digests`` for tables that differ."""
    return digests.root(rows, key, version)


def manifest(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """A snapshot's entries and changes as JSON lines under one content hash, for ``write.text``."""
    rows = entries.select(F.lit("entry").alias("part"), F.to_json(F.struct(*sorted(entries.columns))).alias("json"))
    return rows.unionByName(changes.select(F.lit("change").alias("part"), F.to_json(F.struct(*sorted(changes.columns))).alias("json")))


def backup_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Every file under a folder with its size and hash; compare two of these to verify a copy."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def graphml(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Lines of a GraphML document in order: (no, value), from (node_id, label) and (subject, predicate, object)."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="predicate" for="edge" attr.name="predicate" attr.type="string"/><graph edgedefault="directed">'
    spark = nodes.sparkSession
    node = F.concat(F.lit('<node id="'), esc(F.col("node_id")), F.lit('"><data key="label">'), esc(F.coalesce("label", F.lit(""))), F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="'), esc(F.col("subject")), F.lit('" target="'), esc(F.col("object")), F.lit('"><data key="predicate">'), esc(F.col("predicate")), F.lit("</data></edge>"))
    ends = spark.createDataFrame([(0, head), (3, "</graph></graphml>")], "no int, value string")
    return ends.unionByName(nodes.select(F.lit(1).alias("no"), node.alias("value"))).unionByName(relations.select(F.lit(2).alias("no"), edge.alias("value"))).orderBy("no", "value")


def json_ld(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """One JSON-LD object per node with its outgoing relations."""
    out = relations.groupBy(F.col("subject").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("predicate", "object"))).alias("relations"))
    pairs = F.transform("relations", lambda r: F.create_map(r["predicate"], r["object"]))
    joined = nodes.join(out, "node_id", "left")
    return joined.select(F.to_json(F.struct(F.col("node_id").alias("@id"), F.col("label").alias("name"), pairs.alias("relations"))).alias("value"))
