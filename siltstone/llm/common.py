"""What the operators share: reading tables, shared scratch tables, batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
BLANK = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset and all runs
    on this machine, a temporary folder is made and set; elsewhere it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/siltstone-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read any more."""
    for table_ in tables:
        spark = table_.sparkSession
        files = table_.inputFiles()
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent() if files else None
        if path is not None and path.getName().startswith("siltstone-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this library's scratch tables; call it when results are written."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(top, "siltstone-*")) or []:
        fs.delete(status.getPath(), True)


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns (own name: this library's), under this library's names.

    Operators begin with this, so extra columns of the input can't clash.
    """
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()])


def release_memory() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def map_arrow(df: DataFrame, rows: Callable[[Batches], Batches], schema) -> DataFrame:
    """``mapInArrow`` whose worker, which later tasks share, keeps no freed memory between tasks."""

    def task(batches: Batches) -> Batches:
        try:
            yield from rows(batches)
        finally:
            release_memory()

    return df.mapInArrow(task, schema)
