"""Sources and sinks other than the named tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None, **options) -> DataFrame:
    """parquet, orc, csv, json or text files; hive-style folders give partition columns."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists", **options) -> None:
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_table(df: DataFrame, name: str, bucket_by: tuple[int, list[str]] | None = None, mode: str = "errorifexists") -> None:
    """A catalog table; with buckets, later joins and groupings on these columns need no exchange."""
    writer = df.write.mode(mode).format("parquet")
    if bucket_by:
        n, columns = bucket_by
        writer = writer.bucketBy(n, *columns).sortBy(*columns)
    writer.saveAsTable(name)


def cached(df: DataFrame) -> DataFrame:
    """df kept as columnar batches in memory, or on disk where they don't fit."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


_scratch: dict[str, SparkSession] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names, or on a single machine in its temporary one; deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    at = f"{base.rstrip('/')}/quern-scratch-{uuid.uuid4().hex}"
    _scratch[at] = spark
    return at


@atexit.register
def _at_end() -> None:
    for at, spark in _scratch.items():
        with contextlib.suppress(Exception):  # the session may have ended before
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
