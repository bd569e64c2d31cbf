"""Shared helpers of the training-data operators: inputs, shared scratch tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. The cluster names it in ``spark.checkpoint.dir``;
    only where that is unset (local tests) a folder of our own is used."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodestrata-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scratch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a query when it ends under this setting.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, and a
    lost executor takes no part of it along. The shuffle files of the write go with it."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove scratch tables that no later plan reads (through the cluster's own file system)."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_slices(column: pa.Array) -> list[memoryview | None]:
    """UTF-8 bytes of a string or binary column without copies; None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [memoryview(x.as_buffer()) if x.is_valid else None for x in column]
