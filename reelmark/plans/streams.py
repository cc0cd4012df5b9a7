"""Helpers of the stream queries: tables as streams of several batches, and streams drained into tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.tables import own_dir
from ..streaming import jobs

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs the RocksDB provider."""
    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def as_stream(spark: SparkSession, df: DataFrame, batches: int = 1) -> DataFrame:
    """The rows of a table as a file stream that comes in about ``batches`` micro-batches."""
    # A file is a task of its batch.
    path, files = new_folder(spark, "source"), max(2, spark.sparkContext.defaultParallelism)
    (df if batches == 1 else df.repartition(files * batches)).write.parquet(path)
    reader = spark.readStream.schema(df.schema)
    if batches > 1:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def in_order(spark: SparkSession, df: DataFrame, order: str, batches: int = 3) -> DataFrame:
    """The rows of a table as a file stream in ``batches`` micro-batches, each later in ``order`` than the ones before."""
    path, files = new_folder(spark, "source"), 2
    at = F.col(order).cast("double") if dict(df.dtypes)[order] != "timestamp_ntz" else F.col(order).cast("timestamp").cast("double")
    cuts = df.agg(F.percentile_approx(at, [i / batches for i in range(1, batches)], F.lit(10_000))).first()[0]
    edges = [float("-inf"), *(cuts or []), float("inf")]
    for low, high in zip(edges, edges[1:], strict=False):
        # One write after the other: the source takes files in the order in which they came.
        df.filter((at > low) & (at <= high)).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    path = new_folder(spark, "stream")
    with state_settings(spark):
        jobs.run_to_table(stream, path, mode)
    return spark.read.parquet(f"{path}/data")
