"""The folder that the driver and all executors see."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset and Spark runs in one process, and an error where it doesn't."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="evigraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path in it that nothing has yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark's setting that removes the shuffle files of a query when it ends; without it they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: settled() takes larger tables in so many slices: what one takes on disk is gone before the next one comes. Each reads the input again.
SLICES, SLICE_ROWS = 3, 4_000_000


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside leave no shuffle files."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def settled(df: DataFrame, label: str, by: str | None = None, work: Callable[[DataFrame], DataFrame] = lambda x: x, slices: int = SLICES) -> DataFrame:
    """work(df) as a Parquet table in the shared folder, read again. It is compressed, which a checkpoint isn't, and the shuffle files go with the query.

    by: a column within whose values `work` stays. Then df is taken in up to `slices` slices of its values, one after another."""
    spark = df.sparkSession
    path = scratch(spark, label)
    slices = min(slices, math.ceil(df.count() / SLICE_ROWS)) if by else 1
    with dropping_shuffles(spark):
        for i in range(max(1, slices)):
            out = work(df if slices < 2 else df.where(F.pmod(F.xxhash64(by, F.lit(slices)), F.lit(slices)) == i))
            out.write.mode("append").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
