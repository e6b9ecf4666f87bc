"""Structured Streaming over the events table: the batch operators on a stream, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import runtime
from evigraph.plans.adapters import FRAMES
from evigraph.sources.shared import scratch


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def spans(stream: DataFrame) -> DataFrame:
    """The stream of events as spans, by the same SQL as the batch frame."""
    return stream.sparkSession.sql(FRAMES["spans"].replace("from events", "from {events}"), events=stream)


def table_hits(stream: DataFrame) -> DataFrame:
    """STR-02 on a stream of spans: the batch operator, with a state per table."""
    return runtime.table_hits(stream)


def windowed(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type; rows later than the watermark are dropped in append mode."""
    w = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("began"), "event_type", "n")


def run_available(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now; the last state is written to the shared folder by foreachBatch and read back."""
    spark = result.sparkSession
    folder = scratch(spark, "stream")
    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")
