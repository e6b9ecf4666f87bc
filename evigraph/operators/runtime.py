"""Operators over spans of traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def root_spans(spans: DataFrame) -> DataFrame:
    """WIN-06: the root of each trace: its first gateway span, else its first span."""
    order = F.struct(F.when(F.col("service") == "gateway", 0).otherwise(1).alias("g"), "start_ts", "span_id")
    return spans.groupBy("trace_id").agg(F.min_by(F.struct("span_id", "route", "service"), order).alias("r")).select("trace_id", "r.*")


def route_pairs(spans: DataFrame) -> DataFrame:
    """STR-01: per root route its traces, tables, and when last seen."""
    roots = root_spans(spans).select("trace_id", "route")
    return spans.drop("route").join(roots, "trace_id").groupBy("route").agg(F.count_distinct("trace_id").alias("traces"), F.count_distinct("table_name").alias("tables"), F.count("*").alias("spans"), F.max("start_ts").alias("last_seen"))


def table_hits(spans: DataFrame) -> DataFrame:
    """STR-02: spans and traces per table; works on a stream as well (without the distinct count)."""
    return spans.where("table_name is not null").groupBy("table_name").agg(F.count("*").alias("hits"), F.max("start_ts").alias("last_seen"))


def first_touch(spans: DataFrame) -> DataFrame:
    """WIN-04: the order in which a trace first touches its tables, from 0."""
    first = spans.where("table_name is not null").groupBy("trace_id", "table_name").agg(F.min(F.struct("start_ts", "span_id")).alias("at"))
    return first.select("trace_id", "table_name", (F.row_number().over(Window.partitionBy("trace_id").orderBy("at")) - 1).cast("long").alias("rank"))


def richest_trace(spans: DataFrame) -> DataFrame:
    """WIN-05: the trace with most table spans of each route; ties go to the least id."""
    n = spans.where("table_name is not null").groupBy("route", "trace_id").agg(F.count("*").alias("n"))
    return n.groupBy("route").agg(F.min_by(F.struct("trace_id", "n"), F.struct((-F.col("n")).alias("k"), "trace_id")).alias("b")).select("route", "b.trace_id", "b.n")


def carry_forward(previous: DataFrame, fresh: DataFrame, ttl_days: int = 7) -> DataFrame:
    """STR-03: last-known-good: fresh rows win; earlier ones are carried as stale while younger than ttl_days before the newest fresh row."""
    newest = fresh.agg(F.max("last_seen")).scalar()
    p = previous.select("table_name", F.col("hits").alias("h"), F.col("last_seen").alias("l"))
    j = p.join(fresh, "table_name", "full_outer")
    out = j.select("table_name", F.coalesce("hits", "h").alias("hits"), F.coalesce("last_seen", "l").alias("last_seen"), F.col("last_seen").isNull().alias("stale"))
    return out.where(~F.col("stale") | (F.col("last_seen") >= newest - F.make_dt_interval(days=F.lit(ttl_days))))


def chao(incidence: DataFrame) -> DataFrame:
    """AGG-24: seen, f1, f2 and the Chao2 estimate over (occasion, item) rows."""
    t = incidence.agg(F.count_distinct("occasion")).scalar()
    per = incidence.distinct().groupBy("item").agg(F.count("*").alias("k"))
    c = per.agg(F.count("*").alias("seen"), F.count_if(F.col("k") == 1).alias("f1"), F.count_if(F.col("k") == 2).alias("f2"))
    c = c.withColumn("t", t)
    return c.select("seen", "f1", "f2", F.round(F.col("seen") + (F.col("t") - 1) / F.col("t") * F.col("f1") * (F.col("f1") - 1) / (2 * (F.col("f2") + 1)), 4).alias("estimate"))


def innermost(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """JOIN-07: for each point (doc, p) the range (doc, lo, hi, name) that holds it, half-open; the innermost wins.

    A range lies in one or two cells of the power of two that its length doesn't exceed; a point looks into its own cell of each
    size that its document has. So what is compared is about as much as what matches, however many ranges a document has."""
    size = F.ceil(F.log2(F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))).cast("int")
    cell = lambda x: F.expr(f"shiftright({x}, size)")
    r = ranges.where("hi > lo").withColumn("size", size)
    placed = r.withColumn("cell", F.explode(F.array_distinct(F.array(cell("lo"), cell("hi - 1")))))
    p = points.distinct().join(r.select("doc", "size").distinct(), "doc").withColumn("cell", cell("p"))
    j = p.join(placed, ["doc", "size", "cell"]).where("p >= lo and p < hi")
    return j.groupBy("doc", "p").agg(F.max_by("name", F.struct("lo", (-F.col("hi")).alias("h"), "name")).alias("name"))
