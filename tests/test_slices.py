"""Large tables are taken in slices: the result is that of the whole, and no shuffle files stay behind."""

from pyspark.sql import functions as F

from evigraph.operators import evidence, fixpoint
from evigraph.sources import shared


def _graph(spark):
    nodes = spark.range(300).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("string").alias("class_key"))
    of = lambda x: (x % 300).cast("string")
    no = F.lit(False)
    edges = spark.range(2000).select(of(F.col("id") * 31).alias("src"), of(F.col("id") * 17 + 5).alias("dst"), F.lit("CALLS").alias("rel"), F.when(F.col("id") % 2 == 0, "compiler").alias("resolution"), no.alias("synthetic"), (F.col("id") % 5 == 0).alias("observed"), no.alias("config_proven"), F.lpad(F.col("id").cast("string"), 6, "0").alias("seq"))
    return edges, nodes


def test_class_edges_in_slices(spark, monkeypatch):
    edges, nodes = _graph(spark)
    whole = sorted(map(tuple, evidence.class_edges(edges, nodes).collect()), key=repr)
    monkeypatch.setattr(shared, "SLICE_ROWS", 300)
    sliced = sorted(map(tuple, evidence.class_edges(edges, nodes).collect()), key=repr)
    assert sliced == whole and len(whole) > 20


def test_checkpoints_leave_no_shuffle_files(spark):
    edges, nodes = _graph(spark)
    live = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    before = live()
    fixpoint.cut(edges.groupBy("src", "dst").agg(F.min("seq")).repartition("src"))
    assert live() <= before
