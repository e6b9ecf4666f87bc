"""Ordered walks and subgraphs from an entry or a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators import evidence, fixpoint
from evigraph.sources.shared import settled

#: Relations that a mechanism follows, those that touch data, and methods that count as verified.
FLOW = ("CALLS", "READS_ENTITY", "WRITES_ENTITY", "RUNTIME_OBSERVED")
DATA = ("READS_ENTITY", "WRITES_ENTITY", "RUNTIME_OBSERVED")
WALKABLE = ("RUNTIME_OBSERVED", "STATIC_PROVEN")


def first_ways(edges: DataFrame, most: int) -> DataFrame:
    """src, k, dst, rel, ways: of each source the first `most` ways on (its edges, first wins) in their order: observed ones first, then by target and
    relation; k: the place in it, ways: how many there are in all."""
    e = edges.where(F.col("rel").isin(*FLOW)).select("src", "dst", "rel", "seq", F.coalesce("observed", F.lit(False)).alias("ran"))
    order = Window.partitionBy("src").orderBy(F.desc("ran"), "dst", "rel")

    def ranked(part: DataFrame) -> DataFrame:
        first = part.repartition("src").groupBy("src", "dst", "rel").agg(F.min_by("ran", "seq").alias("ran"))
        return first.select("src", F.row_number().over(order).alias("k"), "dst", "rel", F.count("*").over(Window.partitionBy("src")).alias("ways")).where(F.col("k") <= most)

    return settled(e, "ways", "src", ranked)


def mechanism(edges: DataFrame, roots: DataFrame, max_depth: int = 6, max_steps: int = 60) -> DataFrame:
    """GRA-10: root, order, src, dst, rel, depth: the edges a breadth-first walk takes, by level, then source, observed ones first,
    then target and relation. A root whose walk is full goes no further, since what lies deeper comes later.

    A node's place is how many edges come before its own, so no root's edges are gathered: a row is made for those that are taken."""
    flow = first_ways(edges, max_steps)
    ways = flow.where("k = 1").select(F.col("src").alias("node"), "ways")
    frontier, seen, placed = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).cast("long").alias("taken")).distinct(), None, []
    for depth in range(max_depth):
        by_root = Window.partitionBy("root")
        before = F.col("taken") + F.coalesce(F.sum("ways").over(by_root.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        level = frontier.join(ways, "node", "left").withColumn("ways", F.coalesce("ways", F.lit(0)))
        level = level.select("root", "node", F.lit(depth).cast("long").alias("depth"), "ways", before.alias("before"), (F.col("taken") + F.sum("ways").over(by_root)).alias("taken"))
        level = settled(level.where((F.col("taken") < max_steps) | ((F.col("before") < max_steps) & (F.col("ways") > 0))), "level")
        placed.append(level.where((F.col("before") < max_steps) & (F.col("ways") > 0)))
        # all ways of a node that is gone on from are there, since its root's walk isn't full
        going = level.where(F.col("taken") < max_steps).select("root", "node", "depth", "taken")
        seen = going if seen is None else seen.unionByName(going)
        if depth + 1 == max_depth or not going.take(1):
            break
        found = going.join(flow.where(F.col("ways") < max_steps).select("src", "dst"), F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(depth + 1).cast("long").alias("depth"), "taken")
        new = found.unionByName(seen).repartition("root").groupBy("root", "node").agg(F.min("depth").alias("depth"), F.max("taken").alias("taken"))
        frontier = settled(new.where(F.col("depth") == depth + 1).select("root", "node", "taken"), "frontier")
    steps = placed[0]
    for more in placed[1:]:
        steps = steps.unionByName(more)
    order = F.col("before") + F.col("k")
    return steps.drop("ways", "taken").join(flow.drop("ways"), F.col("node") == F.col("src")).where(order <= max_steps).select("root", order.alias("order"), "src", "dst", "rel", "depth")


def branches(steps: DataFrame) -> DataFrame:
    """GRA-10: nodes of a walk with more than one way on."""
    return steps.groupBy("root", "src").agg(F.count("*").alias("ways")).where("ways > 1")


def runtime_order(steps: DataFrame, operations: DataFrame) -> DataFrame:
    """GRA-12: steps(root, order, label, rel) moved by operations(root, table, rank): data steps whose target is an observed table
    come first in the order of execution, the others follow in their own; renumbered as `order`, with `rank`."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    first = operations.groupBy("root", "table").agg(F.min("rank").alias("rank"))
    ranks = first.groupBy("root", norm("table").alias("key")).agg(F.max("rank").alias("rank"))
    s = steps.withColumn("key", F.when(F.col("rel").isin(*DATA), norm("label"))).join(ranks, ["root", "key"], "left")
    w = Window.partitionBy("root").orderBy(F.col("rank").asc_nulls_last(), "order")
    return s.select("root", F.row_number().over(w).cast("long").alias("order"), F.col("order").alias("was"), "label", "rel", "rank")


def resolve_entry(nodes: DataFrame, query: str) -> DataFrame:
    """GRA-11: the id asked for, else the least id that holds the text, runtime routes and then routes first; none: no row."""
    hit = F.contains(F.lower("id"), F.lit(query.lower()))
    rank = F.when(F.col("id") == query, 0).when(F.startswith("id", F.lit("route:runtime:")), 1).when(F.startswith("id", F.lit("route:")), 2).otherwise(3)
    return nodes.where((F.col("id") == query) | hit).select("id", rank.alias("r")).orderBy("r", "id").limit(1).select("id")


def narrative(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """GRA-22: the edges between a symbol's nodes (id) and all that depend on them: src, dst, rel, verdict, method, confidence.

    walkable: observed or statically proven; refuted: `refuted` is set and it was never observed. Others are left out. One row per
    edge, its first by seq. Paths are followed over the existing edges."""
    e = evidence.edge_evidence(evidence.existing_edges(edges, nodes))
    radius = fixpoint.widest(e, seeds).select(F.col("node").alias("id"))
    near = e.join(radius.toDF("src"), "src", "left_semi").join(radius.toDF("dst"), "dst", "left_semi")
    verdict = F.when(F.col("refuted") & (F.col("method") != "RUNTIME_OBSERVED"), "refuted").when(F.col("method").isin(*WALKABLE), "walkable")
    near = near.withColumn("verdict", verdict).where("verdict is not null")
    return near.groupBy("src", "dst", "rel").agg(F.min_by(F.struct("verdict", "method", "confidence"), "seq").alias("f")).select("src", "dst", "rel", "f.*")
