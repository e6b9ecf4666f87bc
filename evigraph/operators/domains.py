"""Domains: communities of the graph by label propagation without hubs, and the seams between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators.fixpoint import cut


def undirected(edges: DataFrame) -> DataFrame:
    """a, b in both directions, once each, without self loops."""
    both = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return edges.where("src <> dst").select(F.explode(both).alias("e")).select("e.*").distinct()


def hubs(links: DataFrame, hub_share: float) -> DataFrame:
    """id, degree of nodes with more neighbours than the quantile `hub_share` of all nodes that have any."""
    degree = links.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    return degree.where(F.col("degree") > degree.agg(F.percentile("degree", F.lit(hub_share))).scalar())


#: Hashes by which neighbourhoods are compared.
SKETCH = 16


def weighted(links: DataFrame) -> DataFrame:
    """undirected() with w: 1, and one more for each of SKETCH hashes whose least value among the neighbours of both ends is the same. So links within a crowd
    weigh more than a bridge between two; nothing is paired but the ends of a link."""
    sketch = links.groupBy("a").agg(F.array(*[F.min(F.xxhash64("b", F.lit(i))) for i in range(SKETCH)]).alias("s"))
    j = links.join(sketch, "a").join(sketch.toDF("b", "t"), "b")
    return j.select("a", "b", (1 + F.size(F.filter(F.zip_with("s", "t", lambda x, y: x == y), lambda x: x))).alias("w"))


def propagate(links: DataFrame) -> DataFrame:
    """id, label: labels from which no node would part. links: weighted().

    Each node begins with its own label and wants the one with most weight among its neighbours, the least on ties, if it has more than its own. Of two
    neighbours of which one wants what the other is about to give up, only one moves, by a hash that changes each round. So every move
    puts more weight between equal labels, and that ends by itself; labels that swing to and fro can't arise. A round is four joins
    on the links; labels are a table."""
    links = cut(links)
    labels = cut(links.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("label")))
    turn = 0
    while True:
        votes = links.join(labels.toDF("b", "label"), "b").groupBy("a", "label").agg(F.sum("w").alias("n"))
        own = labels.toDF("a", "own")
        wants = votes.join(own, "a").groupBy("a", "own").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("label").alias("label"))).alias("best"), F.coalesce(F.max(F.when(F.col("label") == F.col("own"), F.col("n"))), F.lit(0)).alias("stay"))
        wants = cut(wants.where(-F.col("best.k") > F.col("stay")).select("a", "own", F.col("best.label").alias("want"), F.xxhash64("a", F.lit(turn)).alias("rank")))
        if not wants.take(1):
            return labels
        pairs = links.join(wants, "a").join(wants.toDF("b", "own_b", "want_b", "rank_b"), "b").where("own_b = want or own = want_b").where("rank_b > rank or rank_b = rank and b > a")
        moves = wants.join(pairs.select("a").distinct(), "a", "left_anti").select(F.col("a").alias("id"), "want")
        labels = cut(labels.join(moves, "id", "left").select("id", F.coalesce("want", "label").alias("label")))
        turn += 1


def detect(edges: DataFrame, nodes: DataFrame, least: int = 4, hub_share: float = 0.99) -> DataFrame:
    """GRA-15: id, domain (its least member), hub: communities of `least` nodes or more; null for hubs, which bind nothing together, and for the rest."""
    ids = nodes.select("id").distinct()
    links = undirected(edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi"))
    hub = cut(hubs(links, hub_share).select("id"))
    calm = links.join(hub.toDF("a"), "a", "left_anti").join(hub.toDF("b"), "b", "left_anti")
    labels = propagate(weighted(calm))
    named = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("domain")).where(F.col("n") >= least)
    found = labels.join(named, "label").select("id", "domain")
    return ids.join(found, "id", "left").join(hub.withColumn("is_hub", F.lit(True)), "id", "left").select("id", "domain", F.coalesce("is_hub", F.lit(False)).alias("hub"))


def summary(found: DataFrame) -> DataFrame:
    """GRA-15: domain, size, name: the package that most members have (the last part of an id before its class), the least on ties."""
    d = found.where("domain is not null")
    parts = F.split(F.element_at(F.split("id", ":"), -1), r"\.")
    names = d.withColumn("name", F.coalesce(F.get(parts, F.size(parts) - 2), F.col("id"))).groupBy("domain", "name").agg(F.count("*").alias("n"))
    return names.groupBy("domain").agg(F.sum("n").alias("size"), F.min_by("name", F.struct((-F.col("n")).alias("k"), "name")).alias("name"))


def seams(edges: DataFrame, found: DataFrame) -> DataFrame:
    """GRA-15: one, other (domains, the lesser first), edges between them, whichever way."""
    d = found.where("domain is not null").select("id", "domain")
    e = edges.join(d.toDF("src", "x"), "src").join(d.toDF("dst", "y"), "dst").where("x <> y")
    return e.groupBy(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("other")).agg(F.count("*").alias("edges"))
