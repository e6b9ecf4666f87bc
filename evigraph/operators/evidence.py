"""How edges and nodes are known: classification, census, verdict, degrees and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.sources.shared import settled

#: Methods with their confidences, and resolutions that count as precise or heuristic.
CONFIDENCE = {"RUNTIME_OBSERVED": 0.95, "STATIC_PROVEN": 0.80, "CONFIG_PROVEN": 0.78, "STATIC_UNRESOLVED": 0.40, "LLM_CONJECTURED": 0.30, "UNKNOWN": 0.20}
CENSUS_METHODS = ("RUNTIME_OBSERVED", "STATIC_PROVEN", "CONFIG_PROVEN", "STATIC_UNRESOLVED", "LLM_CONJECTURED", "UNKNOWN")
PRECISE = ("compiler", "interface-impl", "syntactic-resolved", "exact", "type", "import", "direct")
HEURISTIC = ("convention-name", "dynamic", "heuristic")
PROVEN = ("RUNTIME_OBSERVED", "STATIC_PROVEN", "CONFIG_PROVEN")
#: class_edges() shuffles its edges twice, whole, so it takes them in more slices than others do.
CLASS_SLICES = 6


def edge_method() -> Column:
    """PRJ-03: the first rule that holds names the method; null flags count as false."""
    r = F.col("resolution")
    heuristic = r.isin(*HEURISTIC) | (r.startswith("syntactic") & ~r.isin(*PRECISE))
    return (
        F.when(F.col("observed"), "RUNTIME_OBSERVED")
        .when(F.col("config_proven") | (r == "config"), "CONFIG_PROVEN")
        .when(F.col("synthetic") | heuristic, "STATIC_UNRESOLVED")
        .when(r.isin(*PRECISE), "STATIC_PROVEN")
        .otherwise("UNKNOWN")
    )


def confidence_of(method: Column) -> Column:
    out = F
    for name, value in CONFIDENCE.items():
        out = out.when(method == name, F.lit(value))
    return out


def edge_evidence(edges: DataFrame) -> DataFrame:
    return edges.withColumn("method", edge_method()).withColumn("confidence", confidence_of(F.col("method")))


def from_metadata(edges: DataFrame) -> DataFrame:
    """FN-30: edges(src, dst, rel, metadata: JSON text) -> resolution, synthetic, observed, config_proven, count, refuted (subtype) as edge_method() reads them,
    and broken: metadata that is there and no JSON. A field that is missing, of another type or in broken metadata is null."""
    v = F.try_parse_json("metadata")
    field = lambda path, kind: F.try_variant_get("_v", path, kind)
    e = edges.withColumn("_v", v)
    return e.select(
        "src", "dst", "rel", field("$.resolution", "string").alias("resolution"), *[field(f"$.{k}", "boolean").alias(n) for k, n in (("synthetic", "synthetic"), ("observed", "observed"), ("configProven", "config_proven"))],
        field("$.count", "bigint").alias("count"), field("$.refutation.subtype", "string").alias("refuted"), (F.col("metadata").isNotNull() & F.col("_v").isNull()).alias("broken"),
    )


def existing_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """JOIN-01: edges with both endpoints among the nodes; self loops stay."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def census(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG-03: one row of counts by method over existing raw edges, the total and the observed ratio (0 without edges)."""
    counted = edge_evidence(existing_edges(edges, nodes)).agg(*(F.count_if(F.col("method") == m).alias(m.lower()) for m in CENSUS_METHODS), F.count("*").alias("total"))
    return counted.withColumn("observed_ratio", F.when(F.col("total") > 0, F.round(F.col("runtime_observed") / F.col("total"), 6)).otherwise(0.0))


def verdict(counts: DataFrame) -> DataFrame:
    """AGG-18 on a census row."""
    proven = F.col("runtime_observed") + F.col("static_proven") + F.col("config_proven")
    ratio = lambda x: F.when(F.col("total") > 0, F.round(x / F.col("total"), 6)).otherwise(0.0)
    out = counts.select("runtime_observed", "total", "observed_ratio", ratio(proven).alias("proven_ratio"), ratio(F.col("unknown") + F.col("static_unresolved")).alias("unresolved_ratio"))
    runs = (F.col("runtime_observed") >= 25) | (F.col("observed_ratio") >= 0.05)
    tier = F.when((F.col("observed_ratio") >= 0.15) | ((F.col("proven_ratio") >= 0.45) & runs), "STRONG").when(F.col("proven_ratio") < 0.2, "WEAK").otherwise("MODERATE")
    return out.withColumn("tier", tier)


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG-01: id, in_degree, out_degree over existing edges; one pass over both ends, pre-aggregated."""
    ends = existing_edges(edges, nodes).select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    sums = ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"))


def facets(nodes: DataFrame) -> DataFrame:
    """AGG-02: counts by type, by layer and in all, in one aggregation."""
    layer = F.when(F.col("type") == "VIEW", "presentation").when(F.col("type") == "CONTROLLER", "api").when(F.col("type") == "SERVICE", "domain").when(F.col("type") == "ENTITY", "data").otherwise("infra")
    rows = nodes.withColumn("layer", layer).groupingSets([["type"], ["layer"], []], "type", "layer").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("type", "layer", F.lit("*")).alias("facet"), F.when(F.col("type").isNotNull(), "type").when(F.col("layer").isNotNull(), "layer").otherwise("all").alias("kind"), "n")


def class_rollup(nodes: DataFrame) -> DataFrame:
    """AGG-04: members, sensitivity, heat and entry points of each class."""
    return nodes.groupBy("class_key").agg(
        F.count("*").alias("members"), F.bool_or("sensitive").alias("sensitive"), F.bool_or("runtime_hot").alias("runtime_hot"),
        F.sum(F.when(F.col("runtime_hot"), F.col("hits")).otherwise(0)).alias("hits"), F.count("entry_point").alias("entry_points"), F.min("id").alias("first_member"),
    )


def first_wins(edges: DataFrame) -> DataFrame:
    """GRA-01: one edge per (src, dst, rel), the one with the least seq; a partial minimum, no window."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "rel")]
    return edges.groupBy("src", "dst", "rel").agg(F.min_by(F.struct(*rest), "seq").alias("e")).select("src", "dst", "rel", *(F.col(f"e.{c}") for c in rest))


def class_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between classes: existing ones, without self loops, provenance of the first raw edge, and how many there are.

    Raw edges go to their ends' classes in slices of sources, so that only a slice's shuffles are on disk; what slices leave is as small as the result."""
    key = lambda side: nodes.select(F.col("id").alias(side), F.col("class_key").alias(f"{side}_class"))
    first = lambda p, at: F.min_by(p, at).alias("p")

    def of_classes(part: DataFrame) -> DataFrame:
        both = part.join(key("src"), "src").join(key("dst"), "dst").where("src_class <> dst_class")
        at = F.struct("seq", "src", "dst")
        return both.groupBy("src_class", "dst_class", "rel").agg(first(F.struct("resolution", "synthetic", "observed", "config_proven"), at), F.min(at).alias("at"), F.count("*").alias("n"))

    e = edges.select("src", "dst", "rel", "resolution", "synthetic", "observed", "config_proven", "seq")
    out = settled(e, "class_edges", "src", of_classes, CLASS_SLICES).groupBy(F.col("src_class").alias("src"), F.col("dst_class").alias("dst"), "rel").agg(first(F.col("p"), F.col("at")), F.sum("n").alias("raw_edges"))
    return edge_evidence(out.select("src", "dst", "rel", "raw_edges", "p.*")).select("src", "dst", "rel", "raw_edges", "method")


def node_corroboration(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """UI-01: per touched node its degree, distinct methods, blind edges and best confidence; a self loop touches twice."""
    e = edge_evidence(existing_edges(edges, nodes))
    ends = e.select(F.explode(F.array("src", "dst")).alias("id"), "method", "confidence")
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.count_distinct("method").alias("corroboration"), F.count_if(F.col("method").isin("UNKNOWN", "STATIC_UNRESOLVED")).alias("blind"), F.max("confidence").alias("strongest"))


def isolated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without any existing edge."""
    e = existing_edges(edges, nodes)
    return nodes.select("id", "type").join(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti")


def never_called(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """JOIN-04: nodes that nothing calls and that aren't entry points."""
    called = edges.where("rel = 'CALLS'").select(F.col("dst").alias("id")).distinct()
    return nodes.where("entry_point is null").select("id", "type").join(called, "id", "left_anti")


def merge_overlay(edges: DataFrame, proofs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRA-18..20: proven edges upgrade equal ones and are added otherwise; those with unknown endpoints mint nodes.

    Returns (edges with `origin`: kept, upgraded or added; minted node ids)."""
    key = ["src", "dst", "rel"]
    left = first_wins(edges).select(*key, "resolution")
    right = proofs.groupBy(*key).agg(F.min("resolution").alias("proof"))
    merged = left.join(right, key, "full_outer").select(*key, F.coalesce("proof", "resolution").alias("resolution"), F.when(F.col("proof").isNull(), "kept").otherwise("proven").alias("origin"))
    minted = proofs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return merged, minted


def node_evidence(nodes: DataFrame) -> DataFrame:
    """PRJ-04: a node that ran is observed; any other stands in the code, so it is proven."""
    method = F.when(F.coalesce("runtime_hot", F.lit(False)), "RUNTIME_OBSERVED").otherwise("STATIC_PROVEN")
    return nodes.withColumn("method", method).withColumn("confidence", confidence_of(F.col("method")))


#: Ways in which an edge is refuted; any other word stands for the second.
REFUTED = ("REFUTED_LIKELY_DEAD", "REFUTED_UNREACHABLE_BY_ROBOT")


def refutation(subtype: Column, bare: Column, attempts: Column, reason: Column) -> Column:
    """PRJ-05: struct(subtype, attempts, reason) of a refuted edge; `bare`: only said to be refuted; null for others."""
    kind = F.when(subtype == REFUTED[0], REFUTED[0]).otherwise(REFUTED[1])
    known = F.coalesce(subtype, F.lit("")) != ""
    full = F.struct(kind.alias("subtype"), F.when(attempts >= 0, attempts).alias("attempts"), F.nullif(F.trim(reason), F.lit("")).alias("reason"))
    only = F.struct(F.lit(REFUTED[1]).alias("subtype"), F.when(F.lit(False), attempts).alias("attempts"), F.lit(None).cast("string").alias("reason"))
    return F.when(known, full).when(bare, only)


def neighbours(edges: DataFrame) -> DataFrame:
    """PRJ-02: per source how many nodes it calls, writes and reads."""
    of = lambda rel: F.count_distinct(F.when(F.col("rel") == rel, F.col("dst")))
    return edges.groupBy("src").agg(of("CALLS").alias("callees"), of("WRITES_ENTITY").alias("written"), of("READS_ENTITY").alias("read"))


def facts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG-16: one row: nodes, existing edges, isolated and hot nodes, and the share of nodes that take part in an edge."""
    e = existing_edges(edges, nodes)
    n = nodes.join(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("linked", F.lit(True)), "id", "left")
    out = n.agg(F.count("*").alias("nodes"), F.count_if(F.col("linked").isNull()).alias("isolated"), F.count_if("runtime_hot").alias("hot"), F.round(F.count("linked") / F.count("*"), 4).alias("participation"))
    return out.withColumn("edges", e.agg(F.count("*")).scalar())
