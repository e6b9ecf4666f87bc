"""What a snapshot of the graph or the catalog says of itself, and what changed since the one before.

nodes(id, type, class_name, sensitive, entry_point, observed); edges(src, dst, rel); operators name what they need beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.operators import fixpoint
from evigraph.operators.evidence import REFUTED

#: Types that hold data or contracts, and types that are reached from outside of the code.
STRUCTURAL, SURFACES = ("ENTITY", "INTERFACE", "SUPERTYPE"), ("CONTROLLER", "ROUTE", "VIEW")
TIERS = {"isolated": 0.75, "runtime-refuted": 0.7, "no-proven-caller": 0.4}
EXCLUSIONS = ("entry-point", "entry-surface", "runtime-observed", "unreachable-by-robot", "import-reachable")
#: Weights of readiness.
WEIGHTS = {"endpoints": 30, "routes": 15, "security": 25, "entities": 15, "controllers": 15}


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 of nothing."""
    return F.when(whole == 0, 0).otherwise(half_up(part * 100 / whole)).cast("long")


def liveness(edges: DataFrame, nodes: DataFrame, imported: DataFrame | None = None, configured: DataFrame | None = None) -> DataFrame:
    """GRA-13: id, type, verdict: a tier of dead code, a reason why a node isn't accused, or null for one that lives or is no code.

    edges(src, dst, refuted: how an active run refuted the edge, or null); nodes(id, type, entry_point, observed, source_file); imported(file) are files
    that others import, configured(file) are started directly. An edge into a function file::name counts for the file as well. Nodes that were
    observed live; those that are reached from outside are no candidates; without an edge inwards, being imported, started or an entry
    point excuses; with edges inwards, all of them must be refuted as dead, and one that no robot can reach excuses."""
    sep = F.locate("::", F.col("dst"))
    ins = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"), F.count_if(F.col("refuted") == REFUTED[0]).alias("n_dead"), F.count_if(F.col("refuted") == REFUTED[1]).alias("n_robot"))
    outs = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    parents = edges.where(sep > 1).select(F.substring_index("dst", "::", 1).alias("id")).distinct().withColumn("credited", F.lit(True))
    n = nodes.join(ins, "id", "left").join(outs, "id", "left").join(parents, "id", "left").na.fill(0, ["n_in", "n_out", "n_dead", "n_robot"])
    for name, files in (("is_imported", imported), ("is_configured", configured)):
        if files is None:
            n = n.withColumn(name, F.lit(False))
        else:
            n = n.join(files.select(F.col("file").alias("source_file"), F.lit(True).alias(name)).distinct(), "source_file", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    entry, called = F.col("entry_point").isNotNull(), (F.col("n_in") > 0) | yes("credited")
    verdict = (
        F.when(F.col("type").isin(*STRUCTURAL), None)
        .when(yes("observed"), F.when((F.col("n_in") == 0) & ~entry, "runtime-observed"))
        .when(F.col("type").isin(*SURFACES), F.when(F.col("n_in") == 0, "entry-surface"))
        .when(~called & yes("is_imported"), "import-reachable")
        .when(~called & (yes("is_configured") | entry), "entry-point")
        .when(~called, F.when(F.col("n_out") == 0, "isolated").otherwise("no-proven-caller"))
        .when(F.col("n_robot") > 0, "unreachable-by-robot")
        .when((F.col("n_in") > 0) & (F.col("n_dead") == F.col("n_in")), "runtime-refuted")
    )
    return n.select("id", "type", verdict.alias("verdict"))


def dead_code(judged: DataFrame, excluded: Observation | None = None) -> DataFrame:
    """GRA-13: liveness() -> id, type, tier, confidence of candidates. `excluded` is told, in the pass that finds them, how many nodes each reason excused."""
    if excluded is not None:
        judged = judged.observe(excluded, *[F.count_if(F.col("verdict") == x).alias(x) for x in EXCLUSIONS])
    confidence = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])[F.col("verdict")]
    return judged.where(F.col("verdict").isin(*TIERS)).select("id", "type", F.col("verdict").alias("tier"), confidence.alias("confidence"))


def hot_entities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG-19: id, table, kind (minted: only seen at run time; resolved), infrastructure, orphan (resolved, without a static edge inwards), hits: entities that
    ran, by themselves or by an edge that was observed. edges(dst, observed); nodes(id, type, class_name, table_name, observed, synthetic, runtime_only, hits)."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    by_edge = edges.groupBy(F.col("dst").alias("id")).agg(F.bool_or(yes("observed")).alias("hot_edge"), F.bool_or(~yes("observed")).alias("static_edge"))
    e = nodes.where("type = 'ENTITY'").join(by_edge, "id", "left").where(yes("observed") | yes("hot_edge"))
    minted = yes("synthetic") & yes("runtime_only")
    table = F.when(F.col("id").startswith("table:"), F.substr(F.col("id"), F.lit(7))).otherwise(F.coalesce(F.nullif("table_name", F.lit("")), "class_name", "id"))
    return e.select("id", table.alias("table"), F.when(minted, "minted").otherwise("resolved").alias("kind"), (minted & text.is_infrastructure(table)).alias("infrastructure"), (~minted & ~yes("static_edge")).alias("orphan"), F.when(F.col("hits") > 0, F.col("hits")).alias("hits"))


def blind_impact(hot: DataFrame) -> DataFrame:
    """AGG-19: hot_entities() -> one row: measurable, observed, resolved, minted, minted_ratio, both without infrastructure, orphans. Nothing observed is not
    measured, and not a ratio of 0."""
    a = hot.agg(F.count("*").alias("observed"), F.count_if(F.col("kind") == "resolved").alias("resolved"), F.count_if(F.col("kind") == "minted").alias("minted"), F.count_if("infrastructure").alias("infra"), F.count_if("orphan").alias("orphans"))
    ratio = lambda part, whole: F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))
    rest = F.col("observed") - F.col("infra")
    return a.select((F.col("observed") > 0).alias("measurable"), "observed", "resolved", "minted", ratio(F.col("minted"), F.col("observed")).alias("minted_ratio"), rest.alias("observed_own"), ratio(F.col("minted") - F.col("infra"), rest).alias("minted_ratio_own"), "orphans")


def hubs(edges: DataFrame, nodes: DataFrame, top: int = 15) -> DataFrame:
    """AGG-16: the entities that most edges lead to: id, dependents, sensitive; ties by id."""
    d = nodes.where("type = 'ENTITY'").join(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("dependents")), "id", "left")
    return d.select("id", F.coalesce("dependents", F.lit(0)).cast("long").alias("dependents"), F.coalesce("sensitive", F.lit(False)).alias("sensitive")).orderBy(F.desc("dependents"), "id").limit(top)


def fact_sheet(edges: DataFrame, nodes: DataFrame, snapshot_at: Column | None = None, now: Column | None = None) -> DataFrame:
    """AGG-16: (section, key, n): layers (endpoints and modules by their id, else by type), relations, views, components and composables that take part,
    totals, isolated nodes that are no entry points, and the snapshot's age in seconds (0 at least)."""
    linked = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("linked", F.lit(True))
    layer = F.when(F.col("id").startswith("wsv1:"), "ENDPOINT").when(F.col("id").startswith("node:"), "NODE_MODULE").otherwise(F.col("type"))
    n = nodes.join(linked, "id", "left").select(layer.alias("layer"), "type", F.col("linked").isNotNull().alias("linked"), F.col("entry_point").isNotNull().alias("entry"))
    row = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.alias("key"), value.cast("long").alias("n"))
    taking = n.agg(*[F.count_if((F.col("type") == t) & F.col("linked")).alias(t) for t in ("VIEW", "COMPONENT", "COMPOSABLE")], F.count("*").alias("nodes"), F.count_if(~F.col("linked") & ~F.col("entry")).alias("isolated"))
    flat = taking.select(F.explode(F.array(
        *[F.struct(F.lit("participation").alias("s"), F.lit(t).alias("k"), F.col(t).alias("n")) for t in ("VIEW", "COMPONENT", "COMPOSABLE")],
        F.struct(F.lit("totals").alias("s"), F.lit("nodes").alias("k"), F.col("nodes").alias("n")), F.struct(F.lit("totals").alias("s"), F.lit("isolated").alias("k"), F.col("isolated").alias("n")),
    )).alias("x"))
    by_rel = edges.groupBy("rel").agg(F.count("*").alias("c"))
    parts = [
        row(n.groupBy("layer").agg(F.count("*").alias("c")), "layer", F.col("layer"), F.col("c")),
        row(by_rel, "relation", F.col("rel"), F.col("c")),
        row(edges.agg(F.count("*").alias("c")), "totals", F.lit("edges"), F.col("c")),
        flat.select(F.col("x.s").alias("section"), F.col("x.k").alias("key"), F.col("x.n").cast("long").alias("n")),
    ]
    if snapshot_at is not None and now is not None:
        age = half_up(F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(snapshot_at.cast("timestamp")) / 1e6)
        parts.append(row(edges.sparkSession.range(1), "provenance", F.lit("freshness_seconds"), F.greatest(F.lit(0), age)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


Graph = tuple[DataFrame, DataFrame]


def drift(before: Graph, after: Graph) -> DataFrame:
    """GRA-16: (section, key, before, after) of two graphs (edges, nodes): how many nodes and edges, those that went and came, types whose number
    changed, and isolated nodes."""
    (e1, n1), (e2, n2) = before, after
    key = ["src", "dst", "rel"]

    def moved(a: DataFrame, b: DataFrame, on: list[str], name: str) -> DataFrame:
        x = a.select(*on).distinct().withColumn("a", F.lit(1)).join(b.select(*on).distinct().withColumn("b", F.lit(1)), on, "full_outer")
        x = x.agg(F.count_if(F.col("b").isNull()).alias("gone"), F.count_if(F.col("a").isNull()).alias("new"), F.count("a").alias("na"), F.count("b").alias("nb"))
        rows = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), u.alias("before"), v.alias("after")) for s, k, u, v in (("count", name, F.col("na"), F.col("nb")), (name, "removed", F.col("gone"), F.lit(0).cast("long")), (name, "added", F.lit(0).cast("long"), F.col("new")))])
        return x.select(F.explode(rows).alias("x")).select("x.*")

    types = n1.groupBy("type").agg(F.count("*").alias("before")).join(n2.groupBy("type").agg(F.count("*").alias("after")), "type", "full_outer").na.fill(0, ["before", "after"]).where("before <> after")
    alone = lambda e, n: n.select("id").distinct().join(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti").agg(F.count("*"))
    isolated = e1.sparkSession.range(1).select(F.lit("isolated").alias("section"), F.lit("nodes").alias("key"), alone(e1, n1).scalar().alias("before"), alone(e2, n2).scalar().alias("after"))
    return moved(n1, n2, ["id"], "nodes").unionByName(moved(e1, e2, key, "edges")).unionByName(types.select(F.lit("type").alias("section"), F.col("type").alias("key"), "before", "after")).unionByName(isolated)


def coupling(before: Graph, after: Graph) -> DataFrame:
    """GRA-16: id, before, after, pct of nodes of both graphs to which another number of edges leads; percent half up, 999 if there were none before."""
    (e1, n1), (e2, n2) = before, after
    into = lambda e, name: e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias(name))
    both = n1.select("id").distinct().join(n2.select("id").distinct(), "id")
    j = both.join(into(e1, "before"), "id", "left").join(into(e2, "after"), "id", "left").na.fill(0, ["before", "after"]).where("before <> after")
    return j.withColumn("pct", F.when(F.col("before") > 0, half_up((F.col("after") - F.col("before")) * 100 / F.col("before"))).otherwise(F.lit(999).cast("long")))


def coupling_delta(before: Graph, after: Graph, top: int = 10) -> DataFrame:
    """TOP-04: the `top` of coupling() that changed most; ties by id."""
    return coupling(before, after).orderBy(F.desc(F.abs(F.col("after") - F.col("before"))), "id").limit(top)


def service_cycles(graph: Graph) -> DataFrame:
    """component (its least member), node: services that call one another in a circle."""
    e, n = graph
    services = n.where("type = 'SERVICE'").select("id").distinct()
    calls = e.where("rel = 'CALLS'").join(services.toDF("src"), "src", "left_semi").join(services.toDF("dst"), "dst", "left_semi")
    parts = fixpoint.strong_components(calls, services)
    return parts.join(parts.groupBy("component").agg(F.count("*").alias("size")).where("size >= 2").select("component"), "component", "left_semi")


def new_cycles(before: Graph, after: Graph) -> DataFrame:
    """GRA-17: component, size of circles of services that weren't there before with the same members. Circles are compared by the number and the hashes of
    their members, so that none is gathered in one row."""
    signature = lambda g: service_cycles(g).groupBy("component").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("hash"))
    return signature(after).join(signature(before), ["component", "size", "hash"], "left_anti").select("component", "size")


def drift_findings(before: Graph, after: Graph, most: int = 20, top: int = 10) -> DataFrame:
    """GRA-17: subtype, severity, identifier, before, after: new circles of services (the first `most` by their least member), and among the `top` changes
    of coupling those that rose by 5 and by half or more."""
    cycles = new_cycles(before, after).orderBy("component").limit(most)
    c = cycles.select(F.lit("new-cycle").alias("subtype"), F.lit("medium").alias("severity"), F.col("component").alias("identifier"), F.lit(0).cast("long").alias("before"), F.col("size").alias("after"))
    d = coupling_delta(before, after, top).where("after - before >= 5 and pct >= 50")
    return c.unionByName(d.select(F.lit("coupling-spike").alias("subtype"), F.lit("low").alias("severity"), F.col("id").alias("identifier"), "before", "after"))


def impact(links: DataFrame, roots: DataFrame) -> DataFrame:
    """GRA-08: id, confidence, method, hops, next of the nodes that reach a root: what changes with it. A chain is as sure as its weakest edge, and each node
    takes its surest chain: `method` is that of its weakest edge, `next` the node behind the first edge of it. links(src, dst, confidence, method);
    roots(id).

    Confidences are taken from the highest down (there is one a method): at each, edges at least as sure extend what was reached so far. So a
    node is found once, at its final confidence."""
    best = links.where("src <> dst").groupBy("src", "dst").agg(F.max(F.struct("confidence", "method")).alias("l")).select("src", "dst", "l.*")
    best = fixpoint.cut(best)
    ranks = sorted(((r["confidence"], r["method"]) for r in best.groupBy("confidence").agg(F.min("method").alias("method")).collect()), reverse=True)
    schema = "id string, confidence double, method string, hops int, next string"
    seen = roots.select(F.col("id").alias("id"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("method"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("next")).distinct()
    seen = fixpoint.cut(seen.to(best.sparkSession.createDataFrame([], schema).schema))
    for confidence, method in ranks:
        usable, frontier = best.where(F.col("confidence") >= confidence), seen
        while True:
            offers = usable.join(frontier.select(F.col("id").alias("dst"), "hops"), "dst").groupBy(F.col("src").alias("id")).agg(F.min(F.struct((F.col("hops") + 1).alias("hops"), F.col("dst").alias("next"))).alias("o"))
            frontier = fixpoint.cut(offers.join(seen.select("id"), "id", "left_anti").select("id", F.lit(confidence).alias("confidence"), F.lit(method).alias("method"), "o.hops", "o.next"))
            if not frontier.take(1):
                break
            seen = seen.unionByName(frontier)
        seen = fixpoint.cut(seen)
    return seen.where("next is not null")


#: Methods whose chains count as proven.
SURE = ("RUNTIME_OBSERVED", "STATIC_PROVEN", "CONFIG_PROVEN")


def graded(found: DataFrame) -> DataFrame:
    """impact() with `grade`: proven or possible."""
    return found.withColumn("grade", F.when(F.col("method").isin(*SURE), "proven").otherwise("possible"))


def blind_spots(links: DataFrame, found: DataFrame, roots: DataFrame) -> DataFrame:
    """GRA-08: links that no one proved and that touch the roots or what impact() found: they may hide more. links(src, dst, rel, method)."""
    radius = found.select("id").unionByName(roots.select("id")).distinct()
    weak = links.where(~F.col("method").isin(*SURE)).select("src", "dst", "rel", "method").distinct()
    touched = weak.join(radius.toDF("src"), "src", "left_semi").unionByName(weak.join(radius.toDF("dst"), "dst", "left_semi"))
    return touched.distinct()


def impact_summary(found: DataFrame, spots: DataFrame) -> DataFrame:
    """GRA-08: one row: proven, possible, blind_spots, overall_confidence and overall_method: the floor of all that was found."""
    f = graded(found).agg(F.count_if(F.col("grade") == "proven").alias("proven"), F.count_if(F.col("grade") == "possible").alias("possible"), F.min("confidence").alias("overall_confidence"), F.min_by("method", "confidence").alias("overall_method"))
    return f.withColumn("blind_spots", spots.agg(F.count("*")).scalar())


def readiness(entries: DataFrame, screens: DataFrame, ui_only: Column) -> DataFrame:
    """AGG-07: one row of percents: endpoints (of entries that aren't of the user interface alone, those with an endpoint), routes (screens with a route), security
    (protected endpoints), entities and controllers (endpoints that have any), and their weighted score, all rounded half up.

    entries(endpoint or null, roles, entities, controller); screens(route). Without any to count, a percent is 0."""
    e = entries.agg(
        F.count_if(~ui_only).alias("own"), F.count_if(~ui_only & F.col("endpoint").isNotNull()).alias("own_resolved"), F.count("endpoint").alias("n"),
        F.count_if(F.col("endpoint").isNotNull() & (F.size("roles") > 0)).alias("safe"), F.count_if(F.col("endpoint").isNotNull() & (F.size("entities") > 0)).alias("touching"),
        F.count_if(F.col("endpoint").isNotNull() & (F.coalesce("controller", F.lit("")) != "")).alias("controlled"),
    )
    s = screens.agg(F.count("*").alias("screens"), F.count_if(F.coalesce("route", F.lit("")) != "").alias("routed"))
    e = e.withColumns({c: s.select(c).scalar() for c in ("screens", "routed")})
    parts = {"endpoints": ("own_resolved", "own"), "routes": ("routed", "screens"), "security": ("safe", "n"), "entities": ("touching", "n"), "controllers": ("controlled", "n")}
    p = e.select(*[percent(F.col(a), F.col(b)).alias(k) for k, (a, b) in parts.items()])
    return p.withColumn("score", half_up(sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0)) / 100))


def hot_symbols(chains: DataFrame, changed: DataFrame, top: int = 5) -> DataFrame:
    """AGG-22: symbol, fan_in: changed classes and methods by the number of endpoints whose call chain holds them, whatever the case; most first, then
    methods before classes, then by name. chains(endpoint, step: Class.method); changed(path, symbol or null): Java and Kotlin files and what changed in them."""
    base = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), "[.][^.]*$", "")
    c = changed.where("lower(path) rlike '[.](java|kt)$'").select(base.alias("cls"), "symbol")
    asked = c.select(F.col("cls").alias("name"), F.lower("cls").alias("k")).unionByName(c.where("symbol is not null").select(F.concat("cls", F.lit("."), "symbol").alias("name"), F.lower(F.concat("cls", F.lit("."), "symbol")).alias("k"))).distinct()
    steps = chains.select("endpoint", F.lower("step").alias("step")).where(F.contains("step", F.lit("."))).distinct()
    keys = steps.select("endpoint", F.explode(F.array("step", F.substring_index("step", ".", 1))).alias("k")).distinct()
    n = asked.join(keys, "k").groupBy(F.col("name").alias("symbol")).agg(F.count_distinct("endpoint").alias("fan_in"))
    return n.orderBy(F.desc("fan_in"), F.desc(F.contains("symbol", F.lit("."))), "symbol").limit(top)
