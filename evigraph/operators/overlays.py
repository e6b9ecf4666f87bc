"""Overlays: what runtime, compilers and configurations prove, laid over a graph; and what is reported about them.

nodes(id, seq, type, ...), edges(src, dst, rel, seq, resolution, ...). An overlay gives the edges it adds or upgrades and the nodes it
mints; first-wins is by seq throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.operators import evidence, matching

#: Resolutions that count as proven by a compiler, and the relation that configurations prove.
COMPILER = ("compiler", "interface-impl")
DI = "DI_RESOLVES"


def entity_tables(nodes: DataFrame) -> DataFrame:
    """(table, id) of the entities with a table name; the last one by seq has a name."""
    return nodes.where("type = 'ENTITY' and table_name is not null").groupBy(F.col("table_name").alias("table")).agg(F.max_by("id", "seq").alias("id"))


def resolve_routes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """STR-04's first step: pairs(pair, method, path) -> pair, route, minted: the first route node whose pattern and method fit, else one
    named by method and path."""
    routes = nodes.where("type = 'ROUTE'").select("seq", F.col("id").alias("route"), F.concat(F.lit("/"), F.coalesce(F.nullif("http_method", F.lit("")), F.lit(":m")), "full_path").alias("path"))
    urls = pairs.select(F.col("pair").alias("url_id"), F.concat(F.lit("/"), "method", "path").alias("url"))
    hit = matching.match_routes(urls, routes.select("seq", "path")).join(routes.select("seq", "route"), "seq").select(F.col("url_id").alias("pair"), "route")
    made = F.concat(F.lit("route:runtime:"), "method", F.lit(":"), "path")
    return pairs.join(hit, "pair", "left").select("pair", F.coalesce("route", made).alias("route"), F.col("route").isNull().alias("minted"))


def route_overlay(pairs: DataFrame, tables: DataFrame, java: DataFrame, nodes: DataFrame) -> DataFrame:
    """STR-04: pairs(pair, method, path, count), tables(pair, table, op), java(pair, endpoint) -> src, dst, kind, operation, count: one
    observed edge for each (src, dst), the first by pair and step. kind: entity, java, or service-entity (only where a pair has
    exactly one Java target that is known)."""
    routes = resolve_routes(pairs, nodes).select("pair", "route")
    to_table = tables.join(entity_tables(nodes), "table", "left").select("pair", F.coalesce("id", F.concat(F.lit("table:"), "table")).alias("dst"), F.col("op").alias("operation"))
    conventions = nodes.where("startswith(id, 'wsv1:')").select(F.col("full_path").alias("endpoint"), F.col("id").alias("a"))
    deep = nodes.where("type = 'SERVICE'").select("seq", "id", F.regexp_extract("id", r"\.([a-z][A-Za-z0-9]*\.v\d+)\.", 1).alias("op")).where("op <> ''").groupBy("op").agg(F.min_by("id", "seq").alias("b"))
    j = java.withColumn("op", F.regexp_extract("endpoint", r"/([a-z][A-Za-z0-9]*\.v\d+)(?:/|$)", 1)).join(conventions, "endpoint", "left").join(deep, "op", "left")
    targets = j.select("pair", F.coalesce("a", "b").alias("dst"), "endpoint").where("dst is not null")
    only = targets.groupBy("pair").agg(F.count("*").alias("n"), F.first("dst").alias("src")).where("n = 1").select("pair", "src")
    none = F.lit(None).cast("string")
    steps = (
        routes.join(to_table, "pair").select("pair", F.lit(1).alias("step"), F.col("route").alias("src"), "dst", F.lit("entity").alias("kind"), "operation")
        .unionByName(routes.join(targets, "pair").select("pair", F.lit(2).alias("step"), F.col("route").alias("src"), "dst", F.lit("java").alias("kind"), none.alias("operation")))
        .unionByName(only.join(to_table, "pair").select("pair", F.lit(3).alias("step"), "src", "dst", F.lit("service-entity").alias("kind"), "operation"))
    )
    first = steps.where("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("pair", "step", "kind", "operation")).alias("f"))
    return first.select("src", "dst", "f.kind", "f.operation", "f.pair").join(pairs.select("pair", "count"), "pair").drop("pair")


def hot_marks(pairs: DataFrame, tables: DataFrame, nodes: DataFrame) -> DataFrame:
    """STR-04: (id, hits) of the routes and tables that pairs touch: how often each ran."""
    routes = resolve_routes(pairs, nodes).select("pair", F.col("route").alias("id"))
    to_table = tables.join(entity_tables(nodes), "table", "left").select("pair", F.coalesce("id", F.concat(F.lit("table:"), "table")).alias("id"))
    return routes.unionByName(to_table).join(pairs.select("pair", "count"), "pair").groupBy("id").agg(F.sum("count").alias("hits"))


def table_overlay(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """STR-05: hits(table, service, op, count) -> src, dst, operation, count, minted: tables observed without a route hang on a node of
    their service."""
    j = hits.join(entity_tables(nodes), "table", "left")
    return j.select(F.concat(F.lit("runtime:db:"), F.coalesce("service", F.lit("runtime"))).alias("src"), F.coalesce("id", F.concat(F.lit("table:"), "table")).alias("dst"), F.col("op").alias("operation"), "count", F.col("id").isNull().alias("minted"))


def _beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row frames side by side, as scalar subqueries."""
    out = first
    for df in others:
        out = out.withColumn("_row", df.select(F.struct(*df.columns).alias("s")).scalar()).select(*out.columns, "_row.*")
    return out


def overlay_summary(pairs: DataFrame, route_edges: DataFrame, table_edges: DataFrame, carried: DataFrame) -> DataFrame:
    """STR-06: one row of what the overlays did."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return _beside(
        pairs.agg(F.count("*").alias("route_pairs"), F.sum("count").alias("traces")),
        route_edges.agg(of("entity").alias("route_entity_edges"), of("java").alias("route_java_edges"), of("service-entity").alias("service_entity_edges")),
        table_edges.agg(F.count("*").alias("tables_observed"), F.count_if(~F.col("minted")).alias("entities_resolved"), F.count_if("minted").alias("tables_minted")),
        carried.agg(F.count_if("stale").alias("carried_forward")),
    )


def overlay_config(projects: DataFrame, env: dict[str, str | None]) -> DataFrame:
    """STR-07: projects(id, url, services, gateway, lookback_ms, max_traces) -> the settings in force; `enabled` is false without a URL or
    without services. A project's own value goes before the environment's; services never have a default."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    var = lambda k: F.lit(env.get(k) or None).cast("string")
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    own, common = listed(F.col("services")), listed(var("services"))
    p = projects.withColumns({"u": F.coalesce(given("url"), var("url")), "s": F.when(F.size(own) > 0, own).otherwise(common)})
    on = F.col("u").isNotNull() & (F.size("s") > 0)
    gateway = F.coalesce(given("gateway"), F.get("s", 0))
    return p.select(
        "id", on.alias("enabled"), F.when(on, F.col("u")).alias("url"), F.when(on, F.array_join(F.array_distinct(F.concat(F.array(gateway), "s")), ",")).alias("roots"),
        F.when(on, F.coalesce("lookback_ms", F.lit(env.get("lookback_ms")).cast("long"), F.lit(86_400_000))).alias("lookback_ms"), F.when(on, F.coalesce("max_traces", F.lit(env.get("limit")).cast("long"), F.lit(400))).alias("max_traces"),
    )


def evidence_history(runs: DataFrame, points: int = 90) -> DataFrame:
    """STR-09: runs(run_id, status, total, observed, proven, reason) -> the newest ended runs in time order, each a point or a hole: a run
    that failed, or kept no census, has its reason and no ratios; nothing is made up."""
    hole = F.when(F.col("status") == "failed", F.coalesce("reason", F.lit("run-failed"))).when(F.col("total").isNull(), "no-census").when(F.col("total") == 0, "no-edges")
    ended = runs.where("status in ('completed', 'failed')").orderBy(F.desc("run_id")).limit(points)
    ratio = lambda c: F.when(hole.isNull(), F.round(F.col(c) / F.col("total"), 4))
    return ended.select("run_id", hole.isNull().alias("valid"), hole.alias("reason"), F.when(hole.isNull(), F.col("total")).alias("total"), ratio("observed").alias("observed_ratio"), ratio("proven").alias("proven_ratio")).orderBy("run_id")


def proof_caveats(axes: DataFrame) -> DataFrame:
    """STR-11: axes(id, static_stale, static_status, static_hours, config_stale, config_hours, proven, config_proven, unresolved) -> id, caveat,
    days, edges: proofs that may not show the code as it is; the verdict itself stays."""
    days = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(1), F.floor(F.col(c) / 24 + 0.5))).cast("long")
    one = lambda name, d, n: F.struct(F.lit(name).alias("caveat"), d.alias("days"), n.cast("long").alias("edges"))
    static = F.when(F.col("static_stale") & (F.col("proven") > 0), one("static-stale", days("static_hours"), F.col("proven")))
    static = static.when((F.col("static_status") == "absent") & (F.col("proven") == 0) & (F.col("unresolved") > 0), one("static-absent", F.lit(None).cast("long"), F.col("unresolved")))
    config = F.when(F.col("config_stale") & (F.col("config_proven") > 0), one("config-stale", days("config_hours"), F.col("config_proven")))
    return axes.select("id", F.explode(F.filter(F.array(static, config), lambda x: x.isNotNull())).alias("c")).select("id", "c.*")


def order_for_route(pairs: DataFrame, touches: DataFrame, targets: DataFrame) -> DataFrame:
    """STR-12: targets(target), pairs(seq, path, trace_ids), touches(trace_id, table, rank) -> target, table, rank: the order in which the traces
    of one route touch tables. The route is the one of that path, else the first one where either path ends in the other; none: no rows."""
    norm = lambda c: F.lower(F.regexp_replace(c, "/+$", ""))
    p = pairs.select("seq", norm("path").alias("path"), "trace_ids").where("path <> ''")
    t = targets.select("target", norm("target").alias("t")).where("t <> ''")
    ends = matching.share_ending(t.select(F.col("t").alias("a")), p.select(F.col("path").alias("b"))).withColumnsRenamed({"a": "t", "b": "path"})
    best = t.join(ends, "t").join(p, "path").groupBy("target").agg(F.min_by("trace_ids", F.struct((F.col("path") != F.col("t")).alias("part"), "seq")).alias("ids"))
    traces = best.select("target", F.explode("ids").alias("trace_id")).distinct()
    return traces.join(touches, "trace_id").groupBy("target", "table").agg(F.min("rank").alias("rank"))


def merge_data_access(edges: DataFrame, nodes: DataFrame, access: DataFrame) -> DataFrame:
    """GRA-19: access(seq, from_file, table, access) -> src, dst, rel, origin: kept, upgraded (an edge that stood there is proven now), or added;
    sources that no node stands for give none; unknown tables are minted as table:<name>."""
    files = nodes.where("source_file <> ''").groupBy(F.col("source_file").alias("from_file")).agg(F.min_by("id", "seq").alias("src"))
    named = access.where("access in ('read', 'write')").join(files, "from_file").join(entity_tables(nodes), "table", "left")
    proofs = named.select("src", F.coalesce("id", F.concat(F.lit("table:"), "table")).alias("dst"), F.when(F.col("access") == "write", "WRITES_ENTITY").otherwise("READS_ENTITY").alias("rel")).where("src <> dst").distinct()
    have = edges.select("src", "dst", "rel").distinct().withColumn("have", F.lit(True))
    j = have.join(proofs.withColumn("proof", F.lit(True)), ["src", "dst", "rel"], "full_outer")
    return j.select("src", "dst", "rel", F.when(F.col("proof").isNull(), "kept").when(F.col("have"), "upgraded").otherwise("added").alias("origin"))


def config_edges(nodes: DataFrame, derived: DataFrame, roots: list[str]) -> DataFrame:
    """GRA-20's first step: derived(seq, from_fqn, to_fqn, resolution) -> src, dst, reason, minted_src, minted_dst: the first edge of each pair
    of nodes; a name without a node becomes an interface if its first segment is in scope, and drops the edge if not."""
    index = nodes.where("type <> 'INTERFACE' or fqn is not null").groupBy("fqn").agg(F.min_by("id", "seq").alias("id"))
    d = derived.where("resolution = 'config' and from_fqn <> '' and to_fqn <> ''")
    for side in ("from", "to"):
        known = index.select(F.col("fqn").alias(f"{side}_fqn"), F.col("id").alias(f"{side}_id"))
        scope = F.substring_index(f"{side}_fqn", ".", 1).isin(*roots) & F.contains(F.col(f"{side}_fqn"), F.lit("."))
        d = d.join(known, f"{side}_fqn", "left").withColumn(side, F.coalesce(f"{side}_id", F.when(scope, F.concat(F.lit("INTERFACE:"), f"{side}_fqn"))))
    d = d.where("`from` is not null and `to` is not null and `from` <> `to`")
    best = d.groupBy(F.col("from").alias("src"), F.col("to").alias("dst")).agg(F.min_by(F.struct("reason", F.col("from_id").isNull().alias("minted_src"), F.col("to_id").isNull().alias("minted_dst")), "seq").alias("b"))
    return best.select("src", "dst", "b.*")


def merge_config(edges: DataFrame, config: DataFrame) -> DataFrame:
    """GRA-20: (src, dst, origin): superseded where a compiler has proven the pair, upgraded where the relation stood there, added otherwise."""
    proven = edges.where(F.col("resolution").isin(*COMPILER)).select("src", "dst").distinct().withColumn("proven", F.lit(True))
    stands = edges.where(F.col("rel") == DI).select("src", "dst").distinct().withColumn("stands", F.lit(True))
    j = config.select("src", "dst").join(proven, ["src", "dst"], "left").join(stands, ["src", "dst"], "left")
    return j.select("src", "dst", F.when(F.col("proven"), "superseded").when(F.col("stands"), "upgraded").otherwise("added").alias("origin"))


def with_overlays(edges: DataFrame, nodes: DataFrame, calls: DataFrame | None = None, access: DataFrame | None = None, derived: DataFrame | None = None, roots: list[str] | None = None) -> DataFrame:
    """GRA-21: (src, dst, rel, resolution) after all overlays, in their order: compiler calls, data access, configuration. One that is not there
    is left out, and the others still count."""
    out = edges.groupBy("src", "dst", "rel").agg(F.min_by("resolution", "seq").alias("resolution"))
    if calls is not None:
        out = evidence.merge_overlay(out.withColumn("seq", F.lit(0)), calls, nodes)[0].select("src", "dst", "rel", "resolution")
    if access is not None:
        proofs = merge_data_access(out, nodes, access)
        out = proofs.join(out, ["src", "dst", "rel"], "left").select("src", "dst", "rel", F.when(F.col("origin") == "kept", F.col("resolution")).otherwise("compiler").alias("resolution"))
    if derived is not None:
        merged = merge_config(out, config_edges(nodes, derived, roots or [])).where("origin <> 'superseded'").select("src", "dst", F.lit(DI).alias("rel"), F.lit("config").alias("proof"))
        out = out.join(merged, ["src", "dst", "rel"], "full_outer").select("src", "dst", "rel", F.coalesce("proof", "resolution").alias("resolution"))
    return out


def capability_lookup(asks: DataFrame, functions: DataFrame, calls: DataFrame, bindings: DataFrame, depth: int = 5) -> DataFrame:
    """GRA-28: asks(ask, file, handler), functions(file, name, seq, capability: null if none), calls(src_file, src_name, dst_file, dst_name),
    bindings(file, handler, source, original) -> ask, tier, capability; the first tier that has one: 1 the function itself, 2 what its
    name is bound to, 3 the nearest callee within `depth` calls, 4 the bound file's function of that name or default, 5 a
    method of that name in the file."""
    f = functions.select("file", "name", "seq", "capability")
    has = f.where("capability is not null")
    direct = asks.join(has, (asks.file == has.file) & (asks.handler == has.name)).select("ask", F.lit(1).alias("tier"), "seq", "capability")
    b = asks.join(bindings, ["file", "handler"])
    at = lambda name, tier: b.select("ask", F.col("source").alias("file"), name.alias("name")).join(has, ["file", "name"]).select("ask", F.lit(tier).alias("tier"), "seq", "capability")
    bound, other = at(F.col("original"), 2), at(F.col("handler"), 4).unionByName(at(F.lit("default"), 4))
    step = calls.select(F.concat_ws("\u0000", "src_file", "src_name").alias("src"), F.concat_ws("\u0000", "dst_file", "dst_name").alias("dst")).distinct()
    key = F.concat_ws("\u0000", "file", "name")
    hits = has.select(key.alias("dst"), "seq", "capability")
    frontier = asks.join(f.where("capability is null").select("file", F.col("name").alias("handler")), ["file", "handler"]).select("ask", F.concat_ws("\u0000", "file", "handler").alias("src"))
    walked = None
    for d in range(1, depth + 1):
        reached = frontier.join(step, "src").select("ask", "dst").distinct()
        found = reached.join(hits, "dst").select("ask", F.lit(3).alias("tier"), F.lit(d).alias("far"), "seq", "capability")
        walked = found if walked is None else walked.unionByName(found)
        frontier = reached.withColumnRenamed("dst", "src")
    named = has.withColumn("handler", F.substring_index("name", ".", -1)).where("name <> handler")
    method = asks.join(named, ["file", "handler"]).select("ask", F.lit(5).alias("tier"), "seq", "capability")
    all_ = direct.unionByName(bound).unionByName(other).unionByName(method).withColumn("far", F.lit(0)).unionByName(walked)
    return all_.groupBy("ask").agg(F.min(F.struct("tier", "far", "seq", "capability")).alias("m")).select("ask", "m.tier", "m.capability")


def check_claims(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """AGG-17: claims(id, metric, value) against facts(metric, canonical): whether they agree, and by how much not; a metric that the sheet lacks never does."""
    j = claims.join(facts, "metric", "left")
    return j.select("id", "metric", F.col("value").alias("claimed"), "canonical", F.coalesce(F.col("canonical") == F.col("value"), F.lit(False)).alias("matches"), (F.col("value") - F.col("canonical")).alias("delta"))


def calibration(edges: DataFrame, least: int = 30) -> DataFrame:
    """AGG-25: edges(src, dst, method) -> method, confirmable, confirmed, reliability, status. An edge can be confirmed if runtime has seen its
    source and nodes of its target's kind; of others runtime says nothing. status: calibrated, no-ground-truth, incomparable,
    few-samples (under `least`), or out-of-reach: no number is given but for the first."""
    kind = lambda x: F.substring_index(x, ":", 1)
    seen = edges.where("method = 'RUNTIME_OBSERVED'").select("src", "dst").distinct()
    sources, kinds = seen.select("src").distinct().withColumn("s", F.lit(True)), seen.select(kind("dst").alias("kind")).distinct().withColumn("t", F.lit(True))
    static = edges.where("method <> 'RUNTIME_OBSERVED'").select("src", "dst", "method", kind("dst").alias("kind")).join(sources, "src", "left").join(kinds, "kind", "left").join(seen.withColumn("c", F.lit(True)), ["src", "dst"], "left")
    can = F.coalesce(F.col("s") & F.col("t"), F.lit(False))
    g = static.groupBy("method").agg(F.count_if(can).alias("confirmable"), F.count_if(can & F.col("c")).alias("confirmed"))
    g = g.withColumns({"oracle": seen.agg(F.count("*")).scalar(), "comparable": static.agg(F.count_if("s")).scalar()})
    status = F.when(F.col("oracle") == 0, "no-ground-truth").when(F.col("comparable") == 0, "incomparable").when(F.col("confirmable") == 0, "out-of-reach").when(F.col("confirmable") < least, "few-samples").otherwise("calibrated")
    return g.select("method", "confirmable", "confirmed", F.when(status == "calibrated", F.round(F.col("confirmed") / F.col("confirmable"), 4)).alias("reliability"), status.alias("status"))


def effective_confidence(calibrated: DataFrame, fixed: dict[str, float]) -> DataFrame:
    """AGG-26: method, confidence, source: the measured reliability where there is one, else the fixed weight."""
    weight = F
    for name, value in fixed.items():
        weight = weight.when(F.col("method") == name, value)
    return calibrated.select("method", F.coalesce("reliability", weight.otherwise(0.0)).alias("confidence"), F.when(F.col("reliability").isNotNull(), "calibrated").otherwise("fixed").alias("source"))


def functional_boxes(endpoints: DataFrame, concepts: dict[str, tuple[str, int]]) -> DataFrame:
    """AGG-28: endpoints(endpoint, names: text) -> concept, importance, endpoints, anchor (the least endpoint); what no concept's pattern finds is
    counted as `unmapped`. concepts: name -> (pattern, importance). One pass, however many concepts."""
    tries = F.array(*(F.when(F.col("names").rlike(p), F.lit(k)) for k, (p, _) in concepts.items()))
    hit = F.filter(tries, lambda x: x.isNotNull())
    e = endpoints.select("endpoint", F.explode(F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit("unmapped")))).alias("concept"))
    rank = F
    for k, (_, n) in concepts.items():
        rank = rank.when(F.col("concept") == k, n)
    return e.groupBy("concept").agg(F.count_distinct("endpoint").alias("endpoints"), F.min("endpoint").alias("anchor")).select("concept", rank.otherwise(0).cast("long").alias("importance"), "endpoints", "anchor")


def class_diagram(edges: DataFrame, nodes: DataFrame, most: int = 28) -> DataFrame:
    """AGG-31: the classes of the highest degree and the edges among them: src, dst, edges."""
    top = evidence.degrees(edges, nodes).withColumn("degree", F.col("in_degree") + F.col("out_degree")).orderBy(F.desc("degree"), "id").limit(most).select("id")
    near = edges.join(top.toDF("src"), "src", "left_semi").join(top.toDF("dst"), "dst", "left_semi").where("src <> dst")
    return near.groupBy("src", "dst").agg(F.count("*").alias("edges"))


def use_case_domains(routes: DataFrame, most: int = 8) -> DataFrame:
    """AGG-31: routes(domain, endpoint) -> the domains with most endpoints."""
    return routes.groupBy("domain").agg(F.count_distinct("endpoint").alias("endpoints")).orderBy(F.desc("endpoints"), "domain").limit(most)


def seams(edges: DataFrame, domains: DataFrame) -> DataFrame:
    """UI-05: directed pairs of different domains(id, domain) with their edges, by method."""
    d = domains.where("domain is not null")
    e = evidence.edge_evidence(edges).join(d.toDF("src", "from_domain"), "src").join(d.toDF("dst", "to_domain"), "dst").where("from_domain <> to_domain")
    return e.groupBy("from_domain", "to_domain", "method").agg(F.count("*").alias("edges"))


def insights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """UI-03: one row: nodes, edges, blind edges and their share, hot nodes, types."""
    e = evidence.edge_evidence(evidence.existing_edges(edges, nodes)).agg(F.count("*").alias("edges"), F.count_if(F.col("method").isin("UNKNOWN", "STATIC_UNRESOLVED")).alias("blind"), F.count_if(F.col("method") == "RUNTIME_OBSERVED").alias("observed"))
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if("runtime_hot").alias("hot"), F.count_distinct("type").alias("types"))
    return _beside(n, e).withColumn("blind_share", F.when(F.col("edges") > 0, F.round(F.col("blind") / F.col("edges"), 4)).otherwise(0.0))


def hottest_edges(edges: DataFrame, nodes: DataFrame, top: int = 10) -> DataFrame:
    """UI-03: the observed edges with the greatest count."""
    e = evidence.existing_edges(edges, nodes).where("observed")
    return e.groupBy("src", "dst", "rel").agg(F.sum("weight").alias("count")).orderBy(F.desc("count"), "src", "dst", "rel").limit(top)


def alarms(axes: DataFrame, coupling: DataFrame, deltas: DataFrame) -> DataFrame:
    """UI-07: kind, subject, level: axes(axis, state) that are stale or absent, coupling(src, pct) of 25 % more or over, and deltas(grp, run_id, points) of
    the observed ratio that fell by three points or more."""
    a = axes.where("state in ('stale', 'absent')").select(F.lit("health").alias("kind"), F.col("axis").alias("subject"), F.when(F.col("state") == "absent", "high").otherwise("medium").alias("level"))
    b = coupling.where("pct >= 25").select(F.lit("coupling").alias("kind"), F.col("src").alias("subject"), F.when(F.col("pct") >= 100, "high").otherwise("medium").alias("level"))
    c = deltas.where("points <= -3").select(F.lit("ratio").alias("kind"), F.concat("grp", F.lit("/"), "run_id").alias("subject"), F.lit("high").alias("level"))
    return a.unionByName(b).unionByName(c)


def sankey(units: DataFrame, caps: dict[str, int]) -> DataFrame:
    """UI-09: units(guard, permission, entity, n) with each column cut to its largest values, the rest as `others`."""
    out = units
    for column, most in caps.items():
        ranks = out.groupBy(column).agg(F.sum("n").alias("t")).orderBy(F.desc("t"), column).limit(most).select(column, F.lit(True).alias("top"))
        out = out.join(ranks, column, "left").withColumn(column, F.when(F.col("top"), F.col(column)).otherwise("others")).drop("top")
    return out.groupBy(*caps).agg(F.sum("n").alias("n"))


def recency(last_ms: Column, now_ms: Column, fresh_hours: int = 24) -> Column:
    """UI-11: fresh, stale or never."""
    return F.when(last_ms.isNull(), "never").when(now_ms - last_ms <= fresh_hours * 3_600_000, "fresh").otherwise("stale")
