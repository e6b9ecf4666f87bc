"""Reports about a graph and what feeds it: health of the sources, completeness of edges, packages, the surroundings of a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators import evidence

#: Hours after which a source is stale; directories of tests, and those that name no part; relations that tie packages.
HOURS = {"static": 168, "config": 168, "runtime": 24, "analysis": 48}
TESTS = r"(?i)^(tests?|__tests__|spec|specs|mocks?|__mocks__|fixtures?)$"
PREFIXES = ("src", "main", "java", "com", "org", "app")
TIES = ("CALLS", "IMPORTS", "ASSOCIATES", "READS_ENTITY", "WRITES_ENTITY", "RUNTIME_OBSERVED")
#: Reasons of the runtime axis that count against a project although nothing is stale.
EMPTY = ("no-traces", "no-anchorable-traces")


def health(pushes: DataFrame, runs: DataFrame, traces: DataFrame, now: Column, hours: dict[str, int] = HOURS) -> DataFrame:
    """STR-08: axis, status, reason, age_hours: a row for each of static, config, runtime and analysis.

    pushes(axis, seq, pushed_at string): the last payload counts; without a row it is absent, without a time that can be read unknown.
    runs(id, status, started, completed): the run that started last; one that failed is stale, however young it is.
    traces(trace_id, last_seen, anchored): absent without a trace, or without one that a route is known of. An age is that at `now`."""
    told = pushes.groupBy("axis").agg(F.max(F.struct("seq", "pushed_at")).alias("m")).select("axis", F.lit(1).alias("there"), F.col("m.pushed_at").alias("text"), F.try_to_timestamp("m.pushed_at").alias("at"))
    axes = pushes.sparkSession.createDataFrame([("static",), ("config",)], "axis string").join(told, "axis", "left")
    missing = F.when(F.col("there").isNull(), "never-pushed").when(F.col("text").isNull(), "no-timestamp").when(F.col("at").isNull(), "invalid-timestamp")
    pushed = axes.select("axis", missing.alias("reason"), "at")
    run = runs.agg(F.max(F.struct("started", "id", "status", "completed")).alias("m"))
    failed = F.lower("m.status").isin("failed", "error")
    at = F.coalesce("m.completed", "m.started")
    analysed = run.select(F.lit("analysis").alias("axis"), F.when(F.col("m").isNull(), "never-analyzed").when(at.isNull(), "invalid-timestamp").when(failed, "last-run-failed").alias("reason"), at.alias("at"))
    seen = traces.agg(F.count("*").alias("n"), F.count_if("anchored").alias("anchored"), F.max("last_seen").alias("at"))
    ran = seen.select(F.lit("runtime").alias("axis"), F.when(F.col("n") == 0, "no-traces").when(F.col("anchored") == 0, "no-anchorable-traces").alias("reason"), "at")
    every = pushed.unionByName(analysed).unionByName(ran)
    age = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / -3.6e9
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in hours.items() for x in pair]), F.col("axis"))
    absent = F.col("reason").isin("never-pushed", "never-analyzed", *EMPTY)
    status = F.when(absent, "absent").when(F.col("reason") == "last-run-failed", "stale").when(F.col("reason").isNotNull(), "unknown").when(F.col("age_hours") > limit, "stale").otherwise("fresh")
    return every.withColumn("age_hours", F.when(F.col("at").isNotNull(), F.greatest(age, F.lit(0.0)))).select("axis", status.alias("status"), "reason", "age_hours")


def overall(axes: DataFrame) -> DataFrame:
    """STR-08: one row: starving if no axis is fresh, degraded if one is to blame (stale, or runtime without anything to use), else healthy."""
    blame = (F.col("status") == "stale") | ((F.col("axis") == "runtime") & F.coalesce(F.col("reason").isin(*EMPTY), F.lit(False)))
    told = axes.agg(F.count_if(F.col("status") == "fresh").alias("fresh"), F.array_join(F.array_sort(F.collect_list(F.when(blame, F.col("axis")))), ",").alias("culprits"))
    return told.select(F.when(F.col("fresh") == 0, "starving").when(F.col("culprits") != "", "degraded").otherwise("healthy").alias("overall"), "culprits")


def completeness(incidence: DataFrame) -> DataFrame:
    """AGG-24: one row of (item, occasion): seen, f1, f2, chao1, chao2 and the share that was missed by chao2; nothing seen gives zeros."""
    t = incidence.agg(F.count_distinct("occasion").alias("t"))
    per = incidence.select("item", "occasion").distinct().groupBy("item").agg(F.count("*").alias("k"))
    c = per.agg(F.count("*").alias("seen"), F.count_if(F.col("k") == 1).alias("f1"), F.count_if(F.col("k") == 2).alias("f2")).withColumn("t", t.scalar())
    bias = F.col("f1") * (F.col("f1") - 1) / (2 * (F.col("f2") + 1))
    two = F.col("seen") + F.coalesce(F.try_divide(F.col("t") - 1, F.col("t")), F.lit(0.0)) * bias
    share = F.coalesce(F.try_divide(two - F.col("seen"), two), F.lit(0.0))
    return c.select("seen", "f1", "f2", F.round(F.col("seen") + bias, 4).alias("chao1"), F.round(two, 4).alias("chao2"), F.round(share, 4).alias("missed"))


def package_of(file: Column, depth: int = 3) -> Column:
    """AGG-29: the first `depth` directories of a file behind those that name no part; null for files of tests."""
    dirs = F.filter(F.split(file, "/"), lambda x: x != "")
    dirs = F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - 1, F.lit(0)))
    named = F.filter(F.sequence(F.lit(1), F.greatest(F.size(dirs), F.lit(1))), lambda i: (i == F.size(dirs)) | ~F.coalesce(F.get(dirs, i - 1).isin(*PREFIXES), F.lit(False)))
    start = F.coalesce(F.get(named, F.lit(0)), F.lit(1))
    return F.when(F.size(dirs) == 0, "(root)").when(~F.exists(dirs, lambda x: x.rlike(TESTS)), F.array_join(F.slice(dirs, start, depth), "/"))


def packages(edges: DataFrame, nodes: DataFrame, most: int = 20, ties: int = 90) -> tuple[DataFrame, DataFrame]:
    """AGG-29: (packages, ties) of nodes(id, package): the `most` packages of the most nodes, and the `ties` pairs of them of the most edges.

    A tie counts the edges that cross from one to the other, with the strongest of observed, proven and inferred. Equal sizes go by name."""
    of = nodes.select("id", "package").where("package <> ''")
    top = of.groupBy("package").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "package").limit(most)
    kept = of.join(top.select("package"), "package", "left_semi")
    side = lambda x: kept.select(F.col("id").alias(x), F.col("package").alias(f"{x}_package"))
    e = evidence.edge_evidence(edges.where(F.col("rel").isin(*TIES))).join(side("src"), "src").join(side("dst"), "dst").where("src_package <> dst_package")
    rank = F.when(F.col("method") == "RUNTIME_OBSERVED", 2).when(F.col("method").isin("STATIC_PROVEN", "CONFIG_PROVEN") | (F.col("resolution") == "compiler"), 1).otherwise(0)
    found = e.groupBy("src_package", "dst_package").agg(F.count("*").alias("edges"), F.max(rank).alias("r"))
    found = found.select("src_package", "dst_package", "edges", F.get(F.array(F.lit("inferred"), F.lit("proven"), F.lit("observed")), "r").alias("best"))
    return top, found.orderBy(F.desc("edges"), "src_package", "dst_package").limit(ties)


def ego(edges: DataFrame, nodes: DataFrame, center: DataFrame, most: int = 24) -> DataFrame:
    """UI-10: rank, id, degree, outbound, inbound, total: the neighbours of center(id), the `most` of the highest degree, ties by id, with the
    edges to and from the center, and how many neighbours there are in all. Edges of the center to itself don't count."""
    mid = center.select(F.col("id").alias("mid"))
    e = edges.select("src", "dst").where("src <> dst")
    out = e.join(mid, F.col("src") == F.col("mid")).select(F.col("dst").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    back = e.join(mid, F.col("dst") == F.col("mid")).select(F.col("src").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    near = out.unionByName(back).groupBy("id").agg(F.sum("o").alias("outbound"), F.sum("i").alias("inbound")).join(nodes.select("id"), "id", "left_semi")
    degree = evidence.degrees(edges, nodes).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    total = near.agg(F.count("*").alias("total")).scalar()
    best = near.join(degree, "id").orderBy(F.desc("degree"), "id").limit(most)
    return best.select(F.row_number().over(Window.orderBy(F.desc("degree"), "id")).cast("long").alias("rank"), "id", "degree", "outbound", "inbound", total.alias("total"))
