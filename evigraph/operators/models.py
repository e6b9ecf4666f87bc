"""Folds, rollups and rankings that models and reports are made of."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.operators import catalog as cat
from evigraph.operators import evidence


def _set(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def manifest(entries: DataFrame) -> DataFrame:
    """AGG-05: per controller its endpoints, roles and entities (sorted sets)."""
    flat = entries.select("controller", "endpoint", F.explode_outer("roles").alias("role"), F.col("entities"))
    flat = flat.select("controller", "endpoint", "role", F.explode_outer("entities").alias("entity"))
    return flat.groupBy("controller").agg(F.count_distinct("endpoint").alias("endpoints"), _set("role").alias("roles"), _set("entity").alias("entities"))


def completeness(entries: DataFrame) -> DataFrame:
    """AGG-06, AGG-07: how many rows have each field, and the weighted score (roles 40, entities 40, sensitive fields 20)."""
    e = entries.agg(F.count("*").alias("n"), *(F.count_if(F.size(c) > 0).alias(c) for c in ("roles", "entities", "sensitive_fields")))
    return e.withColumn("score", F.floor((F.col("roles") * 40 + F.col("entities") * 40 + F.col("sensitive_fields") * 20) / F.col("n") + 0.5).cast("long"))


def assessment(entries: DataFrame) -> DataFrame:
    """AGG-15: one row: surface, open entries, overlapping groups and lifecycle gaps."""
    surface = entries.agg(F.count("*").alias("entries"), F.count_if(~cat.is_protected()).alias("open"))
    return surface.withColumns({"overlaps": cat.overlap(entries).agg(F.count("*")).scalar(), "gaps": cat.lifecycle(entries).where("gap is not null").agg(F.count("*")).scalar()})


def churn_entropy(changes: DataFrame) -> DataFrame:
    """AGG-20: (grp, file) rows -> changes, files and normalized entropy per group; 0 with fewer than two files."""
    per = changes.groupBy("grp", "file").agg(F.count("*").alias("n"))
    sums = per.groupBy("grp").agg(F.sum("n").alias("changes"), F.count("*").alias("files"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    h = (F.log2("changes") - F.col("s") / F.col("changes")) / F.log2("files")
    return sums.select("grp", "changes", "files", F.when(F.col("files") < 2, 0.0).otherwise(F.round(h, 4)).alias("entropy"))


def confirmations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """JOIN-15, AGG-26: static edges by method, and how many of their pairs were observed."""
    e = evidence.edge_evidence(evidence.existing_edges(edges, nodes))
    seen = e.where("observed").select("src", "dst").distinct().withColumn("seen", F.lit(True))
    static = e.where("not observed").select("src", "dst", "method").distinct().join(seen, ["src", "dst"], "left")
    return static.groupBy("method").agg(F.count("*").alias("pairs"), F.count("seen").alias("confirmed")).withColumn("rate", F.round(F.col("confirmed") / F.col("pairs"), 4))


def concept_coverage(names: DataFrame, concepts: dict[str, str]) -> DataFrame:
    """AGG-27, JOIN-11: how many names each concept's pattern finds; a concept without any has 0. One pass over the names."""
    counts = names.agg(*(F.count_if(F.col("name").rlike(p)).alias(c) for c, p in concepts.items()))
    return counts.unpivot([], list(concepts), "concept", "names")


def group_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG-29, UI-05: edges between types with the best and the worst confidence."""
    key = lambda s: nodes.select(F.col("id").alias(s), F.col("type").alias(f"{s}_type"))
    e = evidence.edge_evidence(edges).join(key("src"), "src").join(key("dst"), "dst")
    return e.groupBy("src_type", "dst_type").agg(F.count("*").alias("edges"), F.max("confidence").alias("best"), F.min("confidence").alias("worst"))


def top_per_group(entries: DataFrame, top: int = 12) -> DataFrame:
    """AGG-30, TOP-07: the most critical entries of each controller."""
    w = Window.partitionBy("controller").orderBy(F.desc("criticality"), "entry_id")
    return entries.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).select("controller", "entry_id", "criticality", "rank")


def containers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG-30: relations between containers: edges and the best confidence of each directed pair."""
    of = lambda s: nodes.select(F.col("id").alias(s), F.coalesce(text.container_of(F.col("type"), F.lit(""), F.lit("")), F.lit("backend")).alias(f"{s}_container"))
    e = evidence.edge_evidence(edges).join(of("src"), "src").join(of("dst"), "dst").where("src_container <> dst_container")
    return e.groupBy(F.col("src_container").alias("src"), F.col("dst_container").alias("dst")).agg(F.count("*").alias("edges"), F.max("confidence").alias("best"))


def policy_matrix(entries: DataFrame) -> DataFrame:
    """AGG-32: what each role may do to each entity; open entries count for PUBLIC."""
    roles = F.when(cat.is_protected(), F.col("roles")).otherwise(F.array(F.lit("PUBLIC")))
    return entries.select(F.explode(roles).alias("role"), "http_method", "entities").select("role", "http_method", F.explode("entities").alias("entity")).groupBy("role", "entity").agg(_set("http_method").alias("methods"), F.count("*").alias("endpoints"))


def impact_of(entries: DataFrame, symbol: str) -> DataFrame:
    """IMP-01, PRJ-15: entries that touch a symbol: exactly if any does, else by part of the name (3 characters at least)."""
    s = symbol.lower()
    names = F.transform("entities", F.lower)
    e = entries.withColumn("exact", F.array_contains(names, s))
    any_ = F.coalesce(e.agg(F.bool_or("exact")).scalar(), F.lit(False))
    part = F.exists(names, lambda x: x.contains(s)) if len(s) >= 3 else F.lit(False)
    return e.where(F.when(any_, F.col("exact")).otherwise(part)).select("entry_id", "endpoint", "http_method")


def malformed(entries: DataFrame) -> DataFrame:
    """PRJ-11: endpoints with doubled slashes, blanks or without a leading slash, and all others."""
    return entries.select("entry_id", (F.col("endpoint").rlike("//|\\s") | ~F.col("endpoint").startswith("/")).alias("malformed"))


def authorization_flow(entries: DataFrame, most: int = 3) -> DataFrame:
    """UI-08, UI-09: guard x permission, the smaller permissions of a guard together as `others`."""
    guard = F.when(~cat.is_protected(), "open").when(F.array_contains("roles", "ADMIN"), "admin").otherwise("role")
    units = entries.select(guard.alias("guard"), F.coalesce(F.get("entities", 0), F.lit("-")).alias("entity")).groupBy("guard", "entity").agg(F.count("*").alias("n"))
    w = Window.partitionBy("guard").orderBy(F.desc("n"), "entity")
    ranked = units.withColumn("entity", F.when(F.row_number().over(w) <= most, F.col("entity")).otherwise("others"))
    return ranked.groupBy("guard", "entity").agg(F.sum("n").alias("n"))


def union_unseen(*sources: DataFrame) -> DataFrame:
    """SET-01: rows of all sources, the first source that has an (endpoint, method) wins, then the least entry id."""
    all_ = None
    for k, df in enumerate(sources):
        one = df.select("endpoint", "http_method", "entry_id", F.lit(k).alias("source"))
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.groupBy("endpoint", "http_method").agg(F.min(F.struct("source", "entry_id")).alias("m")).select("endpoint", "http_method", "m.source", "m.entry_id")


def role_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """SET-02..04: per controller the roles added, removed and whether the sets are equal; sorted, joined."""
    fold = lambda df, n: df.select("controller", F.explode("roles").alias("r")).groupBy("controller").agg(F.array_sort(F.collect_set("r")).alias(n))
    empty = F.array().cast("array<string>")
    j = fold(before, "a").join(fold(after, "b"), "controller", "full_outer").select("controller", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
    return j.select("controller", F.array_join(F.array_except("b", "a"), ",").alias("added"), F.array_join(F.array_except("a", "b"), ",").alias("removed"), (F.col("a") == F.col("b")).alias("equal"))


def health(spans: DataFrame, fresh_hours: int = 24, stale_hours: int = 168) -> DataFrame:
    """STR-08, UI-11: per service the age against the newest span, in whole hours, and its class."""
    newest = spans.agg(F.max("start_ts")).scalar()
    s = spans.groupBy("service", "op").agg(F.max("start_ts").alias("last")).withColumn("age_hours", F.floor((F.unix_timestamp(newest) - F.unix_timestamp("last")) / 3600).cast("long"))
    return s.select("service", "op", "age_hours", F.when(F.col("age_hours") <= fresh_hours, "fresh").when(F.col("age_hours") <= stale_hours, "stale").otherwise("absent").alias("state"))


def sessions(spans: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of a user: spans less than a gap apart."""
    s = spans.groupBy("user_id", F.session_window("start_ts", gap).alias("w")).agg(F.count("*").alias("spans"))
    return s.select("user_id", F.col("w.start").alias("began"), "spans")


def suffixes(names: DataFrame, least: int = 5) -> DataFrame:
    """EXT-24: the last one to three camel segments of names that at least `least` distinct names end in."""
    seg = names.select("name", F.regexp_extract_all("name", F.lit("[A-Z][a-z0-9]*"), 0).alias("s")).where(F.size("s") > 1)
    tails = F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size("s") - 1)), lambda k: F.array_join(F.slice("s", -k, k), ""))
    return seg.distinct().select(F.explode(tails).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("names")).where(F.col("names") >= least)


def permissions(files: DataFrame) -> DataFrame:
    """EXT-05: permissions that annotations of a source file name, sorted and joined; bare authentication as AUTHENTICATED."""
    named = F.regexp_extract_all("content", F.lit('@HasPermission\\("([A-Z_]+)"\\)'), 1)
    auth = F.when(F.col("content").contains("@IsAuthenticated"), F.array(F.lit("AUTHENTICATED"))).otherwise(F.array().cast("array<string>"))
    return files.select("path", F.array_join(F.array_sort(F.array_distinct(F.array_union(named, auth))), ",").alias("permissions"))


def beta_quantile(p: float, a: float, b: float) -> float:
    """FN-25: by bisection on the regularized incomplete beta function (continued fraction)."""
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _beta_inc(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + t * d)
            c = 1 + t / c
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f / a


def clopper_pearson(hits: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    low = 0.0 if hits == 0 else beta_quantile(alpha / 2, hits, n - hits + 1)
    high = 1.0 if hits == n else beta_quantile(1 - alpha / 2, hits + 1, n - hits)
    return low, high


def reliability(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG-23: confirmations with the exact 95 % interval; the quantiles are computed on one row per method."""
    c = confirmations(edges, nodes)

    def bounds(batches):
        for pdf in batches:
            got = [clopper_pearson(int(k), int(n)) for k, n in zip(pdf.confirmed, pdf.pairs, strict=True)]
            yield pdf.assign(low=[round(g[0], 6) for g in got], high=[round(g[1], 6) for g in got])

    return c.mapInPandas(bounds, "method string, pairs long, confirmed long, rate double, low double, high double")


def normal_quantile(p: float) -> float:
    """FN-26"""
    return NormalDist().inv_cdf(p)
