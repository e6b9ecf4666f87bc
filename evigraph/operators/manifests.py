"""Two manifests of an application side by side: what changed, what it means for security, and what got worse.

endpoints(seq, path, method, roles, criticality, entities, operation, sensitive_fields); of several under one method and path the last one counts.
Screens, roles and entities are a frame of names(name) and frames of what belongs to a name(name, item).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import catalog as cat
from evigraph.operators.snapshots import percent

#: What an endpoint is compared by, in this order.
FIELDS = ("roles", "criticality", "entities", "operation", "sensitive_fields")
#: Points of coverage whose loss counts, criticality of an open endpoint that counts as high, loss of coverage in percent that isn't nothing.
DROP, HIGH, SLIGHT = 3, 70, 5

Named = tuple[DataFrame, dict[str, DataFrame]]


def keyed(endpoints: DataFrame) -> DataFrame:
    """key, e: the last endpoint under each method and path; lists as sorted sets."""
    sets = {c: F.array_sort(F.array_distinct(c)) for c in ("roles", "entities", "sensitive_fields")}
    key = F.concat(F.upper("method"), F.lit(":"), "path")
    return endpoints.withColumns(sets).groupBy(key.alias("key")).agg(F.max_by(F.struct(*FIELDS), "seq").alias("e"))


def endpoint_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """IMP-06: key, change (added, removed, modified), what (fields that differ), was and now (struct of the fields)."""
    j = keyed(before).withColumnRenamed("e", "was").join(keyed(after).withColumnRenamed("e", "now"), "key", "full_outer")
    what = F.array_compact(F.array(*[F.when(~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}")), F.lit(c)) for c in FIELDS]))
    both = F.col("was").isNotNull() & F.col("now").isNotNull()
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.size(what) > 0, "modified")
    return j.select("key", change.alias("change"), F.when(both, what).otherwise(F.array().cast("array<string>")).alias("what"), "was", "now").where("change is not null")


def named_changes(before: Named, after: Named) -> DataFrame:
    """IMP-06: name, change, what: names that came, went, or whose items differ, with how many of each part came and went (+2 guards)."""
    (n1, p1), (n2, p2) = before, after
    names = n1.select("name").distinct().withColumn("a", F.lit(1)).join(n2.select("name").distinct().withColumn("b", F.lit(1)), "name", "full_outer")
    parts = []
    for part in p1:
        x = p1[part].select("name", "item").distinct().withColumn("x", F.lit(1)).join(p2[part].select("name", "item").distinct().withColumn("y", F.lit(1)), ["name", "item"], "full_outer")
        x = x.groupBy("name").agg(F.count_if(F.col("x").isNull()).alias("came"), F.count_if(F.col("y").isNull()).alias("went"))
        parts.append(x.select("name", F.lit(part).alias("part"), "came", "went"))
    moved = parts[0]
    for p in parts[1:]:
        moved = moved.unionByName(p)
    told = lambda sign, n: F.when(F.col(n) > 0, F.concat(F.lit(sign), n, F.lit(" "), "part"))
    moved = moved.where("came + went > 0").groupBy("name").agg(F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array(told("+", "came"), told("-", "went")))))).alias("what"))
    j = names.join(moved, "name", "left")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("what").isNotNull(), "modified")
    return j.select("name", change.alias("change"), F.when(change == "modified", F.col("what")).otherwise(F.array().cast("array<string>")).alias("what")).where("change is not null")


def security(before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """IMP-06: one row: open_added (new endpoints without roles), unprotected (roles all gone), risen (criticality), coverage_before, coverage_after (percent of
    endpoints with roles), level: critical, high, medium, low or none."""
    open_ = lambda e: F.size(F.coalesce(F.col(f"{e}.roles"), F.array().cast("array<string>"))) == 0
    added, modified = F.col("change") == "added", F.col("change") == "modified"
    c = changes.agg(
        F.count("*").alias("changes"), F.count_if(added & open_("now")).alias("open_added"), F.count_if(added & open_("now") & (F.col("now.criticality") >= HIGH)).alias("open_high"),
        F.count_if(modified & ~open_("was") & open_("now")).alias("unprotected"), F.count_if(modified & (F.col("now.criticality") > F.col("was.criticality"))).alias("risen"),
    )
    coverage = lambda df: keyed(df).agg(percent(F.count_if(F.size("e.roles") > 0), F.count("*"))).scalar()
    c = c.withColumns({"coverage_before": coverage(before), "coverage_after": coverage(after)})
    level = (
        F.when(F.col("unprotected") > 0, "critical")
        .when(F.col("open_high") > 0, "high")
        .when(F.col("open_added") > 0, "medium")
        .when((F.col("risen") > 0) | (F.col("coverage_after") - F.col("coverage_before") < -SLIGHT), "low")
        .when(F.col("changes") == 0, "none")
        .otherwise("low")
    )
    return c.select("open_added", "unprotected", "risen", "coverage_before", "coverage_after", level.alias("level"))


def summary(changes: dict[str, DataFrame]) -> DataFrame:
    """IMP-06: section, change, n."""
    out = None
    for section, df in changes.items():
        one = df.groupBy("change").agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "change", "n")
        out = one if out is None else out.unionByName(one)
    return out


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """IMP-07: kind, severity, target of what got worse and (kind RESOLVED_..., no severity) of what got better. before, after(endpoint, operation, entities).

    REMOVED_ENDPOINT low; LOST_ENTITY_LINK high: an endpoint that touched entities and touches none; COVERAGE_DROP medium: the percent of endpoints with
    entities fell by three points or more; NEW_OVERLAP medium: a class of writes and an entity that several endpoints serve; NEW_LIFECYCLE_GAP medium: an
    entity that is written and not read."""
    touched = lambda df: df.groupBy("endpoint").agg(F.bool_or(F.size("entities") > 0).alias("linked"))
    row = lambda df, kind, severity, target: df.select(kind.alias("kind"), F.lit(severity).cast("string").alias("severity"), target.alias("target"))
    j = touched(before).withColumnRenamed("linked", "was").join(touched(after).withColumnRenamed("linked", "now"), "endpoint", "left")
    out = row(j.where("now is null"), F.lit("REMOVED_ENDPOINT"), "low", F.col("endpoint")).unionByName(row(j.where("was and not now"), F.lit("LOST_ENTITY_LINK"), "high", F.col("endpoint")))
    share = lambda df: touched(df).agg(percent(F.count_if("linked"), F.count("*"))).scalar()
    fell = before.sparkSession.range(1).select((share(before) - share(after)).alias("points")).where(F.col("points") >= DROP)
    out = out.unionByName(row(fell, F.lit("COVERAGE_DROP"), "medium", F.lit("coverage")))
    overlaps = lambda df: cat.overlap(df).where("verb <> 'READ'").select(F.concat("verb", F.lit(":"), "entity").alias("target"))
    gaps = lambda df: cat.lifecycle(df).where("gap = 'WRITABLE_NOT_READABLE'").select(F.col("entity").alias("target"))
    for found, new, gone in ((overlaps, "NEW_OVERLAP", "RESOLVED_OVERLAP"), (gaps, "NEW_LIFECYCLE_GAP", "RESOLVED_LIFECYCLE_GAP")):
        a, b = found(before), found(after)
        out = out.unionByName(row(b.join(a, "target", "left_anti"), F.lit(new), "medium", F.col("target"))).unionByName(row(a.join(b, "target", "left_anti"), F.lit(gone), None, F.col("target")))
    return out
