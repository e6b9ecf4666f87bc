"""Operators over the endpoint catalog: coverage, governance, exposure, access, overlap, lifecycle, and the detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verbs that an operation's name may begin with, by class; the first class that matches holds.
VERBS = {
    "CREATE": "^(create|add|new|register|insert|import|bulkcreate|bulk|generate|provision|duplicate|clone|copy)",
    "UPDATE": "^(update|edit|patch|modify|change|rename)",
    "DELETE": "^(delete|remove|destroy|archive|purge)",
    "READ": "^(find|get|fetch|load|read|view|show|resolve|count|export|download|list|search|browse|query)",
}
#: Fields and entities that hold privileges, fields of high sensitivity, roles that administrate.
PRIVILEGE_FIELDS = "(?i)role|authorit|permission|isadmin|is_admin|admin|privilege|accesslevel|access_level|superuser"
PRIVILEGE_ENTITIES = "(?i)role|authority|permission|privilege"
HIGH_SENSITIVITY = "(?i)password|secret|token|apikey|api_key|creditcard|credit_card|ssn|socialsecurity"
ADMIN_ROLES = "(?i)admin|superuser|root|system"
DATA_ADMIN_ROLES = "(?i)admin|system|root"
MUTATING = ("POST", "PUT", "PATCH", "DELETE")


def is_protected() -> Column:
    return F.size("roles") > 0


def verb_class(operation: Column) -> Column:
    """FN-12"""
    out = F
    for name, pattern in VERBS.items():
        out = out.when(F.lower(operation).rlike(pattern), name)
    return out.otherwise("OTHER")


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; 100 of nothing."""
    return F.when(whole == 0, 100).otherwise(F.floor(part * 100 / whole + 0.5)).cast("long")


def coverage(entries: DataFrame) -> DataFrame:
    """AGG-08: totals, protected and percent in all, by method and by controller, in one aggregation."""
    e = entries.withColumn("p", is_protected())
    out = e.groupingSets([[], ["http_method"], ["controller"]], "http_method", "controller").agg(F.count("*").alias("total"), F.count_if("p").alias("protected"), F.count_if(~F.col("p") & (F.col("criticality") >= 70)).alias("critical_open"), F.count_if(~F.col("p") & F.col("criticality").between(50, 69)).alias("high_open"))
    kind = F.when(F.col("http_method").isNotNull(), "method").when(F.col("controller").isNotNull(), "controller").otherwise("all")
    return out.select(kind.alias("kind"), F.coalesce("http_method", "controller", F.lit("*")).alias("key"), "total", "protected", percent(F.col("protected"), F.col("total")).alias("percent"), "critical_open", "high_open")


def common_roles(entries: DataFrame, group: str = "controller") -> DataFrame:
    """AGG-09: roles that at least 40 % of a group's protected entries require."""
    p = entries.where(is_protected())
    sizes = p.groupBy(group).agg(F.count("*").alias("n"))
    roles = p.select(group, F.explode("roles").alias("role")).groupBy(group, "role").agg(F.count("*").alias("uses"))
    return roles.join(sizes, group).where("uses >= ceil(n * 0.4)").select(group, "role", "uses")


def governance(entries: DataFrame) -> DataFrame:
    """AGG-10: endpoints, methods and highest criticality by permission; bare authentication is no permission."""
    return entries.select("http_method", "criticality", F.explode("roles").alias("permission")).where("permission <> 'AUTHENTICATED'").groupBy("permission").agg(F.count("*").alias("endpoints"), F.count_distinct("http_method").alias("methods"), F.max("criticality").alias("highest"))


def unguarded(entries: DataFrame) -> DataFrame:
    """TOP-01: entries without a guard, the most critical first."""
    return entries.where(~is_protected()).select("entry_id", "endpoint", "http_method", "criticality")


def exposure(entries: DataFrame) -> DataFrame:
    """AGG-11: entries with sensitive fields by the strength of their guard."""
    guard = F.when(~is_protected(), "none").when(F.array_size(F.array_remove("roles", "AUTHENTICATED")) == 0, "auth-only").otherwise("permission")
    return entries.where(F.size("sensitive_fields") > 0).select("entry_id", "endpoint", guard.alias("guard"), "criticality", F.size("sensitive_fields").cast("long").alias("fields"))


def entity_access(entries: DataFrame) -> DataFrame:
    """AGG-12: readers and writers of each entity."""
    e = entries.select(F.explode("entities").alias("entity"), "endpoint", verb_class(F.col("operation")).alias("verb"))
    return e.groupBy("entity").agg(F.count_if(F.col("verb") == "READ").alias("reads"), F.count_if(F.col("verb").isin("CREATE", "UPDATE", "DELETE")).alias("writes"), F.count_distinct("endpoint").alias("endpoints"))


def overlap(entries: DataFrame) -> DataFrame:
    """AGG-13: (verb class, entity) pairs that more than one endpoint serves with the same verb class."""
    e = entries.select(verb_class(F.col("operation")).alias("verb"), F.explode("entities").alias("entity"), "endpoint").where("verb <> 'OTHER'")
    return e.groupBy("verb", "entity").agg(F.count_distinct("endpoint").alias("endpoints")).where("endpoints >= 2")


def lifecycle(entries: DataFrame) -> DataFrame:
    """AGG-14: entities by what can be done with them, and the gap if any."""
    e = entries.select(F.explode("entities").alias("entity"), verb_class(F.col("operation")).alias("verb")).where("verb <> 'OTHER'")
    can = e.groupBy("entity").agg(*(F.bool_or(F.col("verb") == v).alias(v.lower()) for v in ("CREATE", "UPDATE", "DELETE", "READ")))
    writes = F.col("create") | F.col("update") | F.col("delete")
    return can.withColumn("gap", F.when(writes & ~F.col("read"), "WRITABLE_NOT_READABLE").when(F.col("read") & ~writes, "READABLE_NOT_WRITABLE"))


def stats(entries: DataFrame) -> DataFrame:
    """AGG-33"""
    return entries.agg(F.count("*").alias("entries"), F.count_if(F.col("criticality") > 70).alias("critical"), F.count_distinct("controller").alias("controllers"), F.count_distinct("endpoint").alias("endpoints"))


def deduplicated(entries: DataFrame) -> DataFrame:
    """AGG-34: one row per (endpoint, method), the first by entry id, with the number of duplicates."""
    return entries.groupBy("endpoint", "http_method").agg(F.min("entry_id").alias("entry_id"), (F.count("*") - 1).alias("duplicates"), F.min_by("criticality", "entry_id").alias("criticality"))


def entity_domain() -> Column:
    """The first entity, else the first path part after the version, singular."""
    part = F.regexp_replace(F.element_at(F.split(F.col("endpoint"), "/"), 4), "s$", "")
    return F.lower(F.when(F.size("entities") > 0, F.get("entities", 0)).otherwise(part))


def _severity(high: int, mid: int, low: int) -> Column:
    c = F.col("criticality")
    return F.when(c >= high, "critical").when(c >= mid, "high").when(c >= low, "medium").otherwise("low")


def unprotected_outliers(entries: DataFrame) -> DataFrame:
    """SEC-01: open entries whose (method, domain) peers are protected at 50 % or more. Peers are counted, not joined pairwise."""
    e = entries.withColumns({"domain": entity_domain(), "p": is_protected()})
    groups = e.groupBy("http_method", "domain").agg(F.count("*").alias("n"), F.count_if("p").alias("k")).where("n >= 2 and k > 0 and k < n and k / n >= 0.5")
    return e.where(~F.col("p")).join(groups, ["http_method", "domain"]).select("entry_id", F.lit("UNPROTECTED_OUTLIER").alias("type"), _severity(70, 50, 30).alias("severity"))


def privilege_escalation(entries: DataFrame) -> DataFrame:
    """SEC-02"""
    risky = F.exists("entities", lambda x: x.rlike(PRIVILEGE_ENTITIES)) | F.exists("sensitive_fields", lambda x: x.rlike(PRIVILEGE_FIELDS))
    admin = F.exists("roles", lambda x: x.rlike(ADMIN_ROLES))
    e = entries.where(F.upper("http_method").isin("POST", "PUT", "PATCH") & risky & ~admin)
    return e.select("entry_id", F.lit("PRIVILEGE_ESCALATION").alias("type"), F.when(is_protected(), "high").otherwise("critical").alias("severity"))


def sensitive_exposure(entries: DataFrame) -> DataFrame:
    """SEC-03"""
    e = entries.where((F.upper("http_method") == "GET") & F.exists("sensitive_fields", lambda x: x.rlike(HIGH_SENSITIVITY)) & ~F.exists("roles", lambda x: x.rlike(DATA_ADMIN_ROLES)))
    return e.select("entry_id", F.lit("SENSITIVE_DATA_EXPOSURE").alias("type"), F.when(is_protected(), "medium").otherwise("critical").alias("severity"))


def inconsistent_protection(entries: DataFrame) -> DataFrame:
    """SEC-04: one row per controller."""
    p = is_protected()
    open_write = ~p & F.col("http_method").isin(*MUTATING)
    g = entries.groupBy("controller").agg(F.count("*").alias("total"), F.count_if(p).alias("protected"), F.count_if(open_write).alias("open_writes"), F.max(F.when(open_write, F.col("criticality"))).alias("highest"))
    g = g.where("total >= 2 and protected > 0 and protected < total and protected / total >= 0.5 and open_writes > 0")
    return g.select("controller", "total", "protected", "open_writes", F.when(F.col("highest") >= 50, "high").otherwise("medium").alias("severity"))


def missing_protection(entries: DataFrame) -> DataFrame:
    """SEC-05: critical open entries whose (method, endpoint) no earlier detector has named."""
    key = ["http_method", "endpoint"]
    named = unprotected_outliers(entries).unionByName(privilege_escalation(entries)).unionByName(sensitive_exposure(entries)).select("entry_id")
    bad = inconsistent_protection(entries).select("controller")
    writes = entries.where(~is_protected() & F.col("http_method").isin(*MUTATING)).join(bad, "controller", "left_semi").select(*key)
    reported = entries.join(named, "entry_id", "left_semi").select(*key).unionByName(writes).distinct()
    e = entries.where(~is_protected() & (F.col("criticality") >= 60)).join(reported, key, "left_anti")
    first = e.groupBy(*key).agg(F.min_by(F.struct("entry_id", "criticality"), "entry_id").alias("e")).select("e.*")
    return first.select("entry_id", F.lit("MISSING_PROTECTION").alias("type"), F.when(F.col("criticality") >= 80, "critical").otherwise("high").alias("severity"))


def coverage_gaps(entries: DataFrame) -> DataFrame:
    """SEC-06: one row in all, and one per changing method that is covered under 50 %."""
    c = coverage(entries)
    all_ = c.where("kind = 'all' and total > 0").select("key", "total", "percent", F.lit("info").alias("severity"))
    low = c.where("kind = 'method' and key <> 'GET' and percent < 50 and total >= 2").select("key", "total", "percent", F.when(F.col("key") == "DELETE", "high").otherwise("medium").alias("severity"))
    return all_.unionByName(low)


def security_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG-35: coverage of two catalogs by method, and the change."""
    part = lambda df, tag: df.select("http_method", is_protected().alias("p"), F.lit(tag).alias("run"))
    g = part(before, "a").unionByName(part(after, "b")).groupBy("http_method").agg(*(F.count_if((F.col("run") == r) & c).alias(f"{n}_{r}") for r in "ab" for n, c in (("total", F.lit(True)), ("protected", F.col("p")))))
    pa, pb = percent(F.col("protected_a"), F.col("total_a")), percent(F.col("protected_b"), F.col("total_b"))
    return g.select("http_method", pa.alias("before"), pb.alias("after"), (pb - pa).alias("delta"))


def latest_two(runs: DataFrame) -> DataFrame:
    """WIN-01: the last two runs of each group."""
    w = Window.partitionBy("grp").orderBy(F.desc("run_id"))
    return runs.withColumn("n", F.row_number().over(w)).where("n <= 2")
