"""Reading and writing what analyses leave: scans, lookups in the latest run, payloads with guards, findings, exports and signatures."""

from __future__ import annotations

import hmac

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators import catalog as cat
from evigraph.operators import fixpoint

#: Items that one kind of a payload may have, and rows that a lookup gives at most.
MOST_ITEMS, MOST_HITS = 10_000, 100


def payload_items(payloads: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """SRC-07: payloads(run_id, body: JSON of lists by kind) -> run_id, kind, name, file; a payload with more than `most` items of a kind fails."""
    item = "array<struct<name:string,file:string>>"
    kinds = ("entities", "pages", "composables", "routes", "i18n")
    p = payloads.select("run_id", F.from_json("body", ",".join(f"{k} {item}" for k in kinds)).alias("b"))
    size = F.greatest(*(F.coalesce(F.size(f"b.{k}"), F.lit(0)) for k in kinds))
    p = p.where(F.when(size > most, F.raise_error(F.lit("too many items")).cast("boolean")).otherwise(True))
    parts = [p.select("run_id", F.lit(k).alias("kind"), F.explode(f"b.{k}").alias("i")) for k in kinds]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("run_id", "kind", "i.name", "i.file")


def lookup_latest(items: DataFrame, kind: str, part: str, limit: int = MOST_HITS) -> DataFrame:
    """SRC-10: items(run_id, kind, name, file) of a kind's latest run whose name holds a part, whatever its case; by name, `limit` at most."""
    of = items.where(F.col("kind") == kind)
    latest = of.agg(F.max("run_id")).scalar()
    return of.where((F.col("run_id") == latest) & F.col("name").ilike(f"%{part}%")).orderBy("name", "file").limit(min(limit, MOST_HITS))


def load_graphs(projects: DataFrame, snapshots: DataFrame) -> DataFrame:
    """SRC-12: projects(id), snapshots(id, run_id, edges) -> id, run_id, edges, failure of each project's latest snapshot: NO_SNAPSHOT without one, NO_GRAPH
    where the latest has no edges."""
    last = snapshots.groupBy("id").agg(F.max_by(F.struct("run_id", "edges"), "run_id").alias("s"))
    j = projects.join(last, "id", "left").select("id", "s.run_id", "s.edges")
    return j.withColumn("failure", F.when(F.col("run_id").isNull(), "NO_SNAPSHOT").when(F.coalesce("edges", F.lit(0)) == 0, "NO_GRAPH"))


def findings(entries: DataFrame, missing: DataFrame) -> DataFrame:
    """SNK-03: source, type, severity, subject of all detectors in one shape: security, consistency (missing: http_method, url, severity), overlap
    and lifecycle."""
    row = lambda df, source, kind, severity, subject: df.select(F.lit(source).alias("source"), kind.alias("type"), severity.alias("severity"), subject.cast("string").alias("subject"))
    out = None
    for f in (cat.unprotected_outliers, cat.privilege_escalation, cat.sensitive_exposure, cat.missing_protection):
        one = row(f(entries), "security", F.col("type"), F.col("severity"), F.col("entry_id"))
        out = one if out is None else out.unionByName(one)
    out = out.unionByName(row(cat.inconsistent_protection(entries), "security", F.lit("INCONSISTENT_PROTECTION"), F.col("severity"), F.col("controller")))
    out = out.unionByName(row(missing, "consistency", F.lit("MISSING_ENDPOINT"), F.col("severity"), F.concat("http_method", F.lit(" "), "url")))
    out = out.unionByName(row(cat.overlap(entries), "overlap", F.lit("FUNCTIONAL_OVERLAP"), F.lit("low"), F.concat("verb", F.lit(" "), "entity")))
    return out.unionByName(row(cat.lifecycle(entries).where("gap is not null"), "lifecycle", F.col("gap"), F.lit("medium"), F.col("entity")))


def export(entries: DataFrame) -> DataFrame:
    """SNK-04, TOP-06: one JSON document per entry, the most critical first by `rank`.

    Ranks are a place within a range of the sorted entries and the sizes of the ranges before it; no window holds more than a range."""
    doc = F.to_json(F.struct("entry_id", "endpoint", F.col("http_method").alias("method"), "criticality", "roles"))
    ranged = entries.select("criticality", "entry_id", doc.alias("document")).orderBy(F.desc("criticality"), "entry_id")
    placed = fixpoint.cut(ranged.withColumn("at", F.monotonically_increasing_id())).withColumn("range", F.shiftright("at", 33))
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))
    above = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    within = F.col("at") - F.shiftleft(F.col("range"), 33) + 1
    return placed.join(above, "range").select("entry_id", (F.col("above") + within).alias("rank"), "document")


def schema_fields(entities: DataFrame, graph_entities: DataFrame) -> DataFrame:
    """SNK-05: (entity, field, source): fields of entities(entity, fields) that the catalog knows; only if it knows none, those of the graph's."""
    flat = lambda df, source: df.select("entity", F.explode("fields").alias("field"), F.lit(source).alias("source")).distinct()
    own = flat(entities, "catalog")
    empty = own.agg(F.count("*") == 0).scalar()
    return own.unionByName(flat(graph_entities, "graph").where(empty))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """SNK-07 on columns: HMAC by two hashes; keys of 64 bytes at most."""
    if len(key) > 64:
        raise ValueError("the key is longer than a block")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key.ljust(64, b"\0")).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def signed(reports: DataFrame, key: bytes) -> DataFrame:
    """SNK-07: reports(id, body) -> id, sha256, hmac."""
    return reports.select("id", F.sha2("body", 256).alias("sha256"), hmac_sha256(F.col("body"), key).alias("hmac"))


def verified(reports: DataFrame, signatures: DataFrame, key: bytes) -> DataFrame:
    """SNK-07: reports(id, body), signatures(id, hmac) -> id, valid."""
    return signed(reports, key).select("id", F.col("hmac").alias("own")).join(signatures.select("id", "hmac"), "id").select("id", (F.col("own") == F.col("hmac")).alias("valid"))


def plain_hmac(message: str, key: bytes) -> str:
    return hmac.new(key, message.encode(), "sha256").hexdigest()


def exposures_by_rank(entries: DataFrame, top: int = 50) -> DataFrame:
    """TOP-02: exposures, the weakest guard first, then the most critical, then by path."""
    rank = F.when(F.col("guard") == "none", 0).when(F.col("guard") == "auth-only", 1).otherwise(2)
    return cat.exposure(entries).withColumn("guard_rank", rank).orderBy("guard_rank", F.desc("criticality"), "endpoint", "entry_id").limit(top).select("entry_id", "guard", "criticality", "endpoint")


def refined_routes(spans: DataFrame, roots: DataFrame) -> DataFrame:
    """WIN-07: spans(trace_id, seq, route), roots(trace_id, path) -> trace_id, route: the longest route under the root's path that a span of the trace names, the
    first one of that length; else the path."""
    under = F.startswith(F.col("route"), F.when(F.endswith(F.col("path"), F.lit("/")), F.col("path")).otherwise(F.concat("path", F.lit("/"))))
    best = spans.join(roots, "trace_id").where(under).groupBy("trace_id").agg(F.min_by("route", F.struct((-F.length("route")).alias("n"), "seq")).alias("best"))
    return roots.join(best, "trace_id", "left").select("trace_id", F.coalesce("best", "path").alias("route"))
