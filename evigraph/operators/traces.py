"""Routes observed in traces, and what is still known of earlier runs. A span: trace_id, span_id, parent_id, service, start_ts, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import text

#: Paths that no user asks for.
NOISE = "(?i)/(healthz?|metrics|actuator|favicon|robots\\.txt)(/|$|\\?)"
#: An operation of the backend: a path of two segments, the last one with a version.
OPERATION = "/[A-Za-z][A-Za-z0-9]*/[A-Za-z][A-Za-z0-9]*\\.v\\d+"
SAMPLE = 5


def _tag(*names: str) -> Column:
    return F.coalesce(*[F.when(F.col("tags")[n] != "", F.col("tags")[n]) for n in names])


def facts(spans: DataFrame, operation: str = OPERATION) -> DataFrame:
    """Per span: its place in the trace, path, method and route, and items (kind, item, op): tables, endpoints, pages."""
    route = F.coalesce(_tag("http.route"), F.lit(""))
    item = lambda kind, value, op: F.struct(F.lit(kind).alias("kind"), value.alias("item"), op.alias("op"))
    none = F.lit(None).cast("string")
    tables = F.transform(text.tables_of_span(F.col("tags")), lambda t: item("table", text.normalize_table(t), F.nullif(text.db_operation(F.col("tags")), F.lit(""))))
    endpoint, page = F.regexp_extract(route, operation, 0), F.coalesce(_tag("page.route"), F.lit(""))
    some = F.filter(F.concat(tables, F.array(item("endpoint", endpoint, none), item("page", page, none))), lambda x: x["item"] != "")
    return spans.select(
        "start_ts",
        "trace_id",
        "span_id",
        "parent_id",
        "service",
        _tag("url.path", "http.target", "http.route").alias("path"),
        F.upper(F.coalesce(_tag("http.request.method", "http.method"), F.lit("GET"))).alias("method"),
        text.strip_query(route).alias("route"),
        F.array_distinct(some).alias("items"),
    )


def below(route: Column, path: Column) -> Column:
    """Whether a route is longer than a path and continues it; noise never does."""
    return F.startswith(route, F.when(F.endswith(path, F.lit("/")), path).otherwise(F.concat(path, F.lit("/")))) & (F.length(route) > F.length(path)) & ~route.rlike(NOISE)


def sample(trace: Column) -> Column:
    """At most five ids, the least of each fifth by digest: a sample whose state doesn't grow with the traces."""
    fifth = F.position(F.substring(F.md5(trace), 1, 1), F.lit("0123456789abcdef")) % SAMPLE
    return F.array_sort(F.array_compact(F.array(*[F.min(F.when(fifth == i, trace)) for i in range(SAMPLE)])))


def by_route(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (method, path, kind, item, op, at, trace_id, last_seen) of single traces, summed up by route and item."""
    g = rows.groupBy(*keys, "method", "path", "kind", "item")
    return g.agg(F.max_by("op", "at").alias("operation"), F.count("*").alias("traces"), F.max("last_seen").alias("last_seen"), sample(F.col("trace_id")).alias("sample"))


def root_of_trace(f: DataFrame, gateways: list[str]) -> DataFrame:
    """WIN-06: trace_id, path, method of the first gateway span with a path whose parent isn't in the trace; if all have one, of the first
    gateway span with a path. Traces without such a span, or with noise for a path, are left out."""
    own = f.where(F.col("service").isin(*gateways) & F.col("path").isNotNull())
    ids = f.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s")).distinct().withColumn("inside", F.lit(1))
    j = own.join(ids, (F.col("trace_id") == F.col("_t")) & (F.col("parent_id") == F.col("_s")), "left")
    first = F.struct(F.coalesce("inside", F.lit(0)).alias("k"), "start_ts", "span_id")
    r = j.groupBy("trace_id").agg(F.min_by(F.struct("span_id", text.strip_query(F.col("path")).alias("path"), "method"), first).alias("r")).select("trace_id", "r.*")
    return r.where((F.col("path") != "") & ~F.col("path").rlike(NOISE))


def route_observations(spans: DataFrame, gateways: list[str], services: list[str] | None = None, operation: str = OPERATION) -> DataFrame:
    """STR-01: method, path, kind (route, table, endpoint, page), item, operation, traces, last_seen, sample (five trace ids at most).

    The path is the root's, or the longest route of the trace that continues it. With `services`, only their spans and the gateways' are
    listened to. A table's operation is the last one that names any. Traces are aggregated in place: none is gathered in one row."""
    f = facts(spans, operation)
    roots = root_of_trace(f, gateways).withColumnsRenamed({"path": "root", "method": "verb"}).drop("span_id")
    heard = f if not services else f.where(F.col("service").isin(*services, *gateways))
    seen = heard.join(roots, "trace_id")
    best = F.when(below(F.col("route"), F.col("root")), F.struct((-F.length("route")).alias("n"), "start_ts", "span_id"))
    t = seen.groupBy("trace_id").agg(F.first("verb").alias("method"), F.coalesce(F.min_by("route", best), F.first("root")).alias("path"), F.max("start_ts").alias("last_seen"))
    items = seen.select("trace_id", "start_ts", "span_id", F.explode("items").alias("i")).select("*", "i.*")
    at = F.when(F.col("op").isNotNull(), F.struct("start_ts", "span_id"))
    items = items.groupBy("trace_id", "kind", "item").agg(F.max_by("op", at).alias("op"), F.max(at).alias("at")).join(t, "trace_id")
    whole = t.select("*", F.lit("route").alias("kind"), F.lit("").alias("item"), F.lit(None).cast("string").alias("op"), F.lit(None).cast(items.schema["at"].dataType).alias("at"))
    return by_route(whole.unionByName(items))


def observed_runs(hits: DataFrame, run: str = "1 day") -> DataFrame:
    """Table hits (table_name, start_ts) by run: table_name, run (its end), hits, last_seen. Batch or stream."""
    w = hits.groupBy(F.window("start_ts", run).alias("w"), "table_name").agg(F.count("*").alias("hits"), F.max("start_ts").alias("last_seen"))
    return w.select("table_name", F.col("w.end").alias("run"), "hits", "last_seen")


def carried_runs(observed: DataFrame, horizon: Column, run_days: int = 1, ttl_days: int = 7) -> DataFrame:
    """STR-03 over many runs: table_name, run, hits, last_seen, state. A run that saw a table is `fresh`; until it is seen again, runs that end within
    ttl_days after it was last seen carry it as `stale`, and the first one beyond is `decayed`. Runs end at `horizon` at the latest."""
    step, ttl = F.make_dt_interval(days=F.lit(run_days)), F.make_dt_interval(days=F.lit(ttl_days))
    next_run = F.lead("run").over(Window.partitionBy("table_name").orderBy("run"))
    o = observed.where(F.col("run") <= horizon).withColumn("until", F.coalesce(next_run - step, horizon))
    # one run more than the life of what was seen, so that the first run beyond it is there too
    o = o.withColumn("at", F.explode(F.sequence("run", F.greatest("run", F.least("until", F.col("last_seen") + ttl + step)), step)))
    alive = F.col("at") <= F.col("last_seen") + ttl
    state = F.when(F.col("at") == F.col("run"), "fresh").when(alive, "stale").otherwise("decayed")
    return o.select("table_name", F.col("at").alias("run"), "hits", "last_seen", state.alias("state"))
