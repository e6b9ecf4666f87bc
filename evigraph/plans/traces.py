"""Queries over traces: the data source, routes and what is still known, as batches and as streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import traces
from evigraph.plans.queries import _add
from evigraph.plans.scalars import made
from evigraph.sources.shared import scratch
from evigraph.sources.traces import TraceSource, spans_of, write_traces
from evigraph.streaming import spans as events
from evigraph.streaming import traces as streams

CALLS = """select cast(user_id as varchar(20)) || '/' || cast(cast(ts as date) as varchar(20)) as trace_id, event_id as span_id,
  case when event_id % 7 = 0 then event_id + 1000000000000 when event_id % 5 <> 0 then lag(event_id) over (partition by user_id, cast(ts as date) order by ts, event_id) end as parent_id,
  case event_id % 3 when 0 then 'gateway' when 1 then 'backend' else 'billing' end as service, ts as start_ts,
  case when event_id % 3 = 0 then case when event_id % 30 = 0 then '/health' when event_id % 10 <> 9 then '/' || replace(event_type, '_', '') || '?q=1' end end as url_path,
  case when event_id % 2 = 0 then 'post' end as http_method, case when event_id % 3 > 0 then '/' || replace(event_type, '_', '') || '/find' || cast(user_id % 4 as varchar(20)) || '.v1' end as http_route,
  case when event_id % 4 = 1 then 'app.tab' || cast(event_id % 17 as varchar(20)) end as db_table, case when event_id % 9 = 0 then 'select * from app.tab' || cast(event_id % 17 as varchar(20)) || ' t join users u' end as statement,
  case event_id % 5 when 0 then 'select' when 1 then 'update' end as db_op, case when event_id % 6 = 0 then '/page/' || cast(user_id % 3 as varchar(20)) end as page from events"""
TAGS = {"url.path": "url_path", "http.request.method": "http_method", "http.route": "http_route", "db.collection.name": "db_table", "db.statement": "statement", "db.operation": "db_op", "page.route": "page"}
GATEWAYS, SERVICES, FETCHED = ["gateway"], ["backend"], "gateway,backend,billing"
LOOKBACK_DAYS, LIMIT = 40, 50


def calls(spark: SparkSession, d: str) -> DataFrame:
    tags = F.create_map(*[x for tag, column in TAGS.items() for x in (F.lit(tag), F.col(column))])
    return made(spark, d, CALLS).select("trace_id", "span_id", "parent_id", "service", F.col("start_ts").cast("timestamp").alias("start_ts"), tags.alias("tags"))


def _files(spark: SparkSession, d: str) -> str:
    """Trace files; the oldest bucket of one service can't be read."""
    path = scratch(spark, "traces")
    c = calls(spark, d)
    write_traces(c, path)
    oldest = c.select(F.floor(F.unix_micros(F.min("start_ts")) / 86_400_000_000)).scalar()
    spark.range(1).select(F.lit('{"trace_id": "cut').alias("value"), F.lit("billing").alias("service"), oldest.alias("bucket")).write.mode("append").partitionBy("service", "bucket").text(path)
    return path


def _source(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(TraceSource)
    return spark.read.format("traces").options(path=path, services=FETCHED, lookback_s=LOOKBACK_DAYS * 86_400, limit=LIMIT, **options).load()


def _recent(spark: SparkSession, d: str) -> DataFrame:
    t = _source(spark, _files(spark, d)).groupBy("trace_id").agg(F.min_by("service", F.array_position(F.array(*map(F.lit, FETCHED.split(","))), F.col("service"))).alias("service"), F.max("last_us").alias("last_us"))
    return t.select("trace_id", "service", F.timestamp_micros("last_us").cast("timestamp_ntz").alias("last_seen"))


_FETCH = f"""with calls as ({CALLS}), t as (select trace_id, max(start_ts) as l from calls group by trace_id), s as (select distinct service, c.trace_id, l from calls c join t on c.trace_id = t.trace_id),
n as (select date_trunc('day', max(start_ts)) + interval 1 day as now from calls),
w as (select *, row_number() over (partition by service order by l desc, trace_id) as k from s, n where l >= now - case when service = 'billing' then interval {LOOKBACK_DAYS // 2} day else interval {LOOKBACK_DAYS} day end)"""
_add("src_04_recent_traces", _recent, _FETCH + f" select trace_id, arg_min(service, case service when 'gateway' then 1 when 'backend' then 2 else 3 end) as service, max(l) as last_seen from w where k <= {LIMIT} group by trace_id")
_add(
    "src_04_fetch_report",
    lambda spark, d: _source(spark, _files(spark, d), report="true"),
    _FETCH + f" select service, true as ok, cast(null as varchar) as error, least(count(*), {LIMIT}) as traces, service = 'billing' as retried, case when service = 'billing' then {LOOKBACK_DAYS // 2 * 86_400} else {LOOKBACK_DAYS * 86_400} end::bigint as lookback_s from w group by service",
)
_add("src_04_stream_spans", lambda spark, d: streams.drain(_streamed(spark, d).select("trace_id", "span_id", "service").withColumn("tables", F.lit(1)), scratch(spark, "spans")).distinct().groupBy("service").agg(F.count("*").alias("spans"), F.count_distinct("trace_id").alias("traces")), f"with calls as ({CALLS}) select service, count(*) as spans, count(distinct trace_id) as traces from calls group by service")

_TABLES = "case when db_table is not null then [replace(db_table, 'app.', '')] when statement is not null then ['tab' || (span_id % 17)::varchar, 'users'] else [] end"
ROOTS = f"""with calls as ({CALLS}),
own as (select c.*, p.span_id is not null as inside from calls c left join calls p on p.trace_id = c.trace_id and p.span_id = c.parent_id where c.service = 'gateway' and c.url_path is not null),
roots as (select trace_id, span_id, replace(url_path, '?q=1', '') as root, upper(coalesce(http_method, 'GET')) as verb from (select *, row_number() over (partition by trace_id order by inside, start_ts, span_id) as k from own) where k = 1 and url_path <> '/health')"""


def _routes_sql(window: bool) -> str:
    key = "window_end, " if window else ""
    return (
        ROOTS
        + f""",
ended as (select trace_id, date_trunc('day', max(start_ts) + interval 1 day - interval 1 microsecond) + interval 1 day as window_end from calls group by trace_id),
heard as (select c.*, root, verb from calls c join roots r on c.trace_id = r.trace_id where service in ('gateway', 'backend')),
best as (select trace_id, http_route as best from (select *, row_number() over (partition by trace_id order by -length(http_route), start_ts, span_id) as k from heard where starts_with(http_route, root || '/')) where k = 1),
t as (select h.trace_id, window_end, verb as method, coalesce(best, root) as path, max(start_ts) as last_seen from heard h join ended e on h.trace_id = e.trace_id left join best b on h.trace_id = b.trace_id group by all),
i as (select trace_id, 'table' as kind, unnest({_TABLES}) as item, upper(db_op) as op, start_ts, span_id from heard union all select trace_id, 'endpoint', http_route, null, start_ts, span_id from heard where http_route is not null union all select trace_id, 'page', page, null, start_ts, span_id from heard where page is not null),
ti as (select trace_id, kind, item, arg_max(op, row(start_ts, span_id)) filter (where op is not null) as op, max(row(start_ts, span_id)) filter (where op is not null) as named from i group by all),
a as (select t.*, 'route' as kind, '' as item, cast(null as varchar) as op, null as named from t union all select t.*, kind, item, op, named from t join ti on t.trace_id = ti.trace_id),
f as (select *, instr('0123456789abcdef', md5(trace_id)[1]) % 5 as k from a)
select {key}method, path, kind, item, arg_max(op, named) filter (where op is not null) as operation, count(*) as traces, max(last_seen) as last_seen,
  array_to_string(list_sort(list_filter([{", ".join(f"min(trace_id) filter (where k = {i})" for i in range(5))}], lambda x: x is not null)), ',') as sample
from f {"where window_end <= (select max(start_ts) - interval 10 minute from calls)" if window else ""} group by {key}method, path, kind, item"""
    )


def _told(df: DataFrame) -> DataFrame:
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("window_end", "run", "last_seen") if c in df.columns}
    return df.withColumns(times | ({"sample": F.array_join("sample", ",")} if "sample" in df.columns else {}))


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """The spans of the trace files as a stream; a trace comes once from each of its services."""
    path = scratch(spark, "traces")
    write_traces(calls(spark, d), path)
    spark.dataSource.register(TraceSource)
    return spans_of(spark.readStream.format("traces").options(path=path, services=FETCHED, last="true").load())


_add("win_06_trace_roots", lambda spark, d: traces.root_of_trace(traces.facts(calls(spark, d)), GATEWAYS), ROOTS + " select trace_id, span_id, root as path, verb as method from roots")
_add("str_01_route_observations", lambda spark, d: _told(traces.route_observations(calls(spark, d), GATEWAYS, SERVICES)), _routes_sql(False))
_add("str_01_stream_route_observations", lambda spark, d: _told(streams.drain(streams.route_observations(_streamed(spark, d), GATEWAYS, SERVICES, gap="1 day"), scratch(spark, "routes"))), _routes_sql(True))

HITS = "select 'T' || cast(event_id % 17 as varchar(20)) || '_' || cast(user_id as varchar(20)) as table_name, ts as start_ts from events"
_RUNS = f"""with hits as ({HITS}), h as (select date_trunc('day', max(start_ts) - interval 10 minute) as horizon from hits),
o as (select table_name, date_trunc('day', start_ts) + interval 1 day as run, count(*) as hits, max(start_ts) as last_seen from hits group by 1, 2),
n as (select *, lead(run) over (partition by table_name order by run) as next from o, h where run <= horizon),
a as (select *, unnest(generate_series(run, greatest(run, least(coalesce(next - interval 1 day, horizon), last_seen + interval 8 day)), interval 1 day)) as day from n)
select table_name, day as run, hits, last_seen, case when day = run then 'fresh' when day <= last_seen + interval 7 day then 'stale' else 'decayed' end as state from a"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return made(spark, d, HITS).select("table_name", F.col("start_ts").cast("timestamp").alias("start_ts"))


def _hit_stream(spark: SparkSession, d: str) -> DataFrame:
    e = events.events(spark, d)
    return spark.sql(HITS.replace("from events", "from {events}"), events=e).select("table_name", F.col("start_ts").cast("timestamp").alias("start_ts"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d)
    horizon = hits.select(F.date_trunc("day", F.max("start_ts") - F.make_dt_interval(mins=F.lit(10)))).scalar()
    return _told(traces.carried_runs(traces.observed_runs(hits), horizon))


def _run_stream(spark: SparkSession, d: str) -> DataFrame:
    with streams.with_rocksdb(spark):
        return _told(streams.drain(streams.carried_runs(_hit_stream(spark, d)), scratch(spark, "runs")))


_add("str_03_runs", _runs, _RUNS)
_add("str_03_stream_runs", _run_stream, _RUNS)
