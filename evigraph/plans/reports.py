"""Queries of the reports: health of the sources, completeness of edges, packages, surroundings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import evidence, reports
from evigraph.plans.queries import GRAPH, _add, _graph
from evigraph.plans.scalars import made

_add(
    "agg_24_edge_completeness", _graph(lambda e, n: reports.completeness(evidence.edge_evidence(evidence.existing_edges(e, n)).select(F.concat("src", F.lit(">"), "dst").alias("item"), F.col("method").alias("occasion")))),
    GRAPH + """, k as (select src || '>' || dst as item, count(distinct m) as k from em group by 1), c as (select count(*) as seen, count(*) filter (where k = 1) as f1, count(*) filter (where k = 2) as f2, (select count(distinct m) from em) as t from k),
b as (select *, f1 * (f1 - 1) / (2 * (f2 + 1)) as bias from c), z as (select *, seen + (t - 1) / t * bias as two from b) select seen, f1, f2, round(seen + bias, 4) as chao1, round(two, 4) as chao2, round((two - seen) / two, 4) as missed from z""",
)

_PARTS = _graph(lambda e, n: reports.packages(evidence.existing_edges(e, n), n.select("id", F.col("class_key").alias("package")))[1])
_TOP = """, top as (select class_key, count(*) as size from nodes group by 1 order by size desc, class_key limit 20), k as (select id, class_key from nodes where class_key in (select class_key from top))"""
_add(
    "agg_29_package_ties", _PARTS,
    GRAPH + _TOP + """ select a.class_key as src_package, b.class_key as dst_package, count(*) as edges, ['inferred', 'proven', 'observed'][1 + max(case when m = 'RUNTIME_OBSERVED' then 2 when m in ('STATIC_PROVEN', 'CONFIG_PROVEN') or coalesce(resolution, '') = 'compiler' then 1 else 0 end)] as best
from em join k a on src = a.id join k b on dst = b.id where a.class_key <> b.class_key and rel in ('CALLS', 'ASSOCIATES', 'READS_ENTITY', 'WRITES_ENTITY') group by 1, 2 order by edges desc, 1, 2 limit 90""",
)
_add(
    "ui_10_ego", _graph(lambda e, n: reports.ego(evidence.existing_edges(e, n), n, n.where("id = 'SERVICE:1'"))),
    GRAPH + """, x as (select dst as id, 1 as o, 0 as i from ex where src = 'SERVICE:1' union all select src, 0, 1 from ex where dst = 'SERVICE:1'), y as (select id, sum(o)::bigint as outbound, sum(i)::bigint as inbound from x where id <> 'SERVICE:1' group by id),
g as (select id, count(*) as degree from (select src as id from ex union all select dst from ex) group by id) select row_number() over (order by degree desc, y.id) as rank, y.id, degree, outbound, inbound, (select count(*) from y) as total from y join g on y.id = g.id order by rank limit 24""",
)

_PUSHES = "select 'static' as axis, o_orderkey as seq, cast(cast(o_orderdate as date) as varchar(20)) as pushed_at from orders union all select 'config', o_orderkey, case when o_orderstatus = 'F' then 'no time' end from orders"
_RUNS = "select o_orderkey as id, case o_orderstatus when 'F' then 'FAILED' else 'completed' end as status, cast(o_orderdate as timestamp) as started, cast(null as timestamp) as completed from orders"
_TRACES = "select o_orderkey as trace_id, cast(o_orderdate as timestamp) as last_seen, o_orderstatus = 'P' as anchored from orders"
_NOW = "1998-08-03 12:00:00"


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.health(*(made(spark, sf_dir, q) for q in (_PUSHES, _RUNS, _TRACES)), F.lit(_NOW))


_AXES = f"""with p as ({_PUSHES}), r as ({_RUNS}), t as ({_TRACES}), a as (
select axis, case when arg_max(pushed_at, seq) is null then 'no-timestamp' when try_cast(arg_max(pushed_at, seq) as timestamp) is null then 'invalid-timestamp' end as reason, try_cast(arg_max(pushed_at, seq) as timestamp) as at_ from (select axis, seq, coalesce(pushed_at, '') as pushed_at from p where axis = 'static') group by 1
union all select 'config', case when pushed_at is null then 'no-timestamp' else 'invalid-timestamp' end, null from (select * from p where axis = 'config' order by seq desc limit 1)
union all select 'analysis', case when status = 'FAILED' then 'last-run-failed' end, started from (select * from r order by started desc, id desc limit 1)
union all select 'runtime', case when count(*) filter (where anchored) = 0 then 'no-anchorable-traces' end, max(last_seen) from t),
h as (select axis, reason, greatest(epoch(timestamp '{_NOW}' - at_) / 3600, 0) as age_hours from a),
s as (select axis, case when reason = 'no-anchorable-traces' then 'absent' when reason = 'last-run-failed' then 'stale' when reason is not null then 'unknown' when age_hours > case axis when 'runtime' then 24 when 'analysis' then 48 else 168 end then 'stale' else 'fresh' end as status, reason, age_hours from h)"""
_add("str_08_axes", lambda spark, d: _axes(spark, d).withColumn("age_hours", F.round("age_hours", 4)), _AXES + " select axis, status, reason, round(case when reason in ('no-timestamp', 'invalid-timestamp') then null else age_hours end, 4) as age_hours from s")
_add(
    "str_08_overall", lambda spark, d: reports.overall(_axes(spark, d)),
    _AXES + ", c as (select count(*) filter (where status = 'fresh') as f, coalesce(string_agg(axis, ',' order by axis) filter (where status = 'stale' or reason = 'no-anchorable-traces'), '') as culprits from s) select case when f = 0 then 'starving' when culprits <> '' then 'degraded' else 'healthy' end as overall, culprits from c",
)
