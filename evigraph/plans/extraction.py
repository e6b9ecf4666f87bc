"""Queries over names, URLs, classes and walks, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.operators import catalog as cat
from evigraph.operators import classify, extract, matching, runtime, walks
from evigraph.plans.adapters import FRAMES, TABLES, _named, frame, with_frames
from evigraph.plans.queries import GRAPH, LISTS, SPANS, _add, _entries, _graph, _roots, _spans, oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

_SHOP = "lower(c_mktsegment) || 's'"
_LAND = "lower(replace(n_name, ' ', '-'))"

#: Frames of this module, as SQL for both engines.
LOCAL = {
    "routes": f"select min(c_custkey) as seq, '/api/v1/' || {_SHOP} || '/:id/' || {_LAND} as path from customer join nation on c_nationkey = n_nationkey group by '/api/v1/' || {_SHOP} || '/:id/' || {_LAND}",
    "calls": f"""select o_orderkey as url_id, case when o_orderkey % 9 = 0 then '' when o_orderkey % 2 = 0 then 'GET' else 'POST' end as method,
  case o_orderkey % 6 when 0 then '/api/v1/' || {_SHOP} || '/' || cast(o_orderkey % 40 as varchar(20)) || '/' || {_LAND} || '?page=1' when 1 then '/api/v1/' || {_SHOP} || '/all' when 2 then 'https://api.example.org/' || {_LAND}
  when 3 then '/gw/' || {_LAND} || '/' else '/files/' || {_LAND} || '/' || cast(o_orderkey % 40 as varchar(20)) end as url from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "ops": """select p_partkey as seq, case p_partkey % 7 when 0 then 'create' when 1 then 'add' when 2 then 'update' when 3 then 'find' when 4 then 'list' when 5 then 'approve' else 'delete' end || replace(p_brand, '#', '') || case when p_partkey % 2 = 0 then 's' else '' end as operation,
  '/op/' || cast(p_size as varchar(20)) as endpoint, case p_partkey % 5 when 0 then 'GET' when 1 then 'POST' when 2 then 'PATCH' when 3 then 'DELETE' end as http_method from part""",
    "modules": """select p_partkey as id, case p_partkey % 9 when 0 then 'CONTROLLER' when 1 then 'SERVICE' when 2 then 'REPOSITORY' when 3 then 'ENTITY' when 4 then 'VIEW' when 5 then 'COMPONENT' when 6 then 'COMPOSABLE' when 7 then 'ROUTE' else 'OTHER' end as type, p_size % 10 = 0 as http,
  case p_size % 8 when 0 then 'src/web/AController.java' when 1 then 'src/service/B.java' when 2 then 'src/repositories/c.repository.ts' when 3 then 'src/domain/D.java' when 4 then 'src/pages/E.vue' when 5 then 'src/components/F.vue' when 6 then 'src/composables/useG.ts' else '' end as source_file from part""",
}


def local(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", LOCAL[name])]
    return spark.sql(_named(LOCAL[name], used), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def having(*names: str) -> str:
    return "with " + ",\n".join(f"{n} as ({LOCAL.get(n) or FRAMES[n]})" for n in names)


_add(
    "fn_08_normal_urls",
    lambda spark, d: local(spark, d, "calls").select("url_id", text.normalize_url(F.col("url")).alias("url"), text.is_external(F.col("url")).alias("external"), text.strip_url(F.col("url")).alias("bare"), text.operation_of_url(F.col("url")).alias("op")),
    having("calls") + " select url_id, trim(regexp_replace(url, '/+', '/', 'g')) as url, regexp_matches(url, '^https?://') as external, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/{2,}', '/', 'g') as bare, cast(null as varchar) as op from calls",
)
_add(
    "fn_03_sql_tables",
    lambda spark, d: frame(spark, d, "orders").select("o_orderkey", F.array_join(text.tables_of_sql(F.concat(F.lit('SELECT * FROM "app".'), F.when(F.col("o_orderkey") % 2 == 0, "Orders").otherwise("[Lines]"), F.lit(" JOIN Users u ON 1=1 JOIN app.users WHERE x IN (SELECT 1 FROM select)"))), ",").alias("tables")),
    "select o_orderkey, case when o_orderkey % 2 = 0 then 'orders' else 'lines' end || ',users' as tables from orders",
)
_VERB = "case when operation like 'delete%' then 'DELETE' when operation like 'update%' then 'UPDATE' when operation like 'create%' or operation like 'add%' then 'CREATE' when operation like 'find%' or operation like 'list%' then 'READ' else 'OTHER' end"
_add(
    "fn_13_convention_verbs",
    lambda spark, d: local(spark, d, "ops").select("seq", text.convention_verb(F.col("operation")).alias("v")).select("seq", "v.*"),
    having("ops") + f" select seq, case when operation like 'find%' or operation like 'list%' then 'GET' else 'POST' end as http_method, case when operation like 'approve%' then 'CREATE' else {_VERB} end as operation from ops",
)
_add(
    "agg_13_operation_overlap",
    lambda spark, d: classify.operation_overlap(local(spark, d, "ops"), cat.verb_class(F.col("operation"))),
    having("ops") + f""", o as (select {_VERB} as verb, lower(regexp_extract(operation, 'Brand.*$')) as rest, operation, endpoint from ops where operation not like 'approve%')
select verb, case when rest like '%s' then rest[:-2] else rest end as entity, case when rest like '%s' then 'collection' else 'single' end as cardinality, count(distinct operation) as operations, count(distinct endpoint) as endpoints from o group by 1, 2, 3 having count(distinct operation) >= 2""",
)
_add(
    "prj_06_canonical_roles",
    lambda spark, d: classify.canonical_role(local(spark, d, "modules")),
    having("modules") + """, m as (select id, http, nullif(source_file, '') as p, case type when 'CONTROLLER' then 'Controller' when 'SERVICE' then 'Service' when 'REPOSITORY' then 'Repository' when 'ENTITY' then 'Entity' when 'VIEW' then 'View' when 'COMPONENT' then 'UiComponent' when 'COMPOSABLE' then 'Composable' when 'ROUTE' then 'Route' end as role from modules),
a as (select *, case role when 'Controller' then case when lower(p) similar to '.*(controller|/web/|resource).*' then true when lower(p) similar to '.*(/service|repositor|/entit).*' then false end
  when 'Service' then case when lower(p) like '%service%' then true when lower(p) similar to '.*(controller|repositor|/entit).*' then false end when 'Repository' then case when lower(p) like '%repositor%' then true when lower(p) similar to '.*(controller|/service).*' then false end
  when 'Entity' then case when lower(p) like '%/domain/%' then true end when 'View' then case when p not like '%.vue' then false when p like '%/pages/%' then true end when 'UiComponent' then case when p not like '%.vue' then false when p like '%/components/%' then true end
  when 'Composable' then case when p like '%/composables/%' then true end end as ok from m where role is not null),
e as (select *, case when role = 'Controller' and http then 'http-endpoint' when ok then 'path-corroborated' when not ok then 'path-conflict' else 'producer-type' end as evidence from a)
select id, role, case when role in ('Controller', 'Route') then 'api' when role = 'Service' then 'domain' when role in ('Repository', 'Entity') then 'data' else 'presentation' end as layer,
  case when p like '%.vue' then 'vue' when p like '%.java' then 'spring' when role in ('View', 'UiComponent', 'Composable') then 'vue' when role = 'Route' then 'express' when p like '%.ts' then 'node' else 'spring' end as stack, evidence,
  case when evidence in ('http-endpoint', 'path-corroborated') then 'high' when evidence = 'path-conflict' then 'low' else 'medium' end as confidence from e""",
)
_add("prj_07_backend_types", lambda spark, d: local(spark, d, "modules").select("id", classify.backend_type(F.col("source_file")).alias("type")), having("modules") + " select id, case when source_file like '%repositories%' then 'REPOSITORY' else 'SERVICE' end as type from modules")


def _classified(e: DataFrame) -> DataFrame:
    e = e.withColumns({"technical_operation": F.when(F.col("entry_id") % 3 == 0, "UNKNOWN").otherwise(cat.verb_class(F.col("operation"))), "interaction": F.lit("button: save"), "screen": F.lit("S"), "controller_method": F.when(F.col("entry_id") % 2 == 0, F.col("operation")), "persistence": F.when(F.col("entry_id") % 5 == 0, F.array(F.lit("save"))).otherwise(F.array().cast("array<string>"))})
    return classify.classified(e)


_add(
    "prj_08_classified",
    _entries(_classified),
    LISTS + """, o as (select *, case when entry_id % 3 <> 0 then verb else case http_method when 'GET' then 'READ' when 'POST' then 'WRITE' when 'PUT' then 'WRITE' when 'PATCH' then 'STATE_CHANGE' else 'DELETE' end end as op from c),
s as (select *, case op when 'DELETE' then 60 when 'WRITE' then 40 when 'CREATE' then 40 when 'UPDATE' then 45 when 'STATE_CHANGE' then 50 when 'READ' then 10 else 20 end + least(len(entities) * 5, 15) + case when len(list_filter(entities, lambda x: regexp_matches(lower(x), 'order|role'))) > 0 then 15 else 0 end as b,
  case op when 'READ' then 'View' when 'WRITE' then 'Create' when 'CREATE' then 'Create' when 'UPDATE' then 'Update' when 'DELETE' then 'Delete' when 'STATE_CHANGE' then 'Modify' else 'Access' end as v from o)
select entry_id, op as operation, least(100, greatest(b, case when entry_id % 5 = 0 then 35 else 0 end))::bigint as criticality, v || ' ' || case when len(entities) = 0 then endpoint when entry_id % 2 = 0 then array_to_string(entities, ', ') || ' via ' || operation else array_to_string(entities, ', ') end as meaning from s""",
)


def _structure(e: DataFrame) -> DataFrame:
    hops = F.slice(F.array(F.lit("a.ts"), F.lit("unknown"), F.lit("b.ts"), F.lit("c.ts"), F.lit("d.ts")), 1, (F.col("entry_id") % 6).cast("int"))
    e = e.withColumns({"hops": hops, "ctl": F.when(F.col("entry_id") % 4 > 0, F.col("controller")), "svc": F.array("operation"), "none": F.array().cast("array<string>"), "ops": F.when(F.col("entry_id") % 11 == 0, F.array(F.lit("SAVE"))).otherwise(F.array().cast("array<string>"))})
    return e.select("entry_id", classify.operation_type("svc", "none", "http_method", "ops").alias("type"), classify.structural_confidence("hops", "ctl", "entities").alias("confidence"))


_add(
    "prj_09_10_operation_types",
    _entries(_structure),
    LISTS + """, r as (select *, case entry_id % 6 when 0 then 0 when 1 then 1 when 2 then 1 when 3 then 2 when 4 then 3 else 4 end as real from c)
select entry_id, case when operation like 'delete%' then 'DELETE' when entry_id % 11 = 0 and http_method = 'POST' then 'CREATE' when entry_id % 11 = 0 and http_method in ('PUT', 'PATCH') then 'UPDATE' when operation like 'create%' then 'CREATE' when operation like 'update%' then 'UPDATE' when operation like 'find%' or operation like 'list%' then 'READ'
  else case http_method when 'GET' then 'READ' when 'POST' then 'CREATE' when 'PUT' then 'UPDATE' when 'PATCH' then 'UPDATE' else 'DELETE' end end as type,
  case when entry_id % 6 > 0 then least(1.0, round(0.3::double + case when entry_id % 4 > 0 then 0.35::double else 0 end + case when len(entities) > 0 then 0.2::double else 0 end + case when real = 1 then 0.15::double when real = 2 then 0.1::double when real > 2 then 0.05::double else 0 end, 2)) end as confidence from r""",
)
_add(
    "prj_14_lenses",
    _graph(lambda e, n: classify.lenses(e, n).groupBy("persona", "rel").agg(F.count("*").alias("n"))),
    GRAPH + """, t as (select rel, a.type as st, b.type as dt, a.sensitive or b.sensitive as s from ex join nodes a on src = a.id join nodes b on dst = b.id)
select 'dev' as persona, rel, count(*) as n from t group by rel union all select 'impact', rel, count(*) from t group by rel union all select 'security', rel, count(*) from t where s group by rel
union all select 'data', rel, count(*) from t where 'ENTITY' in (st, dt) or rel like '%ENTITY' group by rel union all select 'architect', rel, count(*) from t where st <> dt group by rel union all select 'business', rel, count(*) from t where 'CONTROLLER' in (st, dt) group by rel""",
)


def _entry_points(spark: SparkSession, d: str) -> DataFrame:
    e = frame(spark, d, "catalog")
    k = F.col("entry_id")
    ids = F.when(k % 5 == 4, F.concat(F.lit("JOB:"), k)).otherwise(F.concat(F.lit("route:"), F.when(k % 2 == 0, "runtime:").otherwise(""), "http_method", F.lit(":"), "endpoint"))
    return classify.entry_points(e.select(ids.alias("id"), F.when(k % 5 == 4, "SERVICE").otherwise("ROUTE").alias("type"), k.alias("seq"), F.lit(None).cast("string").alias("http_method"), F.lit(None).cast("string").alias("endpoint"), F.array(F.when(k % 10 == 4, "scheduled").otherwise("event")).alias("triggers"), (k % 3 == 0).alias("observed")))


_add(
    "prj_17_entry_points",
    _entry_points,
    having("catalog") + """, r as (select entry_id as k, http_method || ' ' || endpoint as label, 'route:' || case when entry_id % 2 = 0 then 'runtime:' else '' end || http_method || ':' || endpoint as id, entry_id % 3 = 0 as o, entry_id % 2 = 0 as rt from catalog where entry_id % 5 <> 4)
select label, 'route' as kind, arg_min(id, row(not o, not rt, case when rt then -k else k end)) as id, bool_or(o) as observed from r group by label
union all select case when entry_id % 10 = 4 then 'scheduled' else 'event' end || ' JOB:' || entry_id, case when entry_id % 10 = 4 then 'batch' else 'job' end, 'JOB:' || entry_id, entry_id % 3 = 0 from catalog where entry_id % 5 = 4""",
)
_add(
    "sec_07_missing_endpoints",
    lambda spark, d: classify.missing_endpoints(local(spark, d, "calls").select(F.col("url_id").alias("seq"), F.when(F.col("url_id") % 7 == 0, "UI_ONLY").otherwise("HTTP").alias("category"), "url", F.nullif("method", F.lit("")).alias("http_method"), (F.col("url_id") % 4 == 0).alias("mapped"), F.when(F.col("url_id") % 5 == 0, 0.3).otherwise(0.9).alias("confidence"))),
    having("calls") + " select coalesce(nullif(method, ''), 'ANY') as http_method, url, min(url_id) as seq, case when method = 'POST' then 'high' else 'medium' end as severity from calls where url_id % 7 <> 0 and url_id % 4 <> 0 and url_id % 5 <> 0 group by method, url",
)
_add("ext_28_architecture", _entries(lambda e: classify.architecture(e.select(F.col("controller").alias("class_name"), F.col("operation").alias("method_name"), F.col("endpoint").alias("path"), (F.col("entry_id") % 2 == 0).alias("rest")))), having("catalog") + " select case when count(*) = 0 then 'EXTERNAL_API_GATEWAY' else 'REST_CONTROLLER' end as type, round(case when count(distinct operation) / count(*) >= 0.3 then 0.3::double else 0 end + 0.55::double, 2) as confidence from catalog")
_add(
    "agg_21_delivery_risk",
    lambda spark, d: classify.delivery_risk(frame(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("grp"), F.concat(F.when(F.col("l_suppkey") % 60 == 0, "db/migrations/").when(F.col("l_suppkey") % 45 == 0, "auth/").otherwise("src/"), "l_suppkey").alias("path"), F.lit(3).alias("lines"), F.when(F.col("l_partkey") % 199 == 0, 1).otherwise(0).alias("alerts"), (F.col("l_partkey") % 18).alias("fan_in")), F.col("alerts"), F.col("fan_in")),
    """with c as (select l_orderkey % 500 as grp, case when l_suppkey % 60 = 0 then 'm' when l_suppkey % 45 = 0 then 'a' else 's' end as k, l_suppkey, 3 * count(*) as n, sum(case when l_partkey % 199 = 0 then 1 else 0 end) as a, max(l_partkey % 18) as f from lineitem group by all),
g as (select grp, sum(n) as lines, count(*) as files, sum(n * log2(n)) as s, sum(a) as al, max(f) as fan, bool_or(k = 'm') as mig, bool_or(k = 'a') as sec from c group by grp),
v as (select grp, case when al > 0 then 2 else 0 end as breakage, case when lines > 800 or files > 25 then 2 when lines > 200 or files > 8 then 1 else 0 end as churn, case when files < 3 then 0 when round((log2(lines) - s / lines) / log2(files), 4) >= 0.85 then 2 when round((log2(lines) - s / lines) / log2(files), 4) >= 0.6 then 1 else 0 end as entropy,
  case when fan >= 20 then 2 when fan >= 5 then 1 else 0 end as hub, case when mig and sec then 2 when mig or sec then 1 else 0 end as sensitive from g), w as (select *, greatest(breakage, churn, entropy, hub, sensitive) as level from v)
select grp, ['low', 'medium', 'high'][breakage + 1] as breakage, ['low', 'medium', 'high'][churn + 1] as churn, ['low', 'medium', 'high'][entropy + 1] as entropy, ['low', 'medium', 'high'][hub + 1] as hub, ['low', 'medium', 'high'][sensitive + 1] as sensitive, ['low', 'medium', 'high'][level + 1] as level from w""",
)
_add(
    "str_10_drift",
    lambda spark, d: classify.drift(frame(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.upper(F.sha1(F.col("o_custkey").cast("string")))).alias("analyzed"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.sha1(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(0).cast("string"))).alias("deployed"))),
    "select o_orderkey as id, case when o_orderkey % 5 = 0 or o_orderkey % 7 = 0 then 'unknown' when o_orderkey % 2 = 0 or o_custkey = 0 then 'in-sync' else 'drift' end as status, case when o_orderkey % 5 = 0 then 'no-analyzed-sha' when o_orderkey % 7 = 0 then 'health-no-commit' when o_orderkey % 2 = 1 and o_custkey <> 0 then 'sha-mismatch' end as reason from orders",
)
_add(
    "gra_24_grounded_claims",
    _graph(lambda e, n: classify.grounded(e.select(F.col("seq"), F.col("dst").alias("anchor"), F.when(F.col("weight") == 2, " ").otherwise("claim").alias("text")).groupBy("seq", "anchor", "text").agg(F.count("*")).drop("count(1)").where("startswith(anchor, 'ENTITY')"), n.where("type = 'ENTITY' and sensitive").select(F.col("id").alias("anchor"))).groupBy("verdict").agg(F.count("*").alias("n"))),
    with_frames("nodes", "edges") + """, c as (select distinct seq, dst as anchor, weight = 2 as blank from edges where dst like 'ENTITY%'), k as (select seq, anchor, blank, anchor in (select id from nodes where type = 'ENTITY' and sensitive) as known from c),
f as (select anchor, min(seq) as s from k where known and not blank group by anchor) select case when blank then 'empty-text' when not known then 'off-map' when seq = s then 'kept' else 'repeated' end as verdict, count(*) as n from k left join f using (anchor) group by 1""",
)
_add("top_08_history", lambda spark, d: classify.recent_history(frame(spark, d, "runs").withColumn("status", F.expr("case run_id % 4 when 0 then 'running' when 1 then 'failed' else 'completed' end")), 20).select("run_id", "status"), having("runs") + " select run_id, case run_id % 4 when 1 then 'failed' else 'completed' end as status from runs where run_id % 4 <> 0 order by run_id desc limit 20")
_add(
    "ui_04_domain_evidence",
    _graph(lambda e, n: classify.domain_evidence(e, n.select("id", F.col("class_key").alias("domain")))),
    with_frames("nodes", "edges") + f""", em as (select *, {'{M}'} as m from edges), t as (select a.class_key as sd, b.class_key as dd, m from em left join nodes a on src = a.id left join nodes b on dst = b.id),
u as (select sd as domain, m from t where sd is not null union all select dd, m from t where dd is not null and dd is distinct from sd),
g as (select domain, count(*) as edges, arg_min(m, case m when 'RUNTIME_OBSERVED' then 5 when 'STATIC_PROVEN' then 4 when 'CONFIG_PROVEN' then 3 when 'STATIC_UNRESOLVED' then 2 else 1 end) as worst, count(*) filter (where m in ('RUNTIME_OBSERVED', 'STATIC_PROVEN', 'CONFIG_PROVEN')) as p from u group by domain),
s as (select class_key as domain, count(*) as size from nodes group by 1) select s.domain, size, coalesce(edges, 0) as edges, coalesce(worst, 'UNKNOWN') as worst, coalesce(round(p / edges, 6), -1.0) as proven_share from s left join g on s.domain = g.domain""".replace("{M}", GRAPH[GRAPH.index("em as (select *, ") + len("em as (select *, ") : GRAPH.index(" as m from ex")]),
)
_add(
    "ui_10_center",
    _graph(classify.center),
    GRAPH + ", d as (select id, type, runtime_hot, (select count(*) from ex where dst = id) as i, (select count(*) from ex where src = id) as o from nodes) select id, o * 2 + i + case when type in ('CONTROLLER', 'SERVICE', 'VIEW') then 100 else 0 end + case when runtime_hot then 60 else 0 end - case when o <= 1 and i >= 20 then 500 else 0 end as score from d order by score desc, id limit 1",
)
_add(
    "gra_10_mechanism",
    _graph(lambda e, n: walks.mechanism(e, _roots(n))),
    "with recursive " + with_frames("nodes", "edges")[5:] + """, f as (select src, dst, rel, arg_min(row(coalesce(observed, false)), seq) as p from edges where rel <> 'ASSOCIATES' group by src, dst, rel),
r(root, node, depth) as (select id, id, 0 from nodes where type = 'VIEW' union select root, dst, depth + 1 from r join f on node = src where depth < 5), l as (select root, node, min(depth) as depth from r group by all),
s as (select root, src, dst, rel, depth, row_number() over (partition by root order by depth, src, not p[1], dst, rel) as "order" from l join f on node = src) select root, "order", src, dst, rel, depth::bigint as depth from s where "order" <= 60""",
)


def _narrative(e: DataFrame, n: DataFrame) -> DataFrame:
    seeds = n.where("type = 'ENTITY' and sensitive").select("id")
    return walks.narrative(e.withColumn("refuted", F.expr("weight = 6")), n, seeds)


_add(
    "gra_22_narrative",
    _graph(_narrative),
    "with recursive " + GRAPH[5:] + """, r(node) as (select id from nodes where type = 'ENTITY' and sensitive union select src from r join (select distinct src, dst from ex) on dst = node),
w as (select src, dst, rel, seq, m, conf, case when weight = 6 and m <> 'RUNTIME_OBSERVED' then 'refuted' when m in ('RUNTIME_OBSERVED', 'STATIC_PROVEN') then 'walkable' end as verdict from ec where src in (select node from r) and dst in (select node from r))
select src, dst, rel, arg_min(verdict, seq) as verdict, arg_min(m, seq) as method, arg_min(conf, seq) as confidence from w where verdict is not null group by src, dst, rel""",
)
_add("gra_11_entry", _graph(lambda e, n: walks.resolve_entry(n, "controller:9")), with_frames("nodes") + " select min(id) as id from nodes where contains(lower(id), 'controller:9')")


def _ordered(s: DataFrame) -> DataFrame:
    steps = s.select(F.col("trace_id").alias("root"), F.col("span_id").alias("order"), F.coalesce(F.concat(F.lit("t_"), F.substring("table_name", 2, 9)), F.lit("-")).alias("label"), F.when(F.col("op") == "click", "CALLS").otherwise("READS_ENTITY").alias("rel"))
    touches = runtime.first_touch(s).select(F.col("trace_id").alias("root"), F.col("table_name").alias("table"), "rank")
    return walks.runtime_order(steps, touches)


_add(
    "gra_12_runtime_order",
    _spans(_ordered),
    SPANS + """, f as (select trace_id, table_name, min(row(start_ts, span_id)) as t from spans where table_name is not null group by all), k as (select trace_id, lower(table_name) as key, row_number() over (partition by trace_id order by t) - 1 as rank from f),
s as (select spans.trace_id as root, span_id as was, coalesce('t_' || table_name[2:], '-') as label, case when op = 'click' then 'CALLS' else 'READS_ENTITY' end as rel, case when op <> 'click' then rank end as rank from spans left join k on spans.trace_id = k.trace_id and lower(table_name) = key)
select root, row_number() over (partition by root order by rank nulls last, was) as "order", was, label, rel, rank from s""",
)
_add("join_06_endpoints", lambda spark, d: matching.match_endpoints(local(spark, d, "calls"), local(spark, d, "routes").select("seq", F.lit("GET").alias("method"), "path", F.concat(F.lit("Route"), F.col("seq")).alias("class_name"))))
_add(
    "join_08_routes",
    lambda spark, d: matching.match_routes(local(spark, d, "calls"), local(spark, d, "routes")),
    having("calls", "routes") + " select url_id, min(seq) as seq from calls join routes on regexp_full_match(string_split(url, '?')[1], replace(path, ':id', '[^/]+')) group by url_id",
)
_add(
    "join_09_gateway_prefix",
    lambda spark, d: matching.under_prefix(local(spark, d, "calls"), frame(spark, d, "nation").select(F.concat(F.lit("/gw/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))).alias("prefix")).unionByName(spark.createDataFrame([("/files",)], "prefix string"))),
    having("calls") + """, p as (select '/gw/' || lower(replace(n_name, ' ', '-')) as prefix from nation union all select '/files'), u as (select url_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/{2,}', '/', 'g') as url from calls)
select url_id, arg_max(prefix, length(prefix)) as prefix from u join p on url = prefix or starts_with(url, prefix || '/') group by url_id""",
)
_add(
    "join_10_endings",
    lambda spark, d: matching.share_ending(local(spark, d, "calls").select(F.col("url").alias("a")), frame(spark, d, "nation").select(F.concat(F.lit("/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))).alias("b"))),
    having("calls") + ", a as (select distinct url as a from calls), b as (select distinct '/' || lower(replace(n_name, ' ', '-')) as b from nation) select a, b from a join b on suffix(a, b) or suffix(b, a)",
)
def _decisions(spark: SparkSession, d: str) -> DataFrame:
    files = frame(spark, d, "catalog").select(F.concat(F.lit("src/"), F.initcap(F.get(F.split("endpoint", "/"), 3)), F.lit("Service.java")).alias("path"))
    records = frame(spark, d, "customer").groupBy((F.col("c_custkey") % 97).alias("id")).agg(F.collect_set(F.concat(F.initcap("c_mktsegment"), F.lit("s"))).alias("symbols"))
    return matching.decisions_for(files, records)


_add(
    "imp_08_decisions",
    _decisions,
    having("catalog") + """, f as (select distinct upper(string_split(endpoint, '/')[4][1]) || string_split(endpoint, '/')[4][2:] as s from catalog),
h as (select distinct c_custkey % 97 as id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || 's' as n from customer)
select id, count(*) as score, string_agg(n, ',' order by n) as matched from h where n in (select s from f where regexp_matches(s, '^[A-Z][a-z]{3,}$')) group by id order by score desc, id limit 5""",
)
_add("ext_24_dominant_suffixes", _entries(lambda e: extract.dominant_suffixes(e.select(F.concat("controller", F.lit("/"), "entry_id", F.lit(".java")).alias("path"), F.concat(F.initcap("operation"), F.lit("RestController")).alias("name")))))
