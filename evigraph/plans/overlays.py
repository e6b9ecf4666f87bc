"""Queries over overlays, evidence reports and catalogs of rules, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.operators import domains, evidence, fixpoint, models, overlays, runtime
from evigraph.operators import catalog as cat
from evigraph.plans.adapters import FRAMES, frame, with_frames
from evigraph.plans.queries import CENSUS, GRAPH, LISTS, REC, SPANS, _add, _entries, _graph, _spans
from evigraph.plans.scalars import made

#: Frames of this module, as SQL for both engines.
LOCAL = {
    "onodes": """
select 'ROUTE:' || event_type as id, lpad(cast(min(event_id) as varchar(20)), 12, '0') as seq, 'ROUTE' as type, case when min(event_id) % 2 = 0 then 'GET' else '' end as http_method, '/' || event_type || '/:id' as full_path, cast(null as varchar(9)) as table_name, '' as source_file, cast(null as varchar(9)) as fqn from events where event_type <> 'click' group by event_type
union all select 'ENTITY:' || cast(p_size as varchar(20)), lpad(cast(min(p_partkey) as varchar(20)), 12, '0'), 'ENTITY', '', cast(null as varchar(9)), 'T' || cast(p_size % 12 as varchar(20)), '', 'shop.data.E' || cast(p_size as varchar(20)) from part where p_size <= 24 group by p_size
union all select 'SERVICE:shop.op' || chr(cast(97 + s_nationkey as int)) || '.v1.Run', lpad(cast(min(s_suppkey) as varchar(20)), 12, '0'), 'SERVICE', '', cast(null as varchar(9)), cast(null as varchar(9)), 'src/s' || cast(s_nationkey as varchar(20)) || '.ts', 'shop.svc.S' || cast(s_nationkey as varchar(20)) from supplier group by s_nationkey
union all select 'wsv1:/app/op' || chr(cast(97 + n_nationkey as int)) || '.v2', lpad(cast(n_nationkey as varchar(20)), 12, '0'), 'CONTROLLER', 'POST', '/app/op' || chr(cast(97 + n_nationkey as int)) || '.v2', cast(null as varchar(9)), '', cast(null as varchar(9)) from nation""",
    "opairs": """
select min(event_id) as pair, case when user_id % 2 = 0 then 'GET' else 'POST' end as method, '/' || event_type || '/' || cast(user_id % 20 as varchar(20)) as path, count(*) as count, max(ts) as last_seen from events group by case when user_id % 2 = 0 then 'GET' else 'POST' end, '/' || event_type || '/' || cast(user_id % 20 as varchar(20))""",
    "otables": """
select pair, 'T' || cast(event_id % 17 as varchar(20)) as "table", min(case when event_id % 3 = 0 then 'SELECT' else 'UPDATE' end) as op from events join opairs on method = case when user_id % 2 = 0 then 'GET' else 'POST' end and path = '/' || event_type || '/' || cast(user_id % 20 as varchar(20)) where event_id % 4 <> 0 group by pair, event_id % 17""",
    "ojava": """
select distinct pair, case when user_id % 3 = 0 then '/app/op' || chr(cast(97 + event_id % 30 as int)) || '.v2' else '/app/op' || chr(cast(97 + event_id % 30 as int)) || '.v1/x' end as endpoint from events join opairs on method = case when user_id % 2 = 0 then 'GET' else 'POST' end and path = '/' || event_type || '/' || cast(user_id % 20 as varchar(20)) where event_id % 19 = 0""",
    "oedges": """
select 'SERVICE:shop.op' || chr(cast(97 + s_nationkey as int)) || '.v1.Run' as src, 'ENTITY:' || cast(s_suppkey % 24 + 1 as varchar(20)) as dst, case when s_suppkey % 2 = 0 then 'READS_ENTITY' else 'DI_RESOLVES' end as rel, lpad(cast(s_suppkey as varchar(20)), 12, '0') as seq,
  case s_suppkey % 3 when 0 then 'compiler' when 1 then 'convention-name' end as resolution from supplier""",
    "oaccess": """
select l_orderkey * 10 + l_linenumber as seq, 'src/s' || cast(l_suppkey % 30 as varchar(20)) || '.ts' as from_file, 'T' || cast(l_partkey % 15 as varchar(20)) as "table", case l_linenumber % 3 when 0 then 'write' when 1 then 'read' else 'scan' end as access from lineitem where l_orderkey % 7 = 0""",
    "oderived": """
select o_orderkey as seq, 'shop.svc.S' || cast(o_custkey % 30 as varchar(20)) as from_fqn, case o_orderkey % 4 when 0 then 'shop.data.E' || cast(o_orderkey % 26 + 1 as varchar(20)) when 1 then 'shop.port.P' || cast(o_orderkey % 9 as varchar(20)) when 2 then 'other.lib.L' else 'shop.svc.S' || cast(o_custkey % 30 as varchar(20)) end as to_fqn,
  case when o_orderkey % 10 = 0 then 'guess' else 'config' end as resolution, 'r' || cast(o_orderkey % 5 as varchar(20)) as reason from orders""",
}


def local(spark: SparkSession, d: str, name: str) -> DataFrame:
    sql = LOCAL[name].replace("join opairs on", f"join ({LOCAL['opairs']}) as op on")
    return made(spark, d, sql.replace('"table"', "`table`"))


def having(*names: str) -> str:
    return "with " + ",\n".join(f"{n} as ({LOCAL.get(n) or FRAMES[n]})" for n in names)


ROUTED = """,
et as (select table_name as "table", arg_max(id, seq) as id from onodes where type = 'ENTITY' and table_name is not null group by 1),
hit as (select pair, min(seq) as seq from opairs join (select * from onodes where type = 'ROUTE') r on (r.http_method = '' or r.http_method = method) and regexp_full_match(path, replace(r.full_path, ':id', '[^/]+')) group by pair),
ro as (select p.pair, coalesce(r.id, 'route:runtime:' || method || ':' || path) as route, r.id is null as minted from opairs p left join hit on p.pair = hit.pair left join onodes r on hit.seq = r.seq and r.type = 'ROUTE'),
tt as (select pair, coalesce(id, 'table:' || t."table") as dst, op from otables t left join et on t."table" = et."table"),
dp as (select regexp_extract(id, '\\.([a-z][A-Za-z0-9]*\\.v\\d+)\\.', 1) as o, arg_min(id, seq) as b from onodes where type = 'SERVICE' group by 1),
jt as (select pair, coalesce(w.id, b) as dst from ojava left join onodes w on w.id like 'wsv1:%' and w.full_path = endpoint left join dp on regexp_extract(endpoint, '/([a-z][A-Za-z0-9]*\\.v\\d+)(/|$)', 1) = o where coalesce(w.id, b) is not null),
ol as (select pair, min(dst) as src from jt group by pair having count(*) = 1),
sp as (select ro.pair, 1 as step, route as src, dst, 'entity' as kind, op as operation from ro join tt on ro.pair = tt.pair union all select ro.pair, 2, route, dst, 'java', null from ro join jt on ro.pair = jt.pair union all select ol.pair, 3, src, dst, 'service-entity', op from ol join tt on ol.pair = tt.pair),
re as (select * from (select *, row_number() over (partition by src, dst order by pair, step, kind, operation) as rn from sp where src <> dst) where rn = 1)"""
PAIRS = having("onodes", "opairs", "otables", "ojava") + ROUTED


def _routed(spark: SparkSession, d: str) -> DataFrame:
    return overlays.route_overlay(*(local(spark, d, n) for n in ("opairs", "otables", "ojava", "onodes")))


_add("str_04_route_overlay", _routed, PAIRS + ' select src, dst, kind, operation, count from re join opairs on re.pair = opairs.pair')
_add("str_04_routes", lambda spark, d: overlays.resolve_routes(local(spark, d, "opairs"), local(spark, d, "onodes")), PAIRS + " select pair, route, minted from ro")
_add("str_04_hot_marks", lambda spark, d: overlays.hot_marks(local(spark, d, "opairs"), local(spark, d, "otables"), local(spark, d, "onodes")), PAIRS + " select id, sum(count)::bigint as hits from (select pair, route as id from ro union all select pair, dst from tt) as m join opairs on m.pair = opairs.pair group by id")
_HITS = "select 'T' || cast(event_id % 17 as varchar(20)) as \"table\", min(case when event_id % 3 = 0 then 'gateway' else 'backend' end) as service, min(event_type) as op, count(*) as count from events where event_id % 4 <> 0 group by event_id % 17"
_TABLED = f""", ht as ({_HITS}), te as (select 'runtime:db:' || service as src, coalesce(id, 'table:' || ht."table") as dst, op as operation, count, id is null as minted from ht left join et on ht."table" = et."table")"""


def _tabled(spark: SparkSession, d: str) -> DataFrame:
    return overlays.table_overlay(made(spark, d, _HITS.replace('"', "`")), local(spark, d, "onodes"))


_add("str_05_table_overlay", _tabled, PAIRS + _TABLED + " select * from te")
_CARRY = _spans(lambda s: runtime.carry_forward(runtime.table_hits(s.where("span_id % 17 < 12")), runtime.table_hits(s.where("span_id % 17 > 8"))))
_add(
    "str_06_overlay_summary",
    lambda spark, d: overlays.overlay_summary(local(spark, d, "opairs"), _routed(spark, d), _tabled(spark, d), _CARRY(spark, d)),
    PAIRS + _TABLED + f""", th as (select 'T' || event_id % 17 as t, event_id % 17 as g, ts from events where event_id % 4 <> 0), ca as (select t, max(ts) as l from th where g < 12 group by t), cb as (select t, max(ts) as l from th where g > 8 group by t)
select count(*) as route_pairs, sum(count)::bigint as traces, (select count(*) from re where kind = 'entity') as route_entity_edges, (select count(*) from re where kind = 'java') as route_java_edges, (select count(*) from re where kind = 'service-entity') as service_entity_edges,
  (select count(*) from te) as tables_observed, (select count(*) from te where not minted) as entities_resolved, (select count(*) from te where minted) as tables_minted,
  (select count(*) from ca where t not in (select t from cb) and l >= (select max(l) from cb) - interval 7 day) as carried_forward from opairs""",
)
_PROJECTS = "select c_custkey as id, case when c_custkey % 3 = 0 then ' http://traces ' else '' end as url, case when c_custkey % 4 = 0 then 'shop, pay' when c_custkey % 4 = 1 then ' , ' end as services, case when c_custkey % 5 = 0 then 'edge' end as gateway, case when c_custkey % 2 = 0 then cast(3600000 as bigint) end as lookback_ms, cast(null as bigint) as max_traces from customer"
_ENV = {"services": "common", "url": None, "lookback_ms": None, "limit": "50"}
_add(
    "str_07_overlay_config",
    lambda spark, d: overlays.overlay_config(made(spark, d, _PROJECTS), _ENV),
    f"with p as ({_PROJECTS}) select id, id % 3 = 0 as enabled, case when id % 3 = 0 then 'http://traces' end as url, case when id % 3 = 0 then case when id % 5 = 0 then 'edge,' else '' end || case when id % 4 = 0 then 'shop,pay' else 'common' end end as roots, case when id % 3 = 0 then coalesce(lookback_ms, 86400000) end as lookback_ms, case when id % 3 = 0 then 50::bigint end as max_traces from p",
)
_RUNS = "select run_id, case run_id % 4 when 0 then 'running' when 1 then 'failed' else 'completed' end as status, case when run_id % 6 = 2 then null when run_id % 7 = 3 then 0 else edges end as total, observed, holes as proven, case when run_id % 8 = 1 then 'out-of-memory' end as reason from ({}) as r"
_add(
    "str_09_evidence_history",
    lambda spark, d: overlays.evidence_history(made(spark, d, _RUNS.format(FRAMES["runs"])), 25),
    f"""with r as ({_RUNS.format(FRAMES['runs'])}), e as (select *, case when status = 'failed' then coalesce(reason, 'run-failed') when total is null then 'no-census' when total = 0 then 'no-edges' end as hole from r where status <> 'running' order by run_id desc limit 25)
select run_id, hole is null as valid, hole as reason, case when hole is null then total end as total, case when hole is null then round(observed / total, 4) end as observed_ratio, case when hole is null then round(proven / total, 4) end as proven_ratio from e""",
)
_AXES = "select o_orderkey as id, o_orderkey % 3 = 0 as static_stale, case when o_orderkey % 5 = 0 then 'absent' else 'fresh' end as static_status, case when o_orderkey % 2 = 0 then cast(o_orderkey % 200 as double) end as static_hours, o_orderkey % 4 = 0 as config_stale, cast(o_orderkey % 90 as double) as config_hours, o_orderkey % 6 % 5 as proven, o_orderkey % 7 as config_proven, o_orderkey % 2 as unresolved from orders"
_add(
    "str_11_proof_caveats",
    lambda spark, d: overlays.proof_caveats(made(spark, d, _AXES)),
    f"""with a as ({_AXES}) select id, 'static-stale' as caveat, greatest(1, floor(static_hours / 24 + 0.5)::bigint) + (static_hours - static_hours)::bigint as days, proven as edges from a where static_stale and proven > 0
union all select id, 'static-absent', null, unresolved from a where not (static_stale and proven > 0) and static_status = 'absent' and proven = 0 and unresolved > 0 union all select id, 'config-stale', greatest(1, floor(config_hours / 24 + 0.5)::bigint), config_proven from a where config_stale and config_proven > 0""",
)
_TARGETS = "select distinct case user_id % 3 when 0 then '/' || event_type || '/' || cast(user_id % 20 as varchar(20)) when 1 then '/' || cast(user_id % 20 as varchar(20)) || '/' else '/gw/' || event_type || '/' || cast(user_id % 20 as varchar(20)) end as target from events"


def _for_route(spark: SparkSession, d: str) -> DataFrame:
    s = frame(spark, d, "spans")
    pairs = s.groupBy(F.col("route").alias("path")).agg(F.min("span_id").alias("seq"), F.array_sort(F.collect_set("trace_id")).alias("ids")).select("path", "seq", F.slice("ids", 1, 5).alias("trace_ids"))
    return overlays.order_for_route(pairs, runtime.first_touch(s).withColumnRenamed("table_name", "table"), made(spark, d, _TARGETS))


_add(
    "str_12_route_order",
    _for_route,
    SPANS + f""", pr as (select route as path, min(span_id) as seq, list_sort(list(distinct trace_id))[:5] as ids from spans group by route), tg as ({_TARGETS}), tn as (select target, rtrim(target, '/') as t from tg),
bs as (select target, arg_min(ids, row(path <> t, seq)) as ids from tn join pr on suffix(path, t) or suffix(t, path) group by target), tr as (select distinct target, unnest(ids) as trace_id from bs),
f as (select trace_id, table_name, min(row(start_ts, span_id)) as t from spans where table_name is not null group by all), k as (select trace_id, table_name, row_number() over (partition by trace_id order by t) - 1 as rank from f)
select target, table_name as "table", min(rank) as rank from tr join k on tr.trace_id = k.trace_id group by all""",
)

ACCESS = having("onodes", "oedges", "oaccess") + """,
et as (select table_name as "table", arg_max(id, seq) as id from onodes where type = 'ENTITY' and table_name is not null group by 1), fi as (select source_file, arg_min(id, seq) as src from onodes where source_file <> '' group by 1),
pf as (select distinct src, coalesce(id, 'table:' || a."table") as dst, case when access = 'write' then 'WRITES_ENTITY' else 'READS_ENTITY' end as rel from oaccess a join fi on a.from_file = fi.source_file left join et on a."table" = et."table" where access in ('read', 'write')),
hv as (select distinct src, dst, rel from oedges), da as (select coalesce(h.src, p.src) as src, coalesce(h.dst, p.dst) as dst, coalesce(h.rel, p.rel) as rel, case when p.src is null then 'kept' when h.src is not null then 'upgraded' else 'added' end as origin from hv h full outer join pf p on h.src = p.src and h.dst = p.dst and h.rel = p.rel)"""  # fmt: skip
_add("gra_19_data_access", lambda spark, d: overlays.merge_data_access(local(spark, d, "oedges"), local(spark, d, "onodes"), local(spark, d, "oaccess")), ACCESS + " select * from da")
CONFIG = """,
ix as (select fqn, arg_min(id, seq) as id from onodes where fqn is not null group by fqn), rs as (select seq, reason, coalesce(a.id, case when from_fqn like 'shop.%' then 'INTERFACE:' || from_fqn end) as s, coalesce(b.id, case when to_fqn like 'shop.%' then 'INTERFACE:' || to_fqn end) as t, a.id is null as ms, b.id is null as mt
  from oderived left join ix a on from_fqn = a.fqn left join ix b on to_fqn = b.fqn where resolution = 'config'),
cf as (select s as src, t as dst, arg_min(reason, seq) as reason, arg_min(ms, seq) as minted_src, arg_min(mt, seq) as minted_dst from rs where s is not null and t is not null and s <> t group by s, t)"""
_add("gra_20_config_edges", lambda spark, d: overlays.config_edges(local(spark, d, "onodes"), local(spark, d, "oderived"), ["shop"]), having("onodes", "oderived") + CONFIG + " select * from cf")
MERGED = """,
cm as (select src, dst, case when exists (select 1 from {e} e where e.src = cf.src and e.dst = cf.dst and e.resolution in ('compiler', 'interface-impl')) then 'superseded' when exists (select 1 from {e} e where e.src = cf.src and e.dst = cf.dst and e.rel = 'DI_RESOLVES') then 'upgraded' else 'added' end as origin from cf)"""
_add("gra_20_config_overlay", lambda spark, d: overlays.merge_config(local(spark, d, "oedges"), overlays.config_edges(local(spark, d, "onodes"), local(spark, d, "oderived"), ["shop"])), having("onodes", "oedges", "oderived") + CONFIG + MERGED.format(e="oedges") + " select * from cm")
_add(
    "gra_21_all_overlays",
    lambda spark, d: overlays.with_overlays(local(spark, d, "oedges"), local(spark, d, "onodes"), None, local(spark, d, "oaccess"), local(spark, d, "oderived"), ["shop"]),
    ACCESS + f", oderived as ({LOCAL['oderived']})" + """, fr as (select src, dst, rel, arg_min(coalesce(resolution, ''), seq) as resolution from oedges group by all),
o2 as (select da.src, da.dst, da.rel, case when origin = 'kept' then nullif(resolution, '') else 'compiler' end as resolution from da left join fr on da.src = fr.src and da.dst = fr.dst and da.rel = fr.rel)""" + CONFIG + MERGED.format(e="o2") + """,
cc as (select src, dst, 'DI_RESOLVES' as rel, 'config' as proof from cm where origin <> 'superseded')
select coalesce(o2.src, cc.src) as src, coalesce(o2.dst, cc.dst) as dst, coalesce(o2.rel, cc.rel) as rel, coalesce(proof, resolution) as resolution from o2 full outer join cc on o2.src = cc.src and o2.dst = cc.dst and o2.rel = cc.rel""",
)




_FUNCTIONS = "select p_partkey as seq, 'f' || cast(p_size as varchar(20)) as file, case p_partkey % 4 when 0 then 'default' when 1 then 'C.h' || cast(p_partkey % 6 as varchar(20)) else 'h' || cast(p_partkey % 6 as varchar(20)) end as name, case when p_partkey % 5 < 2 then 'call' || cast(p_partkey as varchar(20)) end as capability from part"
_UNIQUE = f"select file, name, min(seq) as seq, max(capability) as capability from ({_FUNCTIONS}) as f group by file, name"
_ASKS = "select o_orderkey as ask, 'f' || cast(o_orderkey % 50 as varchar(20)) as file, 'h' || cast(o_custkey % 6 as varchar(20)) as handler from orders"
_BOUND = "select distinct 'f' || cast(o_orderkey % 50 as varchar(20)) as file, 'h' || cast(o_custkey % 6 as varchar(20)) as handler, 'f' || cast((o_orderkey % 50 * 7 + o_custkey % 6) % 55 as varchar(20)) as source, 'h' || cast((o_custkey % 6 + 2) % 6 as varchar(20)) as original from orders where o_custkey % 6 <> 1"
_CALLED = "select distinct 'f' || cast(p_size as varchar(20)) as src_file, 'h' || cast(p_partkey % 6 as varchar(20)) as src_name, 'f' || cast((p_size * 3 + 1) % 50 as varchar(20)) as dst_file, 'h' || cast((p_partkey + 1) % 6 as varchar(20)) as dst_name from part"
_add(
    "gra_28_capability_lookup",
    lambda spark, d: overlays.capability_lookup(*(made(spark, d, q) for q in (_ASKS, _UNIQUE, _CALLED, _BOUND))),
    f"""with recursive a as ({_ASKS}), f as ({_UNIQUE}), c as ({_CALLED}), b as ({_BOUND}), h as (select * from f where capability is not null),
ab as (select ask, a.handler, source, original from a join b on a.file = b.file and a.handler = b.handler),
w(ask, file, name, d) as (select ask, a.file, a.handler, 0 from a join f on a.file = f.file and a.handler = f.name where capability is null union select ask, dst_file, dst_name, d + 1 from w join c on w.file = src_file and w.name = src_name where d < 5),
t as (select ask, 1 as tier, seq, capability from a join h on a.file = h.file and a.handler = h.name union all select ask, 2, seq, capability from ab join h on source = h.file and original = h.name
  union all select ask, 3, d::bigint * 1000000000 + seq, capability from w join h on w.file = h.file and w.name = h.name where d > 0 union all select ask, 4, seq, capability from ab join h on source = h.file and h.name in (ab.handler, 'default')
  union all select ask, 5, seq, capability from a join h on a.file = h.file and suffix(h.name, '.' || a.handler))
select ask, tier, capability from (select *, row_number() over (partition by ask order by tier, seq, capability) as rn from t) where rn = 1""",
)
_FACTS = "select metric, canonical from ({}) unpivot (canonical for metric in (total, runtime_observed, static_proven))"


def _claims(e: DataFrame, n: DataFrame) -> DataFrame:
    facts = evidence.census(e, n).select("total", "runtime_observed", "static_proven").unpivot([], ["total", "runtime_observed", "static_proven"], "metric", "canonical")
    claims = n.where("type = 'SERVICE'").select(F.col("hits").alias("id"), F.when(F.col("hits") % 3 == 0, "total").when(F.col("hits") % 3 == 1, "static_proven").otherwise("nothing.known").alias("metric"), F.when(F.col("hits") % 6 == 0, facts.where("metric = 'total'").agg(F.max("canonical")).scalar()).otherwise(F.col("hits")).cast("long").alias("value"))
    return overlays.check_claims(claims, facts)


_add(
    "agg_17_claims",
    _graph(_claims),
    CENSUS + f""", fa as (select 'total' as metric, total as canonical from c union all select 'runtime_observed', runtime_observed from c union all select 'static_proven', static_proven from c),
cl as (select hits as id, case hits % 3 when 0 then 'total' when 1 then 'static_proven' else 'nothing.known' end as metric, case when hits % 6 = 0 then (select total from c) else hits end as value from nodes where type = 'SERVICE')
select id, cl.metric, value as claimed, canonical, coalesce(value = canonical, false) as matches, value - canonical as delta from cl left join fa on cl.metric = fa.metric""",
)
CALIBRATED = GRAPH + """, sn as (select distinct src, dst from em where m = 'RUNTIME_OBSERVED'), sx as (select *, src in (select src from sn) as s, split_part(dst, ':', 1) in (select split_part(dst, ':', 1) from sn) as t, exists (select 1 from sn where sn.src = em.src and sn.dst = em.dst) as c from em where m <> 'RUNTIME_OBSERVED'),
cg as (select m as method, count(*) filter (where s and t) as confirmable, count(*) filter (where s and t and c) as confirmed from sx group by m),
ck as (select *, case when (select count(*) from sn) = 0 then 'no-ground-truth' when (select count(*) from sx where s) = 0 then 'incomparable' when confirmable = 0 then 'out-of-reach' when confirmable < 30 then 'few-samples' else 'calibrated' end as status from cg),
cb as (select method, confirmable, confirmed, case when status = 'calibrated' then round(confirmed / confirmable, 4) end as reliability, status from ck)"""  # fmt: skip
_calibrated = lambda e, n: overlays.calibration(evidence.edge_evidence(evidence.existing_edges(e, n)))
_add("agg_25_calibration", _graph(_calibrated), CALIBRATED + " select * from cb")
_add("agg_26_effective_confidence", _graph(lambda e, n: overlays.effective_confidence(_calibrated(e, n), evidence.CONFIDENCE)), CALIBRATED + " select method, coalesce(reliability, case method when 'STATIC_PROVEN' then 0.8::double when 'CONFIG_PROVEN' then 0.78::double when 'STATIC_UNRESOLVED' then 0.4::double else 0.2::double end) as confidence, case when reliability is not null then 'calibrated' else 'fixed' end as source from cb")
_CONCEPTS = {"ordering": ("order|invoice", 3), "autos": ("automobile", 2), "homes": ("household|furniture", 1)}
_add(
    "agg_28_functional_boxes",
    _entries(lambda e: overlays.functional_boxes(e.select("endpoint", text.tokenized(F.concat_ws(" ", "operation", "endpoint")).alias("names")), _CONCEPTS)),
    LISTS + ", n as (select endpoint, lower(operation || ' ' || endpoint) as t from c), x as (" + " union all ".join(f"select endpoint, '{k}' as concept, {v} as importance from n where regexp_matches(t, '{p}')" for k, (p, v) in _CONCEPTS.items()) + " union all select endpoint, 'unmapped', 0 from n where not regexp_matches(t, '" + "|".join(p for p, _ in _CONCEPTS.values()) + "')) select concept, importance::bigint as importance, count(distinct endpoint) as endpoints, min(endpoint) as anchor from x group by concept, importance",
)
_CLASSES = lambda e, n: (evidence.class_edges(e, n), n.select(F.col("class_key").alias("id")).distinct())
_add(
    "agg_31_class_diagram",
    _graph(lambda e, n: overlays.class_diagram(*_CLASSES(e, n))),
    GRAPH + """, ce as (select distinct a.class_key as s, b.class_key as d, rel from em join nodes a on src = a.id join nodes b on dst = b.id where a.class_key <> b.class_key), dg as (select k, count(*) as n from (select s as k from ce union all select d from ce) group by k), tp as (select k from dg order by n desc, k limit 28)
select s as src, d as dst, count(*) as edges from ce where s in (select k from tp) and d in (select k from tp) group by s, d""",
)
_add("agg_31_use_cases", _entries(lambda e: overlays.use_case_domains(e.select(text.route_domain(F.col("endpoint"), F.lit("")).alias("domain"), "endpoint"))), LISTS + " select string_split(endpoint, '/')[4] as domain, count(distinct endpoint) as endpoints from c group by 1 order by endpoints desc, domain limit 8")
_add("gra_15_communities", _graph(lambda e, n: domains.detect(*_CLASSES(e, n)).select("id", "domain")), None)
_add("ui_03_insights", _graph(overlays.insights), GRAPH + " select (select count(*) from nodes) as nodes, (select count(*) filter (where runtime_hot) from nodes) as hot, (select count(distinct type) from nodes) as types, count(*) as edges, count(*) filter (where m in ('UNKNOWN', 'STATIC_UNRESOLVED')) as blind, count(*) filter (where m = 'RUNTIME_OBSERVED') as observed, round(count(*) filter (where m in ('UNKNOWN', 'STATIC_UNRESOLVED')) / count(*), 4) as blind_share from em")
_add("ui_03_hottest_edges", _graph(overlays.hottest_edges), GRAPH + " select src, dst, rel, sum(weight)::bigint as count from ex where observed group by src, dst, rel order by count desc, src, dst, rel limit 10")
_add(
    "ui_05_seams",
    _graph(lambda e, n: overlays.seams(e, n.select("id", F.col("class_key").alias("domain")))),
    with_frames("nodes", "edges") + ", em as (select *, " + GRAPH.split("em as (select *, ")[1].split(" as m from ex")[0] + " as m from edges) select a.class_key as from_domain, b.class_key as to_domain, m as method, count(*) as edges from em join nodes a on src = a.id join nodes b on dst = b.id where a.class_key <> b.class_key group by all",
)


def _alarms(spark: SparkSession, d: str) -> DataFrame:
    axes = models.health(frame(spark, d, "spans"), 1, 4).select(F.concat("service", F.lit("/"), "op").alias("axis"), "state")
    e = frame(spark, d, "edges")
    before, after = (e.where(w).groupBy("src").agg(F.count("*").alias(n)) for w, n in (("weight <= 3", "b"), ("weight >= 3", "a")))
    coupling = before.join(after, "src").select("src", F.floor((F.col("a") - F.col("b")) * 100 / F.col("b") + 0.5).alias("pct"))
    runs = frame(spark, d, "runs").select((F.col("run_id") % 4).alias("grp"), "run_id", (F.col("observed") % 7 - 4).alias("points"))
    return overlays.alarms(axes, coupling, runs)


_add(
    "ui_07_alarms",
    _alarms,
    SPANS + f""", edges as ({FRAMES['edges']}), runs as ({FRAMES['runs']}), s as (select service || '/' || op as axis, floor((floor(epoch((select max(start_ts) from spans))) - floor(epoch(max(start_ts)))) / 3600)::bigint as h from spans group by service, op),
b as (select src, count(*) as b from edges where weight <= 3 group by src), a as (select src, count(*) as a from edges where weight >= 3 group by src), p as (select a.src, floor((a - b) * 100 / b + 0.5) as pct from a join b on a.src = b.src)
select 'health' as kind, axis as subject, case when h > 4 then 'high' else 'medium' end as level from s where h > 1 union all select 'coupling', src, case when pct >= 100 then 'high' else 'medium' end from p where pct >= 25 union all select 'ratio', run_id % 4 || '/' || run_id, 'high' from runs where observed % 7 - 4 <= -3""",
)


def _sankey(e: DataFrame) -> DataFrame:
    units = e.select(F.when(F.size("roles") == 0, "open").otherwise("role").alias("guard"), F.col("controller").alias("permission"), F.coalesce(F.get("entities", 0), F.lit("-")).alias("entity"))
    return overlays.sankey(units.groupBy("guard", "permission", "entity").agg(F.count("*").alias("n")), {"guard": 7, "permission": 9, "entity": 3})


_add(
    "ui_09_sankey",
    _entries(_sankey),
    LISTS + """, u as (select case when not p then 'open' else 'role' end as guard, controller as permission, coalesce(entities[1], '-') as entity, count(*) as n from c group by all), tp as (select permission from u group by permission order by sum(n) desc, permission limit 9), te as (select entity from u group by entity order by sum(n) desc, entity limit 3)
select guard, case when permission in (select permission from tp) then permission else 'others' end as permission, case when entity in (select entity from te) then entity else 'others' end as entity, sum(n)::bigint as n from u group by 1, 2, 3""",
)
_add("ui_11_recency", _spans(lambda s: s.groupBy("table_name").agg(F.max(F.when(F.col("span_id") % 17 < 12, F.unix_millis(F.col("start_ts").cast("timestamp")))).alias("last")).select("table_name", overlays.recency(F.col("last"), F.lit(1_705_276_800_000)).alias("state"))), SPANS + ", l as (select table_name, max(case when span_id % 17 < 12 then epoch_ms(start_ts) end) as last from spans group by table_name) select table_name, case when last is null then 'never' when 1705276800000 - last <= 86400000 then 'fresh' else 'stale' end as state from l")
_add("prj_04_node_evidence", _graph(lambda e, n: evidence.node_evidence(n).select("id", "method", "confidence")), with_frames("nodes") + " select id, case when runtime_hot then 'RUNTIME_OBSERVED' else 'STATIC_PROVEN' end as method, case when runtime_hot then 0.95::double else 0.8::double end as confidence from nodes")
