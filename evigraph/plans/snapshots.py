"""Queries over one snapshot or two: dead code, blind impact, fact sheet, drift, impact of a change, readiness, risk; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import evidence, snapshots
from evigraph.plans.adapters import frame, with_frames
from evigraph.plans.queries import GRAPH, _add, _graph
from evigraph.plans.scalars import made

_V = "varchar(20)"
DEAD_NODES = f"""select 'N:' || cast(p_partkey as {_V}) as id, case p_size % 6 when 0 then 'ENTITY' when 1 then 'CONTROLLER' when 2 then 'REPOSITORY' else 'SERVICE' end as type, case when p_partkey % 11 = 0 then 'scheduled' end as entry_point,
  p_partkey % 13 = 0 as observed, 'f' || cast(p_partkey % 200 as {_V}) as source_file from part"""
DEAD_EDGES = f"""select 'N:' || cast(l_partkey - l_partkey % 4 as {_V}) as src, 'N:' || cast(l_suppkey * 3 as {_V}) || case when l_suppkey % 5 = 0 then '::run' else '' end as dst,
  case when l_suppkey % 4 = 0 then 'REFUTED_LIKELY_DEAD' when l_suppkey % 4 = 1 and l_linenumber = 1 then 'REFUTED_UNREACHABLE_BY_ROBOT' end as refuted from lineitem"""
_IMPORTED, _CONFIGURED = (f"select distinct 'f' || cast(p_partkey % 200 as {_V}) as file from part where p_partkey % 10 = {k}" for k in (3, 7))
LIVENESS = f"""with n as ({DEAD_NODES}), e as ({DEAD_EDGES}), i as (select dst as id, count(*) as n_in, count(*) filter (where refuted = 'REFUTED_LIKELY_DEAD') as n_dead, count(*) filter (where refuted = 'REFUTED_UNREACHABLE_BY_ROBOT') as n_robot from e group by dst),
j as (select n.*, coalesce(n_in, 0) as n_in, n_dead, coalesce(n_robot, 0) as n_robot, coalesce(n_in, 0) > 0 or n.id in (select split_part(dst, '::', 1) from e where contains(dst, '::')) as called, n.id in (select src from e) as calls,
  source_file in ({_IMPORTED}) as imp, source_file in ({_CONFIGURED}) as conf from n left join i on n.id = i.id),
v as (select id, type, case when type = 'ENTITY' then null when observed then case when n_in = 0 and entry_point is null then 'runtime-observed' end when type = 'CONTROLLER' then case when n_in = 0 then 'entry-surface' end
  when not called and imp then 'import-reachable' when not called and (conf or entry_point is not null) then 'entry-point' when not called and calls then 'no-proven-caller' when not called then 'isolated'
  when n_robot > 0 then 'unreachable-by-robot' when n_in > 0 and n_dead = n_in then 'runtime-refuted' end as verdict from j)"""
DEAD = LIVENESS + ", d as (select id, type, verdict as tier, case verdict when 'isolated' then 0.75::double when 'runtime-refuted' then 0.7::double else 0.4::double end as confidence from v where verdict in ('isolated', 'runtime-refuted', 'no-proven-caller'))"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.liveness(*(made(spark, d, q) for q in (DEAD_EDGES, DEAD_NODES, _IMPORTED, _CONFIGURED)))


def _exclusions(spark: SparkSession, d: str) -> DataFrame:
    told = Observation()
    snapshots.dead_code(_judged(spark, d), told).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(list(told.get.items()), "reason string, n long")


_add("gra_13_liveness", _judged, LIVENESS + " select * from v")
_add("gra_13_dead_code", lambda spark, d: snapshots.dead_code(_judged(spark, d)), DEAD + " select * from d")
_add("gra_13_exclusions", _exclusions, LIVENESS + f" select reason, count(v.id) as n from (select unnest({list(snapshots.EXCLUSIONS)}) as reason) left join v on verdict = reason group by reason")
_add("top_05_dead_code", lambda spark, d: snapshots.dead_code(_judged(spark, d)).orderBy(F.desc("confidence"), "id").limit(20).select("id", "confidence"), DEAD + " select id, confidence from d order by confidence desc, id limit 20")

HOT_NODES = f"""select case when p_size % 10 = 0 then 'table:t' || cast(p_partkey as {_V}) else 'E:' || cast(p_partkey as {_V}) end as id, case when p_size % 3 = 0 then 'SERVICE' else 'ENTITY' end as type, 'C' || cast(p_size as {_V}) as class_name,
  case when p_size % 7 = 0 then 'flyway_schema_history' when p_size % 5 = 1 then 'tab' || cast(p_partkey as {_V}) when p_size % 5 = 2 then '' end as table_name, p_size % 4 = 0 as observed, p_size % 2 = 0 as synthetic, p_size % 7 = 0 or p_size % 8 = 0 as runtime_only, p_size % 9 as hits from part"""
HOT_EDGES = f"select 'E:' || cast(l_partkey as {_V}) as dst, l_linenumber = 5 as observed from lineitem where l_suppkey % 10 = 0"
HOT = f"""with n as ({HOT_NODES}), e as ({HOT_EDGES}), b as (select dst, bool_or(observed) as h, bool_or(not observed) as s from e group by dst),
x as (select id, case when starts_with(id, 'table:') then id[7:] else coalesce(nullif(table_name, ''), class_name) end as "table", synthetic and runtime_only as m, coalesce(s, false) as s, case when hits > 0 then hits end as hits from n left join b on id = dst where type = 'ENTITY' and (observed or coalesce(h, false))),
t as (select id, "table", case when m then 'minted' else 'resolved' end as kind, m and "table" = 'flyway_schema_history' as infrastructure, not m and not s as orphan, hits from x)"""
_hot = lambda spark, d: snapshots.hot_entities(made(spark, d, HOT_EDGES), made(spark, d, HOT_NODES))
_add("agg_19_hot_entities", _hot, HOT + " select * from t")
_add(
    "agg_19_blind_impact",
    lambda spark, d: snapshots.blind_impact(_hot(spark, d)),
    HOT + """, a as (select count(*) as observed, count(*) filter (where kind = 'resolved') as resolved, count(*) filter (where kind = 'minted') as minted, count(*) filter (where infrastructure) as infra, count(*) filter (where orphan) as orphans from t)
select observed > 0 as measurable, observed, resolved, minted, round(minted / observed, 4) as minted_ratio, observed - infra as observed_own, round((minted - infra) / (observed - infra), 4) as minted_ratio_own, orphans from a""",
)


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    e, n = frame(spark, d, "edges"), frame(spark, d, "nodes")
    at = frame(spark, d, "events").agg(F.max("ts")).scalar()
    return snapshots.fact_sheet(evidence.existing_edges(e, n), n, at, F.lit("2024-02-01 00:00:00").cast("timestamp"))


_add(
    "agg_16_sheet",
    _sheet,
    GRAPH + """, l as (select src as id from ex union select dst from ex), t as (select type, id in (select id from l) as linked, entry_point from nodes)
select 'layer' as section, type as key, count(*) as n from t group by type union all select 'relation', rel, count(*) from ex group by rel union all select 'totals', 'edges', count(*) from ex union all select 'totals', 'nodes', count(*) from t
union all select 'totals', 'isolated', count(*) from t where not linked and entry_point is null union all select 'participation', 'VIEW', count(*) from t where type = 'VIEW' and linked union all select 'participation', 'COMPONENT', 0 union all select 'participation', 'COMPOSABLE', 0
union all select 'provenance', 'freshness_seconds', floor(epoch_us(timestamp '2024-02-01') / 1e6 - epoch_us(max(ts)) / 1e6 + 0.5)::bigint from events""",
)
_HUBS = GRAPH + ", d as (select id, count(ex.dst) as dependents, sensitive from nodes left join ex on ex.dst = id where type = 'ENTITY' group by id, sensitive) select * from d order by dependents desc, id limit 15"
_add("agg_16_hubs", _graph(lambda e, n: snapshots.hubs(evidence.existing_edges(e, n), n)), _HUBS)
_add("top_03_hubs", _graph(lambda e, n: snapshots.hubs(evidence.existing_edges(e, n), n)), _HUBS)


def _two(e: DataFrame, n: DataFrame) -> tuple[snapshots.Graph, snapshots.Graph]:
    return (e.where("weight <= 3"), n.where("id not like '%7'")), (e.where("weight >= 3"), n.where("id not like '%33'"))


TWO = with_frames("nodes", "edges") + """, n1 as (select * from nodes where id not like '%7'), n2 as (select * from nodes where id not like '%33'), e1 as (select * from edges where weight <= 3), e2 as (select * from edges where weight >= 3),
k1 as (select distinct src, dst, rel from e1), k2 as (select distinct src, dst, rel from e2), i1 as (select dst, count(*) as c from e1 group by dst), i2 as (select dst, count(*) as c from e2 group by dst),
cd as (select id, before, after, case when before > 0 then floor((after - before) * 100 / before + 0.5)::bigint else 999 end as pct from (select n1.id, coalesce(i1.c, 0) as before, coalesce(i2.c, 0) as after from n1 join n2 on n1.id = n2.id left join i1 on i1.dst = n1.id left join i2 on i2.dst = n1.id) where before <> after)"""
_add(
    "gra_16_drift",
    _graph(lambda e, n: snapshots.drift(*_two(e, n))),
    TWO + """, p1 as (select src as id from e1 union select dst from e1), p2 as (select src as id from e2 union select dst from e2), t as (select coalesce(a.type, b.type) as type, coalesce(a.c, 0) as x, coalesce(b.c, 0) as y from (select type, count(*) as c from n1 group by type) a full outer join (select type, count(*) as c from n2 group by type) b on a.type = b.type)
select 'count' as section, 'nodes' as key, (select count(*) from n1) as before, (select count(*) from n2) as after union all select 'nodes', 'removed', (select count(*) from n1 where id not in (select id from n2)), 0 union all select 'nodes', 'added', 0, (select count(*) from n2 where id not in (select id from n1))
union all select 'count', 'edges', (select count(*) from k1), (select count(*) from k2) union all select 'edges', 'removed', (select count(*) from (from k1 except from k2)), 0 union all select 'edges', 'added', 0, (select count(*) from (from k2 except from k1))
union all select 'type', type, x, y from t where x <> y union all select 'isolated', 'nodes', (select count(*) from n1 where id not in (select id from p1)), (select count(*) from n2 where id not in (select id from p2))""",
)
for _name in ("gra_16_coupling_delta", "top_04_coupling"):
    _add(_name, _graph(lambda e, n: snapshots.coupling_delta(*_two(e, n))), TWO + " select * from cd order by abs(after - before) desc, id limit 10")

#: Services in fives that call the next one; which fives are closed to a circle differs; and dependents of some services.
_FIVES = f"select 'S' || cast(c_custkey as {_V}) as src, 'S' || cast(c_custkey + 1 as {_V}) as dst, 'CALLS' as rel from customer where c_custkey % 5 < 4"
_CLOSED = f"select 'S' || cast(c_custkey as {_V}) as src, 'S' || cast(c_custkey - 4 as {_V}) as dst, 'CALLS' as rel from customer where c_custkey % 5 = 4 and cast(floor(c_custkey / 5) as int) % "
_USED = f"select 'O' || cast(o_orderkey as {_V}) as src, 'S' || cast(o_custkey as {_V}) as dst, 'USES' as rel from orders where o_custkey % 10 = 0"
BEFORE, AFTER = f"{_FIVES} union all {_CLOSED}3 = 0 union all {_USED} and o_orderkey % 3 = 0", f"{_FIVES} union all {_CLOSED}2 = 0 union all {_USED}"
SERVICES = f"select 'S' || cast(c_custkey as {_V}) as id, 'SERVICE' as type from customer"
CYCLES = "b as (select floor(c_custkey / 5)::int as five, min('S' || c_custkey) as component from customer group by 1 having count(*) = 5)"


def _services(spark: SparkSession, d: str) -> tuple[snapshots.Graph, snapshots.Graph]:
    n = made(spark, d, SERVICES)
    return (made(spark, d, BEFORE), n), (made(spark, d, AFTER), n)


_add("gra_17_new_cycles", lambda spark, d: snapshots.new_cycles(*_services(spark, d)), f"with {CYCLES} select component, 5::bigint as size from b where five % 2 = 0 and five % 3 <> 0")
_add(
    "gra_17_drift_findings",
    lambda spark, d: snapshots.drift_findings(*_services(spark, d)),
    f"""with {CYCLES}, e1 as ({BEFORE}), e2 as ({AFTER}), i1 as (select dst, count(*) as c from e1 group by dst), i2 as (select dst, count(*) as c from e2 group by dst),
c as (select i1.dst, i1.c as before, i2.c as after from (from i1 union all select 'S' || c_custkey, 0 from customer where 'S' || c_custkey not in (select dst from i1)) i1 join (from i2 union all select 'S' || c_custkey, 0 from customer where 'S' || c_custkey not in (select dst from i2)) i2 on i1.dst = i2.dst where i1.c <> i2.c and i1.dst in (select 'S' || c_custkey from customer)),
t as (select *, case when before > 0 then floor((after - before) * 100 / before + 0.5) else 999 end as pct from c order by abs(after - before) desc, dst limit 10), n as (select component from b where five % 2 = 0 and five % 3 <> 0 order by component limit 20)
select 'new-cycle' as subtype, 'medium' as severity, component as identifier, 0::bigint as before, 5::bigint as after from n union all select 'coupling-spike', 'low', dst, before, after from t where after - before >= 5 and pct >= 50""",
)


def _links(e: DataFrame, n: DataFrame) -> tuple[DataFrame, DataFrame]:
    return evidence.edge_evidence(evidence.existing_edges(e, n)), n.where("type = 'ENTITY' and sensitive").select("id")


def _impact(e: DataFrame, n: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    links, roots = _links(e, n)
    found = snapshots.impact(links, roots)
    return found, snapshots.blind_spots(links, found, roots), roots


IMPACT = "with recursive " + GRAPH[5:] + """, st as (select src, dst, max(conf) as w from ec group by src, dst), ro as (select id from nodes where type = 'ENTITY' and sensitive),
r(node, width) as (select id, 1.0::double from ro union select src, least(width, w) from r join st on dst = node),
w as (select node as id, max(width) as confidence from r where node not in (select id from ro) group by node),
f as (select id, confidence, case confidence when 0.95::double then 'RUNTIME_OBSERVED' when 0.80::double then 'STATIC_PROVEN' when 0.78::double then 'CONFIG_PROVEN' when 0.40::double then 'STATIC_UNRESOLVED' else 'UNKNOWN' end as method, case when confidence >= 0.78 then 'proven' else 'possible' end as grade from w),
x as (select id from f union select id from ro), s as (select distinct src, dst, rel, m as method from em where m in ('STATIC_UNRESOLVED', 'UNKNOWN') and (src in (select id from x) or dst in (select id from x)))"""  # fmt: skip
_add("gra_08_impact", _graph(lambda e, n: snapshots.graded(_impact(e, n)[0]).drop("hops", "next")), IMPACT + " select * from f")
_add("gra_08_blind_spots", _graph(lambda e, n: _impact(e, n)[1]), IMPACT + " select * from s")
_add(
    "gra_08_impact_summary",
    _graph(lambda e, n: snapshots.impact_summary(*_impact(e, n)[:2])),
    IMPACT + " select count(*) filter (where grade = 'proven') as proven, count(*) filter (where grade = 'possible') as possible, min(confidence) as overall_confidence, arg_min(method, confidence) as overall_method, (select count(*) from s) as blind_spots from f",
)

_READY = f"""select case when o_orderkey % 10 <> 0 then '/e/' || cast(o_orderkey as {_V}) end as endpoint, o_orderkey % 20 = 0 as ui, case when o_custkey % 9 <> 0 then 'C' end as controller,
  case when o_orderpriority like '1%' then 'ADMIN' else '' end as roles, case when o_orderkey % 3 = 0 then 'Order' else '' end as entities from orders"""
_SCREENS = f"select case when c_custkey % 4 <> 0 then '/s/' || cast(c_custkey as {_V}) else '' end as route from customer"


def _ready(spark: SparkSession, d: str) -> DataFrame:
    listed = {c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.array(c)) for c in ("roles", "entities")}
    return snapshots.readiness(made(spark, d, _READY).withColumns(listed), made(spark, d, _SCREENS), F.col("ui"))


_add(
    "agg_07_readiness",
    _ready,
    f"""with e as ({_READY}), s as ({_SCREENS}), p as (select floor(count(*) filter (where not ui and endpoint is not null) * 100 / count(*) filter (where not ui) + 0.5)::bigint as endpoints, (select floor(count(*) filter (where route <> '') * 100 / count(*) + 0.5)::bigint from s) as routes,
  floor(count(*) filter (where roles <> '' and endpoint is not null) * 100 / count(endpoint) + 0.5)::bigint as security, floor(count(*) filter (where entities <> '' and endpoint is not null) * 100 / count(endpoint) + 0.5)::bigint as entities, floor(count(*) filter (where controller is not null and endpoint is not null) * 100 / count(endpoint) + 0.5)::bigint as controllers from e)
select *, floor((endpoints * 30 + routes * 15 + security * 25 + entities * 15 + controllers * 15) / 100 + 0.5)::bigint as score from p""",
)
_CHAINS = f"select '/e/' || cast(o_orderkey as {_V}) as endpoint, 'OrderService' || cast(o_custkey % 20 as {_V}) || case o_orderkey % 3 when 0 then '.save' when 1 then '.Load' else '' end as step from orders union all select '/e/' || cast(o_orderkey as {_V}), 'Repo' || cast(o_custkey % 3 as {_V}) || '.find' from orders"
_CHANGED = f"select 'src/orderService' || cast(p_size as {_V}) || case when p_size % 4 = 0 then '.ts' else '.java' end as path, case p_partkey % 3 when 0 then 'SAVE' when 1 then 'load' end as symbol from part where p_size % 7 < 3 union all select 'src/Repo1.kt', 'find' from region"
_add(
    "agg_22_hot_symbols",
    lambda spark, d: snapshots.hot_symbols(made(spark, d, _CHAINS), made(spark, d, _CHANGED)),
    f"""with h as ({_CHAINS}), c as (select regexp_extract(path, '([^/.]+)[.][a-z]+$', 1) as cls, symbol from ({_CHANGED}) where not suffix(path, '.ts')), s as (select endpoint, lower(step) as step from h where contains(step, '.')),
k as (select distinct endpoint, unnest([step, split_part(step, '.', 1)]) as k from s), a as (select cls as name from c union select cls || '.' || symbol from c where symbol is not null)
select name as symbol, count(distinct endpoint) as fan_in from a join k on lower(name) = k group by name order by fan_in desc, contains(name, '.') desc, name limit 5""",
)
