"""Queries over the adapter frames, each with the SQL that must give the same rows.

Names begin with the operator's id in the blueprint's inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.operators import catalog as cat
from evigraph.operators import diff, evidence, fixpoint, models, runtime
from evigraph.plans.adapters import catalog, frame, with_frames
from evigraph.streaming import spans as streams

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _ALL[name] = (query, sql)


def _graph(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(frame(spark, d, "edges"), frame(spark, d, "nodes"))


def _entries(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(catalog(spark, d))


def _spans(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(frame(spark, d, "spans"))


METHOD = """case when observed then 'RUNTIME_OBSERVED' when config_proven or resolution = 'config' then 'CONFIG_PROVEN'
  when synthetic or resolution in ('convention-name', 'dynamic', 'heuristic') or (resolution like 'syntactic%' and resolution <> 'syntactic-resolved') then 'STATIC_UNRESOLVED'
  when resolution in ('compiler', 'interface-impl', 'syntactic-resolved', 'exact', 'type', 'import', 'direct') then 'STATIC_PROVEN' else 'UNKNOWN' end"""
CONF = "case m when 'RUNTIME_OBSERVED' then 0.95::double when 'STATIC_PROVEN' then 0.80::double when 'CONFIG_PROVEN' then 0.78::double when 'STATIC_UNRESOLVED' then 0.40::double else 0.20::double end"
GRAPH = with_frames("nodes", "edges") + f""",
ex as (select * from edges where src in (select id from nodes) and dst in (select id from nodes)),
em as (select *, {METHOD} as m from ex),
ec as (select *, {CONF} as conf from em)"""
CENSUS = (
    GRAPH
    + """,
census as (select count(*) filter (where m = 'RUNTIME_OBSERVED') as runtime_observed, count(*) filter (where m = 'STATIC_PROVEN') as static_proven, count(*) filter (where m = 'CONFIG_PROVEN') as config_proven,
  count(*) filter (where m = 'STATIC_UNRESOLVED') as static_unresolved, 0::bigint as llm_conjectured, count(*) filter (where m = 'UNKNOWN') as unknown, count(*) as total from em),
c as (select *, case when total > 0 then round(runtime_observed / total, 6) else 0.0 end as observed_ratio from census)"""
)

_add("agg_03_census", _graph(evidence.census), CENSUS + " select * from c")
_add(
    "agg_18_verdict",
    _graph(lambda e, n: evidence.verdict(evidence.census(e, n))),
    CENSUS
    + """, v as (select runtime_observed, total, observed_ratio, round((runtime_observed + static_proven + config_proven) / total, 6) as proven_ratio, round((unknown + static_unresolved) / total, 6) as unresolved_ratio from c)
select *, case when observed_ratio >= 0.15 or (proven_ratio >= 0.45 and (runtime_observed >= 25 or observed_ratio >= 0.05)) then 'STRONG' when proven_ratio < 0.2 then 'WEAK' else 'MODERATE' end as tier from v""",
)
_add("prj_03_edge_evidence", _graph(lambda e, n: evidence.edge_evidence(e).select("src", "dst", "rel", "seq", "method", "confidence")), with_frames("edges") + f", em as (select *, {METHOD} as m from edges) select src, dst, rel, seq, m as method, {CONF} as confidence from em")
_add("join_01_existing_edges", _graph(lambda e, n: evidence.existing_edges(e, n).select("src", "dst", "rel", "seq")), GRAPH + " select src, dst, rel, seq from ex")
_add("agg_01_degree", _graph(evidence.degrees), GRAPH + " select id, (select count(*) from ex where dst = id) as in_degree, (select count(*) from ex where src = id) as out_degree from nodes")
_add(
    "agg_02_facets",
    _graph(lambda e, n: evidence.facets(n)),
    with_frames("nodes")
    + """, l as (select type, case type when 'VIEW' then 'presentation' when 'CONTROLLER' then 'api' when 'SERVICE' then 'domain' when 'ENTITY' then 'data' else 'infra' end as layer from nodes)
select type as facet, 'type' as kind, count(*) as n from l group by type union all select layer, 'layer', count(*) from l group by layer union all select '*', 'all', count(*) from l""",
)
_add(
    "agg_04_class_rollup",
    _graph(lambda e, n: evidence.class_rollup(n)),
    with_frames("nodes") + " select class_key, count(*) as members, bool_or(sensitive) as sensitive, bool_or(runtime_hot) as runtime_hot, sum(case when runtime_hot then hits else 0 end)::bigint as hits, count(entry_point) as entry_points, min(id) as first_member from nodes group by class_key",
)
FIRST = "first as (select * from (select *, row_number() over (partition by src, dst, rel order by seq) as rn from edges) where rn = 1)"
_add("gra_01_first_wins", _graph(lambda e, n: evidence.first_wins(e).select("src", "dst", "rel", "resolution", "seq")), with_frames("edges") + f", {FIRST} select src, dst, rel, resolution, seq from first")
CLASS = """, ce as (select a.class_key as s, b.class_key as d, rel, seq, src, dst, m from em join nodes a on src = a.id join nodes b on dst = b.id where a.class_key <> b.class_key),
cls as (select s as src, d as dst, rel, count(*) as raw_edges, arg_min(m, row(seq, src, dst)) as method from ce group by s, d, rel)"""
_add("gra_27_class_edges", _graph(evidence.class_edges), GRAPH + CLASS + " select * from cls")
_add(
    "ui_01_corroboration",
    _graph(evidence.node_corroboration),
    GRAPH + ", t as (select src as id, m, conf from ec union all select dst, m, conf from ec) select id, count(*) as degree, count(distinct m) as corroboration, count(*) filter (where m in ('UNKNOWN', 'STATIC_UNRESOLVED')) as blind, max(conf) as strongest from t group by id",
)
_add(
    "ui_02_blind_spots",
    _graph(lambda e, n: evidence.node_corroboration(e, n).where("blind = degree").orderBy(F.desc("degree"), "id").limit(8).select("id", "degree")),
    GRAPH + ", t as (select src as id, m from em union all select dst, m from em) select id, count(*) as degree from t group by id having bool_and(m in ('UNKNOWN', 'STATIC_UNRESOLVED')) order by degree desc, id limit 8",
)
DEG = ", t as (select src as id, 0 as i, 1 as o from ex union all select dst, 1, 0 from ex), g as (select nodes.id, coalesce(sum(i), 0)::bigint as in_degree, coalesce(sum(o), 0)::bigint as out_degree from nodes left join t on nodes.id = t.id group by nodes.id)"
_add("agg_16_isolated", _graph(evidence.isolated), GRAPH + " select id, type from nodes where id not in (select src from ex) and id not in (select dst from ex)")
_add("join_04_never_called", _graph(evidence.never_called), GRAPH + " select id, type from nodes where entry_point is null and id not in (select dst from edges where rel = 'CALLS')")


def _overlay(e: DataFrame, n: DataFrame) -> DataFrame:
    proofs = e.where("weight = 5 and rel <> 'CALLS'").select("src", "dst", F.lit("WRITES_ENTITY").alias("rel"), F.lit("compiler").alias("resolution"))
    merged, minted = evidence.merge_overlay(e, proofs, n)
    return merged.groupBy("rel", "origin").agg(F.count("*").alias("n")).unionByName(minted.agg(F.lit("*").alias("rel"), F.lit("minted").alias("origin"), F.count("*").alias("n")))


_add(
    "gra_18_proof_overlay",
    _graph(_overlay),
    with_frames("nodes", "edges")
    + """, p as (select distinct src, dst, 'WRITES_ENTITY' as rel from edges where weight = 5 and rel <> 'CALLS'), l as (select distinct src, dst, rel from edges),
m as (select coalesce(l.rel, p.rel) as rel, case when p.src is null then 'kept' else 'proven' end as origin from l full outer join p on l.src = p.src and l.dst = p.dst and l.rel = p.rel)
select rel, origin, count(*) as n from m group by rel, origin union all
select '*', 'minted', count(*) from (select src as id from p union select dst from p) where id not in (select id from nodes)""",
)


def _roots(n: DataFrame) -> DataFrame:
    """All views."""
    return n.where("type = 'VIEW'").select("id")


_add(
    "gra_02_reach",
    _graph(lambda e, n: fixpoint.reach(e.where("rel = 'CALLS'"), _roots(n))),
    """with recursive """ + with_frames("nodes", "edges")[5:] + """, st as (select distinct src, dst from edges where rel = 'CALLS'),
r(root, node, depth) as (select id, id, 0 from nodes where type = 'VIEW' union select root, dst, depth + 1 from r join st on node = src where depth < 40)
select root, node, min(depth) as depth from r group by root, node""",
)
_add(
    "gra_07_reach_count",
    _graph(lambda e, n: fixpoint.reach_counts(e.where("rel = 'CALLS'"), _roots(n))),
    """with recursive """ + with_frames("nodes", "edges")[5:] + """, st as (select distinct src, dst from edges where rel = 'CALLS'),
r(root, node) as (select id, id from nodes where type = 'VIEW' union select root, dst from r join st on node = src)
select root, count(*) - 1 as reached from r group by root""",
)


def _class_graph(e: DataFrame, n: DataFrame) -> tuple[DataFrame, DataFrame]:
    return evidence.class_edges(e, n), n.select(F.col("class_key").alias("id")).distinct()


def _components(e: DataFrame, n: DataFrame) -> DataFrame:
    ce, cn = _class_graph(e, n)
    return fixpoint.strong_components(ce, cn)


def _levels(e: DataFrame, n: DataFrame) -> DataFrame:
    ce, cn = _class_graph(e, n)
    parts = fixpoint.strong_components(ce, cn)
    return fixpoint.levels(ce, parts)


REC = """with recursive """ + (GRAPH + CLASS)[5:] + """, st as (select distinct src, dst from cls),
r(a, b) as (select src, dst from st union select a, dst from r join st on b = src),
cn as (select distinct class_key as id from nodes),
co as (select id as node, least(id, coalesce((select min(x.b) from r x join r y on x.a = y.b and x.b = y.a where x.a = id), id)) as component from cn)"""  # fmt: skip
_add("gra_05_strong_components", _graph(_components), REC + " select * from co")
_add(
    "gra_06_levels",
    _graph(_levels),
    REC + """, cs as (select distinct p.component as s, q.component as d from st join co p on src = p.node join co q on dst = q.node where p.component <> q.component),
w(c, level) as (select distinct component, 0 from co union select d, level + 1 from w join cs on c = s)
select c as component, max(level) as level from w group by c""",
)
_add(
    "gra_08_widest_path",
    _graph(lambda e, n: fixpoint.widest(evidence.edge_evidence(evidence.existing_edges(e, n)), n.where("type = 'ENTITY' and sensitive").select("id"))),
    "with recursive " + GRAPH[5:] + """, st as (select src, dst, max(conf) as w from ec group by src, dst),
r(node, width) as (select id, 1.0::double from nodes where type = 'ENTITY' and sensitive union select src, least(width, w) from r join st on dst = node)
select node, max(width) as width from r group by node""",
)
_add(
    "gra_09_capabilities",
    _graph(lambda e, n: fixpoint.propagate(evidence.class_edges(e, n), n.where("sensitive").select(F.col("class_key").alias("node"), F.lit("sensitive").alias("capability")))),
    "with recursive " + (GRAPH + CLASS)[5:] + """, r(node) as (select distinct class_key from nodes where sensitive union select src from r join cls on dst = node) select node, 'sensitive' as capability from r""",
)

_add(
    "imp_06_edge_diff",
    _graph(lambda e, n: diff.changed_rows(evidence.first_wins(e.where("weight <= 4")), evidence.first_wins(e.where("weight >= 3")), ["src", "dst", "rel"], "resolution")),
    with_frames("edges")
    + """, a as (select src, dst, rel, arg_min(coalesce(resolution, ''), seq) as r from edges where weight <= 4 group by all), b as (select src, dst, rel, arg_min(coalesce(resolution, ''), seq) as r from edges where weight >= 3 group by all),
j as (select coalesce(a.src, b.src) as src, coalesce(a.dst, b.dst) as dst, coalesce(a.rel, b.rel) as rel, case when a.src is null then 'added' when b.src is null then 'removed' when a.r <> b.r then 'changed' end as change from a full outer join b on a.src = b.src and a.dst = b.dst and a.rel = b.rel)
select * from j where change is not null""",
)


def _files(spark: SparkSession, d: str) -> DataFrame:
    docs = frame(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return diff.changed_rows(docs.where("doc_id % 7 <> 0"), docs.where("doc_id % 5 <> 0").withColumn("hash", F.expr("case when doc_id % 11 = 0 then 'edited' else hash end")), ["doc_id"], "hash")


_add(
    "imp_10_changed_files",
    _files,
    """with h as (select doc_id, sha256(text) as hash from documents), a as (select * from h where doc_id % 7 <> 0), b as (select doc_id, case when doc_id % 11 = 0 then 'edited' else hash end as hash from h where doc_id % 5 <> 0),
j as (select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'added' when b.doc_id is null then 'removed' when a.hash <> b.hash then 'changed' end as change from a full outer join b on a.doc_id = b.doc_id)
select * from j where change is not null""",
)

CAT = with_frames("catalog")
LISTS = CAT + """, c as (select * exclude (roles, entities, sensitive_fields), case when roles = '' then [] else string_split(roles, ',') end as roles, case when entities = '' then [] else string_split(entities, ',') end as entities,
  case when sensitive_fields = '' then [] else string_split(sensitive_fields, ',') end as fields, roles <> '' as p,
  case when regexp_matches(lower(operation), '^(create|add|new|import|bulk|generate)') then 'CREATE' when regexp_matches(lower(operation), '^(update|edit|patch|change)') then 'UPDATE' when regexp_matches(lower(operation), '^(delete|remove)') then 'DELETE'
    when regexp_matches(lower(operation), '^(find|get|list|search)') then 'READ' else 'OTHER' end as verb from catalog)"""  # fmt: skip
COV = """, cov as (select case when grouping(http_method) = 0 then 'method' when grouping(controller) = 0 then 'controller' else 'all' end as kind, coalesce(http_method, controller, '*') as key, count(*) as total, count(*) filter (where p) as protected,
  floor(count(*) filter (where p) * 100 / count(*) + 0.5)::bigint as percent, count(*) filter (where not p and criticality >= 70) as critical_open, count(*) filter (where not p and criticality between 50 and 69) as high_open from c group by grouping sets ((), (http_method), (controller)))"""
_add("agg_08_coverage", _entries(cat.coverage), LISTS + COV + " select * from cov")
_add(
    "agg_09_common_roles",
    _entries(cat.common_roles),
    LISTS + ", s as (select controller, count(*) as n from c where p group by controller), r as (select controller, unnest(roles) as role from c where p), u as (select controller, role, count(*) as uses from r group by controller, role) select u.* from u join s on u.controller = s.controller where uses >= ceil(n * 0.4)",
)
_add("agg_10_governance", _entries(cat.governance), LISTS + ", r as (select http_method, criticality, unnest(roles) as permission from c) select permission, count(*) as endpoints, count(distinct http_method) as methods, max(criticality) as highest from r where permission <> 'AUTHENTICATED' group by permission")
_add("top_01_unguarded", _entries(cat.unguarded), LISTS + " select entry_id, endpoint, http_method, criticality from c where not p")
_add("agg_11_exposure", _entries(cat.exposure), LISTS + " select entry_id, endpoint, case when not p then 'none' when len(list_filter(roles, lambda x: x <> 'AUTHENTICATED')) = 0 then 'auth-only' else 'permission' end as guard, criticality, len(fields)::bigint as fields from c where len(fields) > 0")
_add("agg_12_entity_access", _entries(cat.entity_access), LISTS + ", x as (select unnest(entities) as entity, endpoint, verb from c) select entity, count(*) filter (where verb = 'READ') as reads, count(*) filter (where verb in ('CREATE', 'UPDATE', 'DELETE')) as writes, count(distinct endpoint) as endpoints from x group by entity")
_add("agg_13_overlap", _entries(cat.overlap), LISTS + ", x as (select unnest(entities) as entity, endpoint, verb from c where verb <> 'OTHER') select verb, entity, count(distinct endpoint) as endpoints from x group by verb, entity having count(distinct endpoint) >= 2")
_add(
    "agg_14_lifecycle",
    _entries(cat.lifecycle),
    LISTS
    + """, x as (select unnest(entities) as entity, verb from c where verb <> 'OTHER'), k as (select entity, bool_or(verb = 'CREATE') as "create", bool_or(verb = 'UPDATE') as "update", bool_or(verb = 'DELETE') as "delete", bool_or(verb = 'READ') as "read" from x group by entity)
select *, case when ("create" or "update" or "delete") and not "read" then 'WRITABLE_NOT_READABLE' when "read" and not ("create" or "update" or "delete") then 'READABLE_NOT_WRITABLE' end as gap from k""",
)
_add("agg_33_stats", _entries(cat.stats), CAT + " select count(*) as entries, count(*) filter (where criticality > 70) as critical, count(distinct controller) as controllers, count(distinct endpoint) as endpoints from catalog")
_add("agg_34_deduplicated", _entries(cat.deduplicated), CAT + " select endpoint, http_method, min(entry_id) as entry_id, count(*) - 1 as duplicates, arg_min(criticality, entry_id) as criticality from catalog group by endpoint, http_method")
SEC = LISTS + """, dm as (select *, lower(case when len(entities) > 0 then entities[1] else regexp_replace(string_split(endpoint, '/')[4], 's$', '') end) as domain from c),
g1 as (select http_method, domain, count(*) as n, count(*) filter (where p) as k from dm group by all having count(*) >= 2 and count(*) filter (where p) between 1 and count(*) - 1 and count(*) filter (where p) / count(*) >= 0.5),
s1 as (select entry_id, 'UNPROTECTED_OUTLIER' as type, case when criticality >= 70 then 'critical' when criticality >= 50 then 'high' when criticality >= 30 then 'medium' else 'low' end as severity from dm join g1 using (http_method, domain) where not p),
s2 as (select entry_id, 'PRIVILEGE_ESCALATION' as type, case when p then 'high' else 'critical' end as severity from c where http_method in ('POST', 'PUT', 'PATCH')
  and (len(list_filter(entities, lambda x: regexp_matches(lower(x), 'role|authority|permission|privilege'))) > 0 or len(list_filter(fields, lambda x: regexp_matches(lower(x), 'role|authorit|permission|admin|privilege|superuser'))) > 0)
  and len(list_filter(roles, lambda x: regexp_matches(lower(x), 'admin|superuser|root|system'))) = 0),
s3 as (select entry_id, 'SENSITIVE_DATA_EXPOSURE' as type, case when p then 'medium' else 'critical' end as severity from c where http_method = 'GET' and len(list_filter(fields, lambda x: regexp_matches(lower(x), 'password|secret|token|ssn'))) > 0
  and len(list_filter(roles, lambda x: regexp_matches(lower(x), 'admin|system|root'))) = 0),
ow as (select *, not p and http_method in ('POST', 'PUT', 'PATCH', 'DELETE') as w from c),
s4 as (select controller, count(*) as total, count(*) filter (where p) as protected, count(*) filter (where w) as open_writes, case when max(criticality) filter (where w) >= 50 then 'high' else 'medium' end as severity from ow group by controller
  having count(*) >= 2 and count(*) filter (where p) between 1 and count(*) - 1 and count(*) filter (where p) / count(*) >= 0.5 and count(*) filter (where w) > 0),
rp as (select http_method, endpoint from c where entry_id in (select entry_id from s1 union select entry_id from s2 union select entry_id from s3) union select http_method, endpoint from ow where w and controller in (select controller from s4)),
s5 as (select arg_min(entry_id, entry_id) as entry_id, 'MISSING_PROTECTION' as type, case when arg_min(criticality, entry_id) >= 80 then 'critical' else 'high' end as severity from c where not p and criticality >= 60 and not exists (select 1 from rp where rp.http_method = c.http_method and rp.endpoint = c.endpoint) group by http_method, endpoint)"""  # fmt: skip
_add("sec_01_unprotected_outlier", _entries(cat.unprotected_outliers), SEC + " select * from s1")
_add("sec_02_privilege_escalation", _entries(cat.privilege_escalation), SEC + " select * from s2")
_add("sec_03_sensitive_exposure", _entries(cat.sensitive_exposure), SEC + " select * from s3")
_add("sec_04_inconsistent_protection", _entries(cat.inconsistent_protection), SEC + " select * from s4")
_add("sec_05_missing_protection", _entries(cat.missing_protection), SEC + " select * from s5")
_add("sec_06_coverage_gap", _entries(cat.coverage_gaps), LISTS + COV + " select key, total, percent, case when kind = 'all' then 'info' when key = 'DELETE' then 'high' else 'medium' end as severity from cov where kind = 'all' or (kind = 'method' and key <> 'GET' and percent < 50 and total >= 2)")
_add(
    "agg_35_security_delta",
    _entries(lambda e: cat.security_delta(e.where("entry_id % 3 <> 0"), e.where("entry_id % 3 <> 1"))),
    LISTS
    + """, d as (select http_method, floor(count(*) filter (where p and entry_id % 3 <> 0) * 100 / count(*) filter (where entry_id % 3 <> 0) + 0.5)::bigint as before, floor(count(*) filter (where p and entry_id % 3 <> 1) * 100 / count(*) filter (where entry_id % 3 <> 1) + 0.5)::bigint as after from c group by http_method)
select *, after - before as delta from d""",
)
_add(
    "imp_07_regression",
    _entries(lambda e: diff.regressions(cat.coverage(e.where("entry_id % 3 <> 0")).where("kind = 'controller'"), cat.coverage(e.where("entry_id % 3 <> 1 and controller <> 'Controller7'")).where("kind = 'controller'"))),
    LISTS
    + """, a as (select controller as key, floor(count(*) filter (where p) * 100 / count(*) + 0.5)::bigint as was from c where entry_id % 3 <> 0 group by 1), b as (select controller as key, floor(count(*) filter (where p) * 100 / count(*) + 0.5)::bigint as now from c where entry_id % 3 <> 1 and controller <> 'Controller7' group by 1)
select coalesce(a.key, b.key) as key, was, now, case when now is null then 'REMOVED' else 'COVERAGE_DROP' end as kind from a full outer join b on a.key = b.key where now is null or was - now >= 3""",
)

SPANS = with_frames("spans") + ", rt as (select trace_id, arg_min(route, row(case when service = 'gateway' then 0 else 1 end, start_ts, span_id)) as route, arg_min(span_id, row(case when service = 'gateway' then 0 else 1 end, start_ts, span_id)) as span_id from spans group by trace_id)"
_add("win_06_root_span", _spans(lambda s: runtime.root_spans(s).select("trace_id", "span_id", "route")), SPANS + " select trace_id, span_id, route from rt")
_add("str_01_route_pairs", _spans(runtime.route_pairs), SPANS + " select rt.route, count(distinct spans.trace_id) as traces, count(distinct table_name) as tables, count(*) as spans, max(start_ts) as last_seen from spans join rt on spans.trace_id = rt.trace_id group by rt.route")
_add("str_02_table_hits", _spans(lambda s: runtime.table_hits(s).drop("last_seen")), SPANS + " select table_name, count(*) as hits from spans where table_name is not null group by table_name")
_add(
    "str_03_carry_forward",
    _spans(lambda s: runtime.carry_forward(runtime.table_hits(s.where("span_id % 17 < 12")), runtime.table_hits(s.where("span_id % 17 > 8"))).drop("last_seen")),
    SPANS
    + """, th as (select table_name, span_id % 17 as g, start_ts from spans where table_name is not null), a as (select table_name, count(*) as h, max(start_ts) as l from th where g < 12 group by 1), b as (select table_name, count(*) as h, max(start_ts) as l from th where g > 8 group by 1)
select coalesce(a.table_name, b.table_name) as table_name, coalesce(b.h, a.h) as hits, b.l is null as stale from a full outer join b on a.table_name = b.table_name where b.l is not null or a.l >= (select max(l) from b) - interval 7 day""",
)
_add("win_04_first_touch", _spans(runtime.first_touch), SPANS + ", f as (select trace_id, table_name, min(row(start_ts, span_id)) as t from spans where table_name is not null group by all) select trace_id, table_name, row_number() over (partition by trace_id order by t) - 1 as rank from f")
_add("win_05_richest_trace", _spans(runtime.richest_trace), SPANS + ", n as (select route, trace_id, count(*) as n from spans where table_name is not null group by all) select route, arg_min(trace_id, row(-n, trace_id)) as trace_id, max(n) as n from n group by route")
_add(
    "agg_24_chao",
    _spans(lambda s: runtime.chao(s.select(F.col("user_id").alias("item"), F.to_date("start_ts").alias("occasion")))),
    SPANS + ", i as (select distinct user_id as item, start_ts::date as o from spans), k as (select item, count(*) as k from i group by item), t as (select count(distinct o) as t from i), c as (select count(*) as seen, count(*) filter (where k = 1) as f1, count(*) filter (where k = 2) as f2 from k) select seen, f1, f2, round(seen + (t - 1) / t * f1 * (f1 - 1) / (2 * (f2 + 1)), 4) as estimate from c, t",
)
_add(
    "join_07_innermost",
    _spans(lambda s: runtime.innermost(s.select(F.col("user_id").alias("doc"), F.col("span_id").alias("p")), s.where("span_id % 5 = 0").select(F.col("user_id").alias("doc"), F.col("span_id").alias("lo"), (F.col("span_id") + 4000).alias("hi"), F.concat(F.lit("n"), F.col("span_id")).alias("name")))),
    SPANS + ", r as (select user_id as doc, span_id as lo, span_id + 4000 as hi, 'n' || span_id as name from spans where span_id % 5 = 0) select doc, p, arg_max(name, row(lo, -hi, name)) as name from (select user_id as doc, span_id as p, r.lo, r.hi, r.name from spans join r on user_id = r.doc and span_id >= lo and span_id < hi) group by doc, p",
)
_add(
    "ui_06_run_deltas",
    lambda spark, d: diff.run_deltas(frame(spark, d, "runs").withColumn("grp", F.expr("run_id % 4")).withColumn("valid", F.expr("run_id % 5 <> 0"))),
    with_frames("runs") + ", v as (select *, run_id % 4 as grp from runs where run_id % 5 <> 0) select grp, run_id, edges - lag(edges) over w as d_edges, (observed - lag(observed) over w)::bigint as d_observed, (holes - lag(holes) over w)::bigint as d_holes from v window w as (partition by grp order by run_id)",
)
_add("win_01_latest_two", lambda spark, d: cat.latest_two(frame(spark, d, "runs").withColumn("grp", F.expr("run_id % 4"))).select("grp", "run_id", "edges", F.col("n").cast("long").alias("n")), with_frames("runs") + " select * from (select run_id % 4 as grp, run_id, edges, row_number() over (partition by run_id % 4 order by run_id desc) as n from runs) where n <= 2")

_add(
    "fn_07_08_urls",
    lambda spark, d: frame(spark, d, "pages").select("page_id", text.strip_query(F.col("url")).alias("bare"), text.external_domain(F.col("url")).alias("host"), text.path_of(F.col("url")).alias("path")),
    "select page_id, string_split(url, '?')[1] as bare, nullif(regexp_extract(url, '^[hH][tT][tT][pP][sS]?://([^/]+)', 1), '') as host, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[hH][tT][tT][pP][sS]?://[^/]*', ''), '/+$', ''), ''), '/') as path from pages",
)
_add(
    "fn_01_snake_case",
    lambda spark, d: frame(spark, d, "catalog").select("entry_id", text.snake_case(F.concat("controller", F.initcap("operation"))).alias("name")),
    CAT + r" select entry_id, lower(regexp_replace(regexp_replace(controller || upper(operation[1]) || lower(operation[2:]), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) as name from catalog",
)
_add(
    "fn_08_hosts",
    lambda spark, d: frame(spark, d, "pages").select(text.external_domain(F.col("url")).alias("host"), F.element_at(F.split(text.path_of(F.col("url")), "/"), 2).alias("prefix")).groupBy("host", "prefix").agg(F.count("*").alias("n")),
    "select nullif(regexp_extract(url, '^[hH][tT][tT][pP][sS]?://([^/]+)', 1), '') as host, string_split(coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[hH][tT][tT][pP][sS]?://[^/]*', ''), '/+$', ''), ''), '/'), '/')[2] as prefix, count(*) as n from pages group by all",
)
_add(
    "src_11_text_lines",
    lambda spark, d: frame(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.length("line")).cast("long").alias("longest")),
    "select doc_id, count(*) as lines, max(length(line)) as longest from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by doc_id",
)

_add("agg_05_manifest", _entries(models.manifest), LISTS + ", x as (select controller, endpoint, unnest(case when len(roles) = 0 then [null] else roles end) as role, entities from c), y as (select controller, endpoint, role, unnest(case when len(entities) = 0 then [null] else entities end) as entity from x) select controller, count(distinct endpoint) as endpoints, coalesce(string_agg(distinct role, ',' order by role), '') as roles, coalesce(string_agg(distinct entity, ',' order by entity), '') as entities from y group by controller")
_add("agg_07_completeness", _entries(models.completeness), LISTS + ", n as (select count(*) as n, count(*) filter (where len(roles) > 0) as roles, count(*) filter (where len(entities) > 0) as entities, count(*) filter (where len(fields) > 0) as sensitive_fields from c) select *, floor((roles * 40 + entities * 40 + sensitive_fields * 20) / n + 0.5)::bigint as score from n")
_add(
    "agg_15_assessment",
    _entries(models.assessment),
    LISTS
    + """, x as (select unnest(entities) as entity, endpoint, verb from c where verb <> 'OTHER'), o as (select verb, entity from x group by all having count(distinct endpoint) >= 2),
g as (select entity from x group by entity having bool_or(verb in ('CREATE', 'UPDATE', 'DELETE')) <> bool_or(verb = 'READ'))
select count(*) as entries, count(*) filter (where not p) as open, (select count(*) from o) as overlaps, (select count(*) from g) as gaps from c""",
)
_add(
    "agg_20_churn_entropy",
    lambda spark, d: models.churn_entropy(frame(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("grp"), F.col("l_suppkey").alias("file"))),
    "with p as (select l_orderkey % 50 as grp, l_suppkey as file, count(*) as n from lineitem group by all), s as (select grp, sum(n)::bigint as changes, count(*) as files, sum(n * log2(n)) as s from p group by grp) select grp, changes, files, case when files < 2 then 0.0 else round((log2(changes) - s / changes) / log2(files), 4) end as entropy from s",
)
CONFIRMED = GRAPH + ", o as (select distinct src, dst from em where observed), s as (select distinct src, dst, m from em where not observed) select m as method, count(*) as pairs, count(o.src) as confirmed, round(count(o.src) / count(*), 4) as rate from s left join o on s.src = o.src and s.dst = o.dst group by m"
_add("join_15_confirmations", _graph(models.confirmations), CONFIRMED)
_add("agg_23_reliability", _graph(models.reliability))
CONCEPTS = {"steel": "(?i)steel", "brass": "(?i)brass", "large": "(?i)^large", "plated": "(?i)plated", "none": "zzzz"}
_add("agg_27_concepts", lambda spark, d: models.concept_coverage(frame(spark, d, "part").select(F.col("p_type").alias("name")), CONCEPTS), " union all ".join(f"select '{c}' as concept, count(*) as names from part where regexp_matches(p_type, '{p}')" for c, p in CONCEPTS.items()))
_add("agg_29_group_pairs", _graph(models.group_pairs), GRAPH + " select a.type as src_type, b.type as dst_type, count(*) as edges, max(conf) as best, min(conf) as worst from ec join nodes a on src = a.id join nodes b on dst = b.id group by all")
_add("top_07_per_controller", _entries(models.top_per_group), CAT + " select controller, entry_id, criticality, rank from (select *, row_number() over (partition by controller order by criticality desc, entry_id) as rank from catalog) where rank <= 12")
_add("agg_32_policy_matrix", _entries(models.policy_matrix), LISTS + ", x as (select unnest(case when p then roles else ['PUBLIC'] end) as role, http_method, entities from c), y as (select role, http_method, unnest(entities) as entity from x) select role, entity, string_agg(distinct http_method, ',' order by http_method) as methods, count(*) as endpoints from y group by role, entity")
_add("imp_01_impact", _entries(lambda e: models.impact_of(e, "Order")), LISTS + " select entry_id, endpoint, http_method from c where list_contains(entities, 'Order')")
_add("imp_01_impact_by_part", _entries(lambda e: models.impact_of(e, "machin")), LISTS + " select entry_id, endpoint, http_method from c where len(list_filter(entities, lambda x: contains(lower(x), 'machin'))) > 0")
_add("prj_11_malformed", _entries(models.malformed), CAT + " select entry_id, regexp_matches(endpoint, '//|\\s') or not starts_with(endpoint, '/') as malformed from catalog")
_add(
    "ui_08_authorization_flow",
    _entries(models.authorization_flow),
    LISTS + ", u as (select case when not p then 'open' when list_contains(roles, 'ADMIN') then 'admin' else 'role' end as guard, coalesce(entities[1], '-') as entity, count(*) as n from c group by 1, 2), r as (select guard, case when row_number() over (partition by guard order by n desc, entity) <= 3 then entity else 'others' end as entity, n from u) select guard, entity, sum(n)::bigint as n from r group by guard, entity",
)
_add("set_01_union_unseen", _entries(lambda e: models.union_unseen(e.where("entry_id % 3 = 0"), e.where("entry_id % 2 = 0"), e)), CAT + ", u as (select endpoint, http_method, entry_id, 0 as source from catalog where entry_id % 3 = 0 union all select endpoint, http_method, entry_id, 1 from catalog where entry_id % 2 = 0 union all select endpoint, http_method, entry_id, 2 from catalog) select endpoint, http_method, min(source) as source, arg_min(entry_id, row(source, entry_id)) as entry_id from u group by endpoint, http_method")
_add(
    "set_03_role_changes",
    _entries(lambda e: models.role_changes(e.where("entry_id % 4 < 2"), e.where("entry_id % 4 > 1"))),
    LISTS
    + """, x as (select controller, entry_id % 4 as k, unnest(roles) as r from c), a as (select distinct controller, r from x where k < 2), b as (select distinct controller, r from x where k > 1), k as (select controller from a union select controller from b),
z as (select controller, coalesce((select string_agg(r, ',' order by r) from b where b.controller = k.controller and r not in (select a.r from a where a.controller = k.controller)), '') as added,
  coalesce((select string_agg(r, ',' order by r) from a where a.controller = k.controller and r not in (select b.r from b where b.controller = k.controller)), '') as removed from k) select *, added = '' and removed = '' as equal from z""",
)
_add("str_08_health", _spans(models.health), SPANS + ", s as (select service, op, floor((floor(epoch((select max(start_ts) from spans))) - floor(epoch(max(start_ts)))) / 3600)::bigint as age_hours from spans group by service, op) select *, case when age_hours <= 24 then 'fresh' when age_hours <= 168 then 'stale' else 'absent' end as state from s")
_add(
    "str_sessions",
    _spans(models.sessions),
    SPANS + ", l as (select user_id, start_ts, case when lag(start_ts) over w is null or start_ts - lag(start_ts) over w >= interval 6 hour then 1 else 0 end as b from spans window w as (partition by user_id order by start_ts)), s as (select user_id, start_ts, sum(b) over (partition by user_id order by start_ts) as g from l) select user_id, min(start_ts) as began, count(*) as spans from s group by user_id, g",
)
_add("ext_24_suffixes", _entries(lambda e: models.suffixes(e.select(F.concat(F.initcap(F.regexp_replace("controller", "[0-9]", "")), F.initcap("operation"), F.element_at(F.split("endpoint", "/"), -1), F.lit("RestController")).alias("name")))))
_add(
    "ext_05_permissions",
    lambda spark, d: models.permissions(frame(spark, d, "catalog").select(F.concat("controller", F.lit("-"), "entry_id").alias("path"), F.concat(F.lit("class X { "), F.when(F.col("roles").contains("MANAGER"), '@HasPermission("MANAGER") ').otherwise(""), F.when(F.col("roles").contains("ADMIN"), '@HasPermission("ADMIN") ').otherwise(""), F.when(F.col("roles") == "AUTHENTICATED", "@IsAuthenticated ").otherwise(""), F.col("operation"), F.lit("() }")).alias("content"))),
    CAT + " select controller || '-' || entry_id as path, roles as permissions from catalog",
)
_add(
    "gra_14_runtime_gap",
    _graph(lambda e, n: fixpoint.reach_counts(e.where("rel = 'CALLS'"), _roots(n.where("not runtime_hot"))).withColumnRenamed("reached", "reach").orderBy(F.desc("reach"), "root").limit(25)),
    "with recursive " + with_frames("nodes", "edges")[5:] + ", st as (select distinct src, dst from edges where rel = 'CALLS'), r(root, node) as (select id, id from nodes where type = 'VIEW' and not runtime_hot union select root, dst from r join st on node = src) select root, count(*) - 1 as reach from r group by root order by reach desc, root limit 25",
)
_add("str_02_stream_table_hits", lambda spark, d: streams.run_available(streams.table_hits(streams.spans(streams.events(spark, d)))).drop("last_seen"), SPANS + " select table_name, count(*) as hits from spans where table_name is not null group by table_name")
_add("str_window_counts", lambda spark, d: streams.run_available(streams.windowed(streams.events(spark, d))), "select date_trunc('hour', ts) as began, event_type, count(*) as n from events group by all")


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["agg_18_verdict"](spark, sf_dir)
