"""Queries over facts of source code. The files are made by SQL from the part table, so that the SQL for the comparison can say from the
same rows what must be found in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.operators import code, evidence, extract, matching, models, runtime, spans, walks
from evigraph.plans.adapters import FRAMES, frame, with_frames
from evigraph.plans.queries import GRAPH, LISTS, SPANS, _add, _entries, _graph, _spans
from evigraph.plans.scalars import made

K, Z, N = "cast(p_partkey as varchar(20))", "cast(p_size as varchar(20))", " || chr(10) || "
V, O, D, Q = "cast(p_size % 5 as varchar(20))", "cast(p_size % 7 as varchar(20))", "'\"'", "''''"
#: Router files, and the files that mount every third of them.
ROUTERS = (
    f"""select 'server/r' || {K} || '.ts' as path, 'const router = Router();'{N}'// router.get("/no", nothing);'{N}'router.get("/items' || {O} || '/:id", auth, find' || {Z} || ');'{N}'router.post(' || {Q} || '/items' || {Q} || ', save' || {Z} || ');'{N}'function find' || {Z} || '() {{'{N}'  return db.select().from(t' || {V} || ');'
 {N}'}}'{N}'async function save' || {Z} || '(x) {{'{N}'  // db.delete(t9)'{N}'  db.insert(t' || {V} || ').values(x);'{N}'  fetch("http://java/app/op' || {O} || '.v1");'{N}'}}' as content from part
union all select 'server/main' || {K} || '.ts', 'import r from "./r' || {K} || '"'{N}'app.use("/api/k' || {V} || '", r);' from part where p_partkey % 3 = 0"""
)
SCHEMAS = f"""select 'server/schema' || {Z} || '.ts' as path, 'import x from "y";'{N}'export const t' || {Z} || ' = pgTable("tab_' || {Z} || '", {{'{N}'  id: serial("id"),'{N}'  name: text("full_name_' || {O} || '"),'{N}'}});' as content from (select distinct p_size from part) as p"""
_files = lambda sql: lambda spark, d: made(spark, d, sql)
_PREFIX = f"case when p_partkey % 3 = 0 then '/api/k' || {V} else '' end"
_add(
    "ext_09_router_routes", lambda spark, d: spans.routes(made(spark, d, ROUTERS)).select("path", "no", "http_method", "endpoint", "handler"),
    f"select 'server/r' || {K} || '.ts' as path, 3 as no, 'GET' as http_method, {_PREFIX} || '/items' || {O} || '/:id' as endpoint, 'find' || {Z} as handler from part union all select 'server/r' || {K} || '.ts', 4, 'POST', {_PREFIX} || '/items', 'save' || {Z} from part",
)


def _schema(spark: SparkSession, d: str) -> DataFrame:
    return spans.schema_tables(made(spark, d, SCHEMAS))


_add("ext_12_schema_tables", _schema, f"select distinct 'server/schema' || {Z} || '.ts' as path, 't' || {Z} as variable, 'tab_' || {Z} as \"table\", 'id,full_name_' || {O} as columns from part")
_add("ext_10_handler_tables", lambda spark, d: spans.handler_tables(made(spark, d, ROUTERS), _schema(spark, d)), f"with t as (select distinct p_size as z from part) select 'server/r' || {K} || '.ts' as path, 'find' || {Z} as handler, 'tab_' || {V} as \"table\", 'read' as access from part where p_size % 5 in (select z from t) union all select 'server/r' || {K} || '.ts', 'save' || {Z}, 'tab_' || {V}, 'write' from part where p_size % 5 in (select z from t)")
_add("ext_11_proxies", lambda spark, d: code.proxies(made(spark, d, ROUTERS)), f"select 'server/r' || {K} || '.ts' as path, '/app/op' || {O} || '.v1' as target from part")


def _routes(spark: SparkSession, d: str) -> DataFrame:
    return spans.routes(made(spark, d, ROUTERS))


_add(
    "ext_31_route_entries",
    lambda spark, d: models.union_unseen(*(_routes(spark, d).groupBy("endpoint", "http_method").agg(F.min("path").alias("entry_id")).where(w) for w in ("http_method = 'GET'", "true"))),
    f"with r as (select {_PREFIX} || '/items' || {O} || '/:id' as endpoint, 'GET' as http_method, 'server/r' || {K} || '.ts' as p from part union all select {_PREFIX} || '/items', 'POST', 'server/r' || {K} || '.ts' from part) select endpoint, http_method, case when http_method = 'GET' then 0 else 1 end as source, min(p) as entry_id from r group by endpoint, http_method",
)
_add("ext_25_route_anchors", lambda spark, d: code.route_anchors(_routes(spark, d).select(F.col("path").alias("file"), "endpoint")), f"with r as (select p_partkey as f, case when p_partkey % 3 = 0 then 'k' || {V} else 'items' || {O} end as a from part union all select p_partkey, case when p_partkey % 3 = 0 then 'k' || {V} else 'items' end from part) select a as anchor, count(distinct f) as files from r group by a having count(distinct f) >= 5 order by files desc, anchor limit 12")
_CALLS = "select 'f' || cast(p_partkey % 40 as varchar(20)) as file, 'g' || cast(p_size % 6 as varchar(20)) as src, 'g' || cast((p_size + 1) % 6 as varchar(20)) as dst from part where p_partkey % 4 <> 0"
_IMPORTS = "select distinct 'f' || cast(p_partkey % 40 as varchar(20)) as file, 'g' || cast(p_partkey % 40 % 6 as varchar(20)) as name, 'f' || cast((p_partkey % 40 * 3 + 1) % 40 as varchar(20)) as target from part"
_ROOTS = "select distinct '/e' || cast(p_partkey % 25 as varchar(20)) as endpoint, 'f' || cast(p_partkey % 25 as varchar(20)) as file, 'g' || cast(p_partkey % 5 as varchar(20)) as handler from part"
_add(
    "ext_29_call_chains", lambda spark, d: code.call_chains(*(made(spark, d, q) for q in (_ROOTS, _CALLS, _IMPORTS))),
    f"""with recursive c as ({_CALLS}), i as ({_IMPORTS}), q as ({_ROOTS}), e as (select distinct c.file as sf, c.src, coalesce(i.target, c.file) as df, c.dst from c left join i on c.file = i.file and c.dst = i.name),
w(endpoint, file, fn, depth) as (select endpoint, file, handler, 0 from q union select endpoint, df, dst, depth + 1 from w join e on w.file = sf and w.fn = src where depth < 8), m as (select q.endpoint, q.file as rf, q.handler from q)
select endpoint, file, fn as "function", min(depth)::bigint as depth from w group by endpoint, file, fn""",
)

_METAS = "select distinct 'A' || cast(p_size as varchar(20)) as annotation, 'A' || cast(p_size * 2 % 51 as varchar(20)) as meta from part where p_size % 3 <> 0"
_add("ext_02_annotation_closure", lambda spark, d: code.annotation_closure(made(spark, d, _METAS)), f"with recursive m as ({_METAS}), n as (select annotation as a from m union select meta from m), r(annotation, carries) as (select a, a from n union select r.annotation, meta from r join m on carries = m.annotation) select * from r")
_CLASSES = "select p_partkey as cls, case when p_partkey % 5 > 0 then p_partkey - p_partkey % 5 end as parent, case when p_partkey % 10 = 0 then '/base' || cast(p_partkey as varchar(20)) when p_partkey % 5 = 2 then '/own' else '' end as base_path from part"
_add("ext_03_inherited_paths", lambda spark, d: code.inherited_paths(made(spark, d, _CLASSES)), f"with c as ({_CLASSES}) select c.cls, case when c.base_path <> '' then c.base_path else nullif(p.base_path, '') end as base_path from c left join c as p on c.parent = p.cls")
WS = f"""select 'src/main/java/shop/' || case p_size % 3 when 0 then 'findOrders' when 1 then 'createBox' else 'goOn' end || {V} || '/v' || cast(1 + p_size % 2 as varchar(20)) || '/C' || {K} || '.java' as path, case when p_size % 4 = 0 then 'class X' else '@Ws(1)'{N}'class X' end as content from part"""
_WSOP = f"case p_size % 3 when 0 then 'findOrders' when 1 then 'createBox' else 'goOn' end || {V}"
WSROWS = f"with e as (select '/app/' || {_WSOP} || '.v' || cast(1 + p_size % 2 as varchar(20)) as endpoint, 'C' || {K} as cls, 'src/main/java/shop/' || {_WSOP} || '/v' || cast(1 + p_size % 2 as varchar(20)) || '/C' || {K} || '.java' as path from part where p_size % 4 <> 0), f as (select endpoint, arg_min(cls, path) as cls, min(path) as path from e group by endpoint)"
_add("ext_04_convention_endpoints", lambda spark, d: code.convention_endpoints(made(spark, d, WS)), WSROWS + " select * from f")
_WSNODES = f"select 'S' || {K} as id, 'SERVICE' as type, 'C' || {K} as class_name from part union all select 'E' || cast(n_nationkey as varchar(20)), 'ENTITY', case n_nationkey % 3 when 0 then 'Orders' when 1 then 'Box' else 'Other' end || cast(n_nationkey % 5 as varchar(20)) from nation"
_add(
    "ext_08_convention_graph", lambda spark, d: code.augmented(code.convention_endpoints(made(spark, d, WS)), made(spark, d, _WSNODES)),
    WSROWS + f", n as ({_WSNODES}) select distinct 'wsv1:' || endpoint as src, id as dst, 'CALLS' as rel from f join n on n.type = 'SERVICE' and n.class_name = f.cls union select 'wsv1:' || endpoint, id, case when endpoint like '%find%' then 'READS_ENTITY' else 'WRITES_ENTITY' end from f join n on n.type = 'ENTITY' and lower(class_name) = lower(regexp_extract(endpoint, '/app/(find|create)(.*)\\.v', 2))",
)
_add("ext_07_gateway_prefixes", lambda spark, d: matching.gateway_prefixes(made(spark, d, ROUTERS)), f"select distinct '/api/k' || {V} as prefix from part where p_partkey % 3 = 0")
COLUMNS = f"""select 'E' || {K} || '.java' as path, 'class E {{'{N}'  @Column(name = "col_' || {Z} || '")'{N}'  @NotNull'{N}''{N}'  private String field' || {V} || ';'{N}'  @Column(name = "lost")'{N}'  void method() {{'{N}'  private int plain;'{N}'}}' as content from part"""
_add("ext_06_entity_columns", lambda spark, d: extract.entity_columns(made(spark, d, COLUMNS)), f"select 'E' || {K} || '.java' as path, 'field' || {V} as field, 'col_' || {Z} as \"column\" from part")
DISPATCH = f"""select 'a/X' || {K} || '.java' as path, 'public class X' || {K} || ' implements ActionExecutor {{'{N}' public RuleActionType getActionType() {{'{N}'  return RuleActionType.ACT_' || {V} || ';'{N}' }}'{N}'}}' as content from part where p_size % 5 <> 3
union all select 'a/RuleActionType.java', 'public enum RuleActionType {{ ACT_0, ACT_1,'{N}' ACT_2, ACT_3, ACT_4; int x; }}' from region where r_regionkey = 0"""
_add("ext_13_dispatch", lambda spark, d: extract.rule_dispatch(made(spark, d, DISPATCH))[0], f"select 'ACT_' || {V} as action, arg_min('X' || {K}, 'a/X' || {K} || '.java') as executor, min('a/X' || {K} || '.java') as path from part where p_size % 5 <> 3 group by 1")
_add("ext_13_unmapped", lambda spark, d: extract.rule_dispatch(made(spark, d, DISPATCH))[1], "with v as (select unnest([0, 1, 2, 3, 4]) as v) select 'ACT_' || v as action from v where v = 3 or v not in (select p_size % 5 from part)")
EVENTS = f"""select 'L' || {K} || '.java' as path, 'class L {{'{N}' @EventListener'{N}''{N}' public void on' || {Z} || '(x.Ev' || {V} || ' e) {{'{N}'  if (e.getTriggerType() != RuleTriggerType.T_' || {V} || ') return;'{N}'  b.triggerType(T_OUT_' || {O} || ')'{N}'  b.triggerType(T_OUT_' || {O} || ')'{N}' }}' as content from part"""
_add("ext_14_listeners", lambda spark, d: extract.event_listeners(made(spark, d, EVENTS)), f"select 'L' || {K} || '.java' as path, 'L' || {K} as class, 'on' || {Z} as method, 'Ev' || {V} as event, 'T_' || {V} as trigger, cast(null as varchar) as entity, 'guarded' as routing, 4 as line from part")
_add("ext_14_publishers", lambda spark, d: extract.event_publishers(made(spark, d, EVENTS)), f"select 'L' || {K} || '.java' as path, 'L' || {K} as class, 'on' || {Z} as method, 'T_OUT_' || {O} as trigger, 6 as line from part")
RULES = [{"id": "listeners", "pattern": r"@EventListener", "glob": ".java"}, {"id": "wide", "pattern": r"\bclass\b"}, {"id": "rare", "pattern": "on49\\("}, {"id": "cited", "pattern": r"Ev(\d)", "groups": 1, "cited": ("nowhere", 1, 2), "min_sites": 1, "path": "/ev/$1", "method": "GET"}]
_add("ext_26_rule_verdicts", lambda spark, d: extract.verify_rules(made(spark, d, EVENTS), RULES), "with n as (select count(*) as n, count(*) filter (where p_size = 49) as r from part) select 'listeners' as rule, n as sites, n as files, 'too-wide' as verdict from n union all select 'wide', n, n, 'too-wide' from n union all select 'rare', r, r, case when r < 3 then 'few-sites' else 'admitted' end from n union all select 'cited', n, n, 'too-wide' from n")
_add("ext_27_rule_endpoints", lambda spark, d: extract.rule_endpoints(made(spark, d, EVENTS), RULES).drop("line"), f"select 'GET' as http_method, '/ev/' || {V} as endpoint, 'cited' as rule, min('L' || {K} || '.java') as source_file from part group by {V}")
_add("ext_32_merged_rules", lambda spark, d: extract.merge_rules(made(spark, d, "select distinct p_size % 10 as id, 'old' as origin from part"), made(spark, d, "select distinct p_size % 15 as id, 'mined' as origin from part")), "select distinct p_size % 10 as id, 'old' as origin from part union all select distinct p_size % 15, 'mined' from part where p_size % 15 not in (select p_size % 10 from part)")
LINES = f"""select 'A' || {K} || case when p_size % 2 = 0 then '.java' else '.ts' end as file, p_partkey as no, case p_size % 5 when 0 then 'public class C' || {Z} || ' {{ // class no' when 1 then 'const c' || {Z} || ' = "class in text";' when 2 then ' private final int f' || {Z} || ' = 3;' when 3 then 'export async function g' || {Z} || '(a) {{' else ' * class inComment' end as line from part"""
_add("ext_15_declarations", lambda spark, d: code.declarations(made(spark, d, LINES)), f"with l as ({LINES}), s as (select *, suffix(file, '.java') as j, (no)::bigint as k from l), p as (select 'A' || {K} || case when p_size % 2 = 0 then '.java' else '.ts' end as file, p_partkey as no, p_size as z from part) select file, no, case z % 5 when 0 then 'class' when 1 then 'const' when 2 then 'field' else 'method' end as kind, case z % 5 when 0 then 'C' when 1 then 'c' when 2 then 'f' else 'g' end || z as name from p where z % 5 = 0 or z % 5 in (1, 3) and not suffix(file, '.java') or z % 5 = 2 and suffix(file, '.java')")
ADRS = f"""select 'adr/' || lpad({K}, cast(greatest(4, length({K})) as int), '0') || '-x.md' as path, '# Decision ' || {Z}{N}'Status: ' || case when p_size % 2 = 0 then 'Accepted' else 'draft' end{N}'uses OrderBox' || {V} || ' and `OrderBox' || {V} || '` there'{N}'see Invoice' || {O} || '.java and InvoiceLine' as content from part"""
_add("ext_16_decision_index", lambda spark, d: code.decision_index(made(spark, d, ADRS), ("Status",)), f"select lpad({K}, cast(greatest(4, length({K})) as int), '0') as id, 'Decision ' || {Z} as title, case when p_size % 2 = 0 then 'accepted' else 'draft' end as status, array_to_string(list_sort(list_filter(['Decision', 'InvoiceLine', case when p_size % 2 = 0 then 'Accepted' end, 'OrderBox' || {V}], lambda x: x is not null)), ',') as symbols from part")
CITED = f"select lpad({K}, cast(greatest(4, length({K})) as int), '0') as id, 'OrderBox' || {V} as symbol, 'backtick' as citation, 3 as no from part union all select lpad({K}, cast(greatest(4, length({K})) as int), '0'), 'Invoice' || {O}, 'file', 4 from part union all select lpad({K}, cast(greatest(4, length({K})) as int), '0'), 'InvoiceLine', 'prose', 4 from part union all select lpad({K}, cast(greatest(4, length({K})) as int), '0'), 'Decision', 'prose', 1 from part union all select lpad({K}, cast(greatest(4, length({K})) as int), '0'), 'Accepted', 'prose', 2 from part where p_size % 2 = 0"
_cited = lambda spark, d: code.citations(made(spark, d, ADRS), stopwords=("Status",))
_add("ext_17_citations", _cited, CITED)
_ADRNODES = "select 'N' || cast(n_nationkey as varchar(20)) as id, 'OrderBox' || cast(n_nationkey % 7 as varchar(20)) as class_name from nation"
_add("gra_26_linked_decisions", lambda spark, d: code.linked_decisions(_cited(spark, d), made(spark, d, _ADRNODES)), f"with c as ({CITED}), n as ({_ADRNODES}) select distinct c.id, symbol, n.id as node from c join n on class_name = symbol")
JAVA = f"""select 'J' || {K} || '.java' as path, '/* class Fake {{ */ package shop.p' || {V} || ';'{N}'// class No'{N}'public ' || case when p_size % 3 = 0 then 'interface I' || {K} || ' {{' else 'class J' || {K} || ' extends Base' || {O} || ' implements A<' || 'T>, B' || {O} || ' {{' end as content from part"""
_add("ext_33_java_types", lambda spark, d: spans.java_types(made(spark, d, JAVA)).select("fqn", "kind", "parent", F.array_join("interfaces", ",").alias("interfaces")), f"select 'shop.p' || {V} || '.' || case when p_size % 3 = 0 then 'I' else 'J' end || {K} as fqn, case when p_size % 3 = 0 then 'interface' else 'class' end as kind, case when p_size % 3 <> 0 then 'Base' || {O} end as parent, case when p_size % 3 <> 0 then 'A,B' || {O} else '' end as interfaces from part")

#: Occurrences of symbols in indexed documents; definitions are every fifth.
OCC = "select cast(user_id as varchar(20)) as doc, 's' || cast(event_id % 23 as varchar(20)) as symbol, event_id as p, event_id % 400 as line, event_id % 5 = 0 as is_def from events"
DEFS = "select cast(user_id as varchar(20)) as doc, 'd' || cast(event_id as varchar(20)) as symbol, event_id as start, case when event_id % 10 = 0 then event_id + 900 end as end_at from events where event_id % 5 = 0"
IMPLS = "select 's' || cast(n_nationkey as varchar(20)) as symbol, 'impl' || cast(n_nationkey % 4 as varchar(20)) as impl from nation where n_nationkey % 3 = 0"
_defs = lambda spark, d: made(spark, d, DEFS).withColumnRenamed("end_at", "end")
BODY = f"o as ({OCC}), q as ({DEFS}), b as (select doc, symbol, start, coalesce(end_at, lead(start) over (partition by doc order by start, symbol), 4611686018427387904) as e from q)"
OWN = ", ow as (select o.doc, p, o.symbol, o.line, arg_max(b.symbol, row(b.start, -b.e, b.symbol)) as src from o join b on o.doc = b.doc and p >= b.start and p < b.e where not is_def group by o.doc, p, o.symbol, o.line)"
_add("win_02_bodies", lambda spark, d: code.bodies(_defs(spark, d)).select("doc", "symbol", "start", F.col("end").alias("ends")), f"with {BODY} select doc, symbol, start, e as ends from b")
_add("win_03_next_symbols", lambda spark, d: code.next_symbol(made(spark, d, OCC)).drop("next_line"), f"with o as ({OCC}) select doc, p, symbol, lead(symbol) over (partition by doc order by p, symbol) as next from o")
_add(
    "ext_18_call_edges", lambda spark, d: code.call_edges(made(spark, d, OCC), _defs(spark, d), made(spark, d, IMPLS)),
    f"with {BODY}{OWN}, m as ({IMPLS}), e as (select src, symbol as dst, 'compiler' as r from ow union all select src, impl, 'interface-impl' from ow join m on ow.symbol = m.symbol) select src, dst, min(r) as resolution from e where src <> dst group by src, dst",
)
OCC2 = "select cast(user_id % 40 as varchar(20)) as doc, case event_id % 4 when 0 then 'read:q' when 1 then 'write:q' else 's' || cast(event_id % 23 as varchar(20)) end as symbol, event_id as p, event_id % 7000 as lineno, event_id % 5 = 0 as is_def from events"
_TABS = "select 's' || cast(n_nationkey as varchar(20)) as symbol, 'tab' || cast(n_nationkey as varchar(20)) as tab from nation"
_occ2 = lambda spark, d: made(spark, d, OCC2).withColumn("line", F.floor(F.col("lineno") / 200).cast("long")).drop("lineno")
DEFS2 = DEFS.replace("cast(user_id as varchar(20)) as doc", "cast(user_id % 40 as varchar(20)) as doc")
_add(
    "ext_19_data_access", lambda spark, d: code.data_access(_occ2(spark, d), made(spark, d, DEFS2).withColumnRenamed("end_at", "end"), made(spark, d, _TABS).withColumnRenamed("tab", "table")),
    f"""with o as (select doc, symbol, p, lineno // 200 as line, is_def from ({OCC2})), q as ({DEFS2}), b as (select doc, symbol, start, coalesce(end_at, lead(start) over (partition by doc order by start, symbol), 4611686018427387904) as e from q), t as ({_TABS}),
n as (select *, lead(symbol) over w as nx, lead(line) over w as nl from o window w as (partition by doc order by p, symbol)), h as (select doc, p, split_part(n.symbol, ':', 1) as access, tab from n join t on nx = t.symbol where nl = line and regexp_matches(n.symbol, '^(read|write):')),
ow as (select h.doc, h.p, access, tab, arg_max(b.symbol, row(b.start, -b.e, b.symbol)) as src from h join b on h.doc = b.doc and h.p >= b.start and h.p < b.e group by all) select distinct src, tab as "table", access from ow""",
)
BEANS = "select 'I' || cast(p_size as varchar(20)) as interface, 'C' || cast(p_partkey % 9 as varchar(20)) as concrete, p_partkey % 17 = 0 as is_primary, p_partkey % 41 = 0 as opaque from part where p_partkey % 6 = 0 or p_size > 40 and p_partkey % 2 = 0"
SUPERS = "select distinct 'I' || cast(p_size as varchar(20)) as cls, 'P' || cast(p_size % 20 as varchar(20)) as parent from part where p_size % 2 = 0"
_add(
    "ext_20_wiring", lambda spark, d: code.wiring(made(spark, d, BEANS), made(spark, d, SUPERS)),
    f"""with b as ({BEANS}), s as ({SUPERS}), u as (select distinct interface as i, interface as port from b union select distinct interface, parent from b join s on interface = cls), x as (select port, b.* from b join u on interface = i),
g as (select port, count(distinct concrete) filter (where is_primary) as np, min(concrete) filter (where is_primary) as pr, count(distinct concrete) as nc, min(concrete) as one, bool_or(opaque) as op from x group by port)
select port as interface, case when np = 1 then pr else one end as concrete, case when np = 1 then 'primary' else 'single' end as reason from g where np = 1 or np = 0 and nc = 1 and not op""",
)
_VROUTES = "select '/p' || cast(p_size as varchar(20)) as path, 'V' || cast(p_size % 30 as varchar(20)) || '.vue' as component from part where p_size % 3 = 0"
_VIMPORTS = "select distinct 'V' || cast(p_size % 30 as varchar(20)) || '.vue' as src, 'V' || cast((p_size % 30 + 5) % 37 as varchar(20)) || '.vue' as dst from part where p_size % 4 <> 0"
_VFILES = "select 'V' || cast(p_size as varchar(20)) || '.vue' as path from part union all select 'x.ts' from region"
_add(
    "ext_23_routed_pages", lambda spark, d: code.routed_pages(made(spark, d, _VROUTES), made(spark, d, _VIMPORTS), made(spark, d, _VFILES)),
    f"with recursive r as ({_VROUTES}), i as ({_VIMPORTS}), f as (select distinct path from ({_VFILES}) where suffix(path, '.vue')), h(p) as (select component from r union select dst from h join i on p = src), g as (select component, min(path) as route from r group by component) select f.path as page, case when route is not null then 'routed' when f.path in (select p from h) then 'reached' else 'orphan' end as kind, route from f left join g on f.path = component",
)
_FEDGES = "select 'm' || cast(l_suppkey % 60 as varchar(20)) as src_file, 'm' || cast(l_partkey % 80 as varchar(20)) as dst_file, case l_linenumber % 3 when 0 then 'route' else 'local' end as kind, case when l_linenumber % 2 = 0 then 'compiler' else 'interface-impl' end as resolution from lineitem where l_orderkey % 11 = 0"
_MODS = "select 'm' || cast(p_size as varchar(20)) as file, p_size % 9 = 0 as external from (select distinct p_size from part) as p"
_add(
    "ext_30_file_edges", lambda spark, d: code.aggregated_edges(made(spark, d, _FEDGES), made(spark, d, _MODS), 300),
    f"""with e as ({_FEDGES}), m as (select file from ({_MODS}) where not external), o as (select src_file as src, dst_file as dst, min(resolution) as resolution, min(kind) filter (where kind <> 'local') as k from e where src_file in (select file from m) and dst_file in (select file from m) and src_file <> dst_file group by all)
select src, dst, coalesce(k, 'local') as kind, resolution, row_number() over (order by k is null, src, dst) <= 300 as kept from o""",
)

_add(
    "gra_25_sequence", _graph(lambda e, n: code.sequence_steps(walks.mechanism(e, n.where("type = 'VIEW'").select("id")))),
    "with recursive " + with_frames("nodes", "edges")[5:] + """, f as (select src, dst, rel, arg_min(row(coalesce(observed, false)), seq) as p from edges where rel <> 'ASSOCIATES' group by src, dst, rel),
r(root, node, depth) as (select id, id, 0 from nodes where type = 'VIEW' union select root, dst, depth + 1 from r join f on node = src where depth < 5), l as (select root, node, min(depth) as depth from r group by root, node),
s as (select root, split_part(src, ':', 1) as a, split_part(dst, ':', 1) as b, case rel when 'READS_ENTITY' then 'read' when 'WRITES_ENTITY' then 'write' else 'call' end as m, row_number() over (partition by root order by depth, src, not p[1], dst, rel) as o from l join f on node = src),
t as (select *, case when lag(a) over w = a and lag(b) over w = b and lag(m) over w = m then 0 else 1 end as n from s where o <= 60 window w as (partition by root order by o)), u as (select *, sum(n) over (partition by root order by o) as run from t)
select root, min(o) as "order", min(a) as participant_from, min(b) as participant_to, min(m) as message, count(*) as times from u group by root, run""",
)
_add(
    "gra_23_statements", _graph(lambda e, n: code.statements(walks.narrative(e.withColumn("refuted", F.expr("weight = 6")), n, n.where("type = 'ENTITY' and sensitive").select("id")), 2)),
    "with recursive " + GRAPH[5:] + """, r(node) as (select id from nodes where type = 'ENTITY' and sensitive union select src from r join (select distinct src, dst from ex) on dst = node),
w as (select src, dst, rel, seq, case when weight = 6 and m <> 'RUNTIME_OBSERVED' then 'refuted' when m in ('RUNTIME_OBSERVED', 'STATIC_PROVEN') then 'walkable' end as verdict from ec where src in (select node from r) and dst in (select node from r)),
v as (select src, dst, rel, arg_min(verdict, seq) as verdict from w where verdict is not null group by src, dst, rel), g as (select src as symbol, count(*) filter (where verdict = 'walkable') as walkable, count(*) filter (where verdict = 'refuted') as refuted from v group by src)
select *, case when walkable < 2 then 'abstained' else symbol || ' reaches ' || walkable || ' proven target(s)' end as statement from g""",
)
_CHANGED = "select distinct 'src/app/' || case p_size % 4 when 0 then 'OrderService' when 1 then 'BuildingController' when 2 then 'Machin' else 'Unknown' || cast(p_size as varchar(20)) end || '.java' as file from part"


def _file_impact(spark: SparkSession, d: str) -> DataFrame:
    files = made(spark, d, _CHANGED).select("file", matching.candidate_symbols(F.col("file")).alias("candidates"))
    symbols = frame(spark, d, "catalog").select(F.explode(F.split("entities", ",")).alias("symbol"), "endpoint").where("symbol <> ''")
    return code.impact_of_files(files, symbols)


_add(
    "imp_03_file_impact", _file_impact,
    LISTS + f", q as ({_CHANGED}), s as (select distinct lower(unnest(entities)) as s, endpoint from c) select distinct file, endpoint, 'exact' as via from q, s where file like '%OrderService%' and s = 'order' or file like '%BuildingController%' and s = 'building' union all select distinct file, endpoint, 'part' from q, s where file like '%/Machin.%' and contains(s, 'machin')",
)
_USES = "select 'h' || cast(o_orderkey % 90 as varchar(20)) as symbol, '/e' || cast(o_custkey as varchar(20)) as endpoint from orders where o_orderkey % 3 = 0"
_REMOVED = f"select 'f' || {V} as file, 'method' as kind, 'h' || {Z} as name, 'int h' || {Z} || '(int a) {{' as line from part"
_ADDED = f"select 'f' || {V} as file, 'method' as kind, case when p_size % 3 = 0 then 'h' || {Z} else 'n' || {Z} end as name, case p_size % 3 when 0 then 'int h' || {Z} || '(long b) {{' when 1 then 'int n' || {Z} || '(int a) {{' else 'void n' || {Z} || '() {{' end as line from part where p_size % 4 <> 1"


def _broken(spark: SparkSession, d: str) -> DataFrame:
    added = made(spark, d, _ADDED).distinct()
    return extract.broken_declarations(made(spark, d, _REMOVED).distinct(), added, added.select("file", "line"))


BROKEN = f"with p as (select distinct 'f' || {V} as file, p_size as z from part), b as (select file, 'method' as kind, 'h' || z as name, case when z % 4 <> 1 and z % 3 = 0 then 'signature-changed' when exists (select 1 from p q where q.file = p.file and q.z % 4 <> 1 and q.z % 3 = 1) then 'renamed' else 'removed' end as change, case when not (z % 4 <> 1 and z % 3 = 0) then (select min('n' || q.z) from p q where q.file = p.file and q.z % 4 <> 1 and q.z % 3 = 1) end as \"into\" from p)"
_add("imp_04_broken_declarations", _broken, BROKEN + " select * from b")
_add("imp_05_breaking_reach", lambda spark, d: code.breaking_reach(_broken(spark, d).select(F.col("name").alias("symbol"), "kind", "change"), made(spark, d, _USES)), BROKEN + f", u as (select distinct symbol, endpoint from ({_USES})), n as (select symbol, count(*) as n from u group by symbol) select name as symbol, change, coalesce(n, 0) as endpoints, case when n > 0 then 'alert' else 'suppressed-dead' end as verdict from b left join n on name = n.symbol")
_KNOWN = f"select 'repo/src/m' || {V} || '/F' || {Z} || '.java' as path from part"
_SEEN = f"select case p_size % 4 when 0 then './src/m' || {V} || '/F' || {Z} || '.java' when 1 then 'x/repo/src/m' || {V} || '/F' || {Z} || '.java' when 2 then 'rc/m' || {V} || '/F' || {Z} || '.java' else '/new/F' || {Z} || '.java' end as file from part"
_add("imp_11_unknown_files", lambda spark, d: code.unknown_files(made(spark, d, _SEEN), made(spark, d, _KNOWN)), f"select distinct file from ({_SEEN}) where file like 'rc/%' or file like '/new/%'")
