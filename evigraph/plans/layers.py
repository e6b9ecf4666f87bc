"""Queries over front ends and gateways made from the part table: a module of its own for each part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import frontend
from evigraph.plans import nested
from evigraph.plans.queries import _add
from evigraph.plans.scalars import made



def text_sql(template: str) -> str:
    """nested.text_sql, with dollars that Spark's SQL doesn't take for variables."""
    return nested.text_sql(template).replace("$", "' || chr(36) || '")


TEXTS = {
    "api/a<K>.ts": """export async function load<K>(id) {
  return send(`${B}/api/items<K>/${id}/rows?x=1`);
}
export const drop<K> = () => send('/api/list/<K>');
export function idle<K>() { return 1; }""",
    "composables/useA<K>.ts": """import { useB<K> } from './../composables/useB<K>';
import { idle<K> } from '@/api/a<K>';
export function useA<K>() { const b = useB<K>(); return idle<K>(b); }
export const other<K> = () => 1;""",
    "composables/useB<K>.ts": """import {
  load<K>, drop<K> as gone } from '@/api/a<K>';
export function useB<K>() { return load<K>(1); }""",
    "components/C<K>.vue": """import { useA<K> } from '@/composables/useA<K>';
import D<K> from './D<K>.vue';
useA<K>();""",
    "components/D<K>.vue": """import C<K> from './C<K>.vue';
const quiet = 1;""",
    "components/E<K>.vue": "const nothing = '/api/unknown/<K>/at/all';",
    "pages/P<K>.vue": """import C<K> from '../components/C<K>.vue';
import E<K> from '../components/E<K>.vue';
import { drop<K>, load<K> } from '@/api/a<K>';
import Q<K> from './Q<K>.vue';
const go = () => drop<K>();""",
    "pages/Q<K>.vue": "fetch('/api/list/<K>'); fetch('/api/v<V>/open')",
    "pages/R<K>.vue": "fetch('/api/list/<K>')",
    "router.ts": "const routes = [{ component: () => import('./pages/P<K>.vue') }, { path: '/q', component: () => import(\"./pages/Q<K>.vue\") }];",
}
FILES = " union all ".join(f"select p_partkey * 100 + {i} as seq, {text_sql('m<K>/client/src/' + path)} as file, {text_sql(body)} as content from part" for i, (path, body) in enumerate(TEXTS.items()))
ENDPOINTS = f"select p_partkey as seq, {text_sql('ws:<K>')} as id, {text_sql('/api/list/<K>')} as path from part"
ROUTES = f"""select p_partkey * 2 as seq, {text_sql('route:GET:/api/items<K>/:id/rows')} as id, 'GET' as method, {text_sql('/api/items<K>/:id/rows')} as path from part
union all select p_partkey * 2 + 1, {text_sql('route:GET:/api/v<V>/open')}, 'GET', {text_sql('/api/v<V>/open')} from part"""
KNOWN = f"select {text_sql('view:P<K>')} as id from part where p_size % 2 = 0"


def _front(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return frontend.front_end(*(made(spark, sf_dir, q) for q in (FILES, ENDPOINTS, ROUTES, KNOWN)))


def _rows(*rows: tuple[str, ...]) -> str:
    return " union all ".join("select " + ", ".join(x if x == "null" else text_sql(x) for x in row) + " from part" for row in rows)


_WAY = "composables/useB<K>.useB<K>→api/a<K>.load<K>"
_EDGES = _rows(
    ("view:P<K>", "ws:<K>", "api-layer", "api/a<K>.drop<K>"), ("view:P<K>", "component:C<K>", "frontend-chain", "null"), ("view:Q<K>", "ws:<K>", "api-layer", "inline-url"), ("view:Q<K>", "route:GET:/api/v<V>/open", "api-layer", "inline-url"),
    ("component:C<K>", "composable:useA<K>.useA<K>", "frontend-chain", "null"), ("component:C<K>", "component:D<K>", "frontend-chain", "null"), ("component:D<K>", "component:C<K>", "frontend-chain", "null"),
    ("composable:useA<K>.useA<K>", "route:GET:/api/items<K>/:id/rows", "api-layer", "composables/useA<K>.useA<K>→" + _WAY),
)
_add("ext_22_front_end_edges", lambda spark, d: _front(spark, d)[1], f"select * from ({_EDGES}) t(src, dst, convention, via)")
_NODES = _rows(
    ("view:P<K>", "VIEW", "P<K>", "m<K>/client/src/pages/P<K>.vue"), ("view:Q<K>", "VIEW", "Q<K>", "m<K>/client/src/pages/Q<K>.vue"), ("component:C<K>", "COMPONENT", "C<K>", "m<K>/client/src/components/C<K>.vue"),
    ("component:D<K>", "COMPONENT", "D<K>", "m<K>/client/src/components/D<K>.vue"), ("composable:useA<K>.useA<K>", "COMPOSABLE", "useA<K>.useA<K>", "m<K>/client/src/composables/useA<K>.ts"),
)
_add("ext_22_front_end_nodes", lambda spark, d: _front(spark, d)[0], f"select t.*, id not in ({KNOWN}) as minted from ({_NODES}) t(id, type, name, file)")

_CALLED = """select p_partkey as seq, case p_size % 3 when 0 then 'GET' when 1 then 'POST' else 'ALL' end as method, '/api/p' || cast(p_partkey as varchar(20)) as path,
  'server/services/s' || cast(p_size as varchar(20)) || '.ts::f,server/services/s' || cast(p_size as varchar(20)) || '.ts::g,server/repositories/r' || cast(p_size % 7 as varchar(20)) || '.ts::h' as chain,
  't' || cast(p_size % 11 as varchar(20)) as tables, case when p_size % 4 = 0 then 'select,insertInto' else 'select' end as ops, '/api/list/' || cast(p_partkey as varchar(20)) as proxies from part"""
_OWN = "select distinct 'server/repositories/r' || cast(p_size % 7 as varchar(20)) || '.ts' as file, 'own' || cast(p_size % 7 as varchar(20)) as tables, 'update' as ops from part"
_SERVICES = "select distinct 'server/services/s' || cast(p_size as varchar(20)) || case when p_size % 5 = 0 then '.test.ts' else '.ts' end as file from part union all select 'server/services/lone' || cast(p_partkey as varchar(20)) || '.ts' from part"
_ENTITIES = "select distinct 'E' || cast(p_size % 11 as varchar(20)) as id, 't' || cast(p_size % 11 as varchar(20)) as \"table\" from part where p_size % 11 < 5"
_DECLARED = "select distinct 't' || cast(p_size % 11 as varchar(20)) as name from part where p_size % 11 between 3 and 8"


def _gateway(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lists = lambda q: (df := made(spark, sf_dir, q)).select(*(F.split(c, ",").alias(c) if c in ("chain", "tables", "ops", "proxies") else F.col(c) for c in df.columns))
    files, tables, entities, endpoints, none = (made(spark, sf_dir, q) for q in (_SERVICES, _DECLARED, _ENTITIES.replace('"', "`"), ENDPOINTS, "select '' as id from part where p_size < 0"))
    return frontend.gateway(lists(_CALLED), files, tables, entities, endpoints, lists(_OWN), none)


_LIVE = f"with c as (select *, 'route:' || method || ':' || path as id, 'node:' || split_part(chain, '::', 1) as one, 'node:' || split_part(split_part(chain, ',', 3), '::', 1) as two from ({_CALLED}) where method <> 'ALL'), e as ({_ENTITIES}), d as ({_DECLARED}), o as ({_OWN}), s as ({_SERVICES})"
_TOUCH = "select two as src, tables as name, case when contains(ops, 'insert') then 'WRITES_ENTITY' else 'READS_ENTITY' end as rel from c union select two, o.tables, 'WRITES_ENTITY' from c join o on two = 'node:' || o.file"
_add(
    "ext_22_gateway_edges", lambda spark, d: _gateway(spark, d)[1],
    _LIVE + f""" select id as src, one as dst, 'CALLS' as rel, 'node-chain' as convention from c union select one, two, 'CALLS', 'node-chain' from c union select c.id, p.id, 'CALLS', 'gateway-proxy' from c join ({ENDPOINTS}) p on p.path = c.proxies
union select src, coalesce(e.id, 'table:' || t.name), rel, 'table-touch' from ({_TOUCH}) t left join e on e."table" = t.name""",
)
_add(
    "ext_22_gateway_nodes", lambda spark, d: _gateway(spark, d)[0],
    _LIVE + f""", m as (select file, 'declared' as origin from s where not contains(file, '.test.') union select substr(one, 6), 'chain' from c union select substr(two, 6), 'chain' from c),
t as (select name, 'declared' as origin from d union select name, 'touched' from ({_TOUCH}))
select id, 'ROUTE' as type, 'route' as origin, true as minted from c union all select 'node:' || file, case when contains(file, 'repositories') then 'REPOSITORY' else 'SERVICE' end, max(origin), true from m group by file
union all select 'table:' || name, 'ENTITY', min(origin), true from t where name not in (select "table" from e) group by name""",
)
_ASKED = """select 'V' || cast(p_size as varchar(20)) as component, case when p_size % 6 = 0 then 'src/part.ts' else 'src/pages/V.vue' end as file, 'GET' as method, '/api/items' || cast(p_partkey as varchar(20)) || '/7/rows?q=1' as url,
  case when p_size % 5 = 0 then 'UI_ONLY' else 'HTTP' end as category, case when p_size % 4 = 0 then 'ws:' || cast(p_partkey as varchar(20)) end as mapped from part"""
_add(
    "ext_22_interactions", lambda spark, d: frontend.interactions(made(spark, d, _ASKED), made(spark, d, ROUTES)),
    "select 'view:V' || p_size as src, case when p_size % 4 = 0 then 'ws:' || p_partkey else 'route:GET:/api/items' || p_partkey || '/:id/rows' end as dst, case when p_size % 4 = 0 then 'frontend-http' else 'frontend-gateway' end as convention from part where p_size % 5 <> 0 and p_size % 6 <> 0",
)
