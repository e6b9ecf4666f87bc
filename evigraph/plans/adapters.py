"""Frames of the engine derived from the star-schema tables, as SQL that Spark and DuckDB both run.

Lists are comma-joined strings here; split_list() makes arrays of them. Every frame that feeds a first-wins operator has a
`seq` string that orders its rows totally.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE_SEQ = """lpad(cast(l_orderkey as varchar(20)), 12, '0') || '-' || lpad(cast(l_linenumber as varchar(20)), 3, '0') || '-' || lpad(cast(l_partkey as varchar(20)), 12, '0')
  || '-' || lpad(cast(l_suppkey as varchar(20)), 10, '0') || '-' || cast(cast(l_shipdate as date) as varchar(20)) || '-' || lpad(cast(cast(floor(l_extendedprice * 100 + 0.5) as bigint) as varchar(20)), 14, '0')"""
_PROVENANCE = """case when l_returnflag = 'A' then 'compiler' when l_returnflag = 'R' and l_linenumber % 2 = 0 then 'syntactic-declared' end as resolution,
  l_returnflag = 'N' and l_linenumber % 3 = 0 as synthetic, l_returnflag = 'R' and l_linenumber % 2 = 1 as observed, l_linenumber % 7 = 0 as config_proven, l_linenumber as weight"""

FRAMES = {
    "nodes": """
select 'VIEW:' || cast(c_custkey as varchar(20)) as id, 'VIEW' as type, 'VIEW:' || c_mktsegment as class_key, false as sensitive, 'route' as entry_point, c_custkey % 4 = 0 as runtime_hot, c_custkey as hits from customer
union all select 'CONTROLLER:' || cast(o_orderkey as varchar(20)), 'CONTROLLER', 'CONTROLLER:' || cast(o_custkey % 97 as varchar(20)), false, cast(null as varchar(20)), o_orderkey % 9 = 0, o_orderkey % 1000 from orders
union all select 'SERVICE:' || cast(s_suppkey as varchar(20)), 'SERVICE', 'SERVICE:' || cast(s_nationkey as varchar(20)), false, cast(null as varchar(20)), s_suppkey % 5 = 0, s_suppkey from supplier
union all select 'ENTITY:' || cast(p_partkey as varchar(20)), 'ENTITY', 'ENTITY:' || p_brand, p_size % 10 = 0, cast(null as varchar(20)), false, 0 from part where p_size <= 45""",
    "edges": f"""
select 'VIEW:' || cast(o_custkey as varchar(20)) as src, 'CONTROLLER:' || cast(o_orderkey as varchar(20)) as dst, 'CALLS' as rel,
  case when o_orderstatus = 'F' then 'compiler' when o_orderstatus = 'O' then 'convention-name' end as resolution, false as synthetic, o_orderkey % 10 = 0 as observed, false as config_proven, 1 as weight,
  lpad(cast(o_orderkey as varchar(20)), 12, '0') as seq from orders
union all select 'CONTROLLER:' || cast(l_orderkey as varchar(20)), 'SERVICE:' || cast(l_suppkey as varchar(20)), 'CALLS', {_PROVENANCE}, {_LINE_SEQ} from lineitem
union all select 'SERVICE:' || cast(l_suppkey as varchar(20)), 'ENTITY:' || cast(l_partkey as varchar(20)), case when l_linestatus = 'O' then 'WRITES_ENTITY' else 'READS_ENTITY' end, {_PROVENANCE}, {_LINE_SEQ} from lineitem
union all select 'ENTITY:' || cast(l_partkey as varchar(20)), 'SERVICE:' || cast(l_suppkey as varchar(20)), 'ASSOCIATES', {_PROVENANCE}, {_LINE_SEQ} from lineitem where l_partkey % 50 = 0""",
    "catalog": """
select o_orderkey as entry_id, '/api/v1/' || lower(c_mktsegment) || 's/' || lower(replace(n_name, ' ', '-')) || '/' || cast(o_orderkey % 40 as varchar(20)) as endpoint,
  case o_orderkey % 5 when 0 then 'GET' when 1 then 'POST' when 2 then 'PUT' when 3 then 'PATCH' else 'DELETE' end as http_method,
  'Controller' || cast(o_custkey % 97 as varchar(20)) as controller, case o_orderkey % 6 when 0 then 'createOrder' when 1 then 'findOrders' when 2 then 'updateOrder' when 3 then 'deleteOrder' when 4 then 'approveOrder' else 'listInvoices' end as operation,
  case when o_orderpriority like '1%' then 'ADMIN,MANAGER' when o_orderpriority like '2%' then 'MANAGER' when o_orderpriority like '3%' then 'AUTHENTICATED' else '' end as roles,
  case when o_orderkey % 37 = 0 then 'Role' when o_orderkey % 7 = 0 then '' when o_orderkey % 3 = 0 then c_mktsegment || ',Order' else c_mktsegment end as entities,
  case when o_orderkey % 11 = 0 then 'password,email' when o_orderkey % 13 = 0 then 'email' else '' end as sensitive_fields, cast(o_orderkey * 7 % 101 as int) as criticality
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "spans": """
select cast(user_id as varchar(20)) || '/' || cast(cast(ts as date) as varchar(20)) as trace_id, event_id as span_id, case when event_id % 3 = 0 then 'gateway' else 'backend' end as service, event_type as op, ts as start_ts, user_id,
  case when event_id % 4 <> 0 then 'T' || cast(event_id % 17 as varchar(20)) end as table_name, '/' || event_type || '/' || cast(user_id % 20 as varchar(20)) as route, value from events""",
    "runs": """
select cast(l_orderkey % 60 as bigint) as run_id, count(*) as edges, sum(case when l_returnflag = 'R' then 1 else 0 end) as observed, sum(case when l_linestatus = 'O' then 1 else 0 end) as holes, max(l_linenumber) > 6 as valid from lineitem where l_orderkey % 60 < 40 group by l_orderkey % 60""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A frame, or a table of the given folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = [t for t in TABLES if t in FRAMES[name]]
    return spark.sql(_named(FRAMES[name], used), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def _named(sql: str, tables: list[str]) -> str:
    """The tables' names as parameters of spark.sql(), so that no view is left in the session."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return sql


def with_frames(*names: str) -> str:
    """WITH clause of the frames for the oracle; the caller appends its own query."""
    return "with " + ",\n".join(f"{n} as ({FRAMES[n]})" for n in names)


def split_list(column: str) -> Column:
    return F.when(F.col(column) == "", F.array().cast("array<string>")).otherwise(F.split(column, ","))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frame(spark, sf_dir, "catalog")
    return out.withColumns({c: split_list(c) for c in ("roles", "entities", "sensitive_fields")})
