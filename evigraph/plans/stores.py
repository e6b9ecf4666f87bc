"""Queries over scans, lookups, sinks, joins and rankings, each with the SQL that must give the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import sql
from evigraph.operators import catalog as cat
from evigraph.operators import classify, diff, evidence, fixpoint, matching, models, runtime, stores
from evigraph.plans.adapters import FRAMES, frame, with_frames
from evigraph.plans.extraction import LOCAL as CALLS
from evigraph.plans.extraction import local
from evigraph.plans.queries import COV, CONFIRMED, GRAPH, LISTS, SEC, SPANS, _add, _entries, _graph, _spans, oracle_sql
from evigraph.plans.scalars import made
from evigraph.sources import readers, sinks
from evigraph.sources.shared import SLICES, dropping_shuffles, scratch


def _payload(spark: SparkSession, d: str, rows: int = readers.MOST_CONFIG // 2) -> DataFrame:
    """All edges as JSON lines in the shared folder, in payloads of about `rows` rows, read through the guard. How many payloads there are follows from the
    number of edges, so that each is well below what either guard takes."""
    path = scratch(spark, "payload")
    edges = frame(spark, d, "edges")
    n = max(16, math.ceil(edges.count() / rows))
    edges = edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("rel").alias("kind"), F.coalesce("resolution", F.lit("none")).alias("resolution"), F.pmod(F.xxhash64("src", "dst", "seq"), F.lit(n)).alias("payload"))
    with dropping_shuffles(spark):
        for i in range(SLICES):  # payloads are written whole; a slice's shuffle files are gone before the next one comes
            edges.where(F.col("payload") % SLICES == i).repartition("payload").write.mode("append").partitionBy("payload").option("compression", "gzip").json(path)
    return readers.edge_payload(spark, path)


_add("src_05_edge_payload", lambda spark, d: _payload(spark, d).groupBy("kind", "resolution").agg(F.count("*").alias("edges")), with_frames("edges") + " select rel as kind, coalesce(resolution, 'none') as resolution, count(*) as edges from edges group by all")
_add("src_06_config_payload", lambda spark, d: readers.config_payload(_payload(spark, d).withColumn("resolution", F.when(F.length("to") % 2 == 0, "config").otherwise(F.col("resolution")))).groupBy("kind").agg(F.count("*").alias("edges")), with_frames("edges") + " select rel as kind, count(*) as edges from edges where length(dst) % 2 = 0 group by all")
_BODY = """select n_nationkey % 4 as run_id, '{"entities":[{"name":"E' || n_name || '","file":"a.ts"},{"name":"order","file":"b.ts"}],"pages":[{"name":"P' || n_name || '","file":"p.vue"}],"routes":[]}' as body from nation"""
ITEMS = "items as (select n_nationkey % 4 as run_id, 'entities' as kind, 'E' || n_name as name, 'a.ts' as file from nation union all select n_nationkey % 4, 'entities', 'order', 'b.ts' from nation union all select n_nationkey % 4, 'pages', 'P' || n_name, 'p.vue' from nation)"
_items = lambda spark, d: stores.payload_items(made(spark, d, _BODY))
_add("src_07_payload_items", _items, f"with {ITEMS} select * from items")
_add("src_08_scan", lambda spark, d: frame(spark, d, "orders").where("o_orderstatus = 'F' and o_custkey > 100"), "select * from orders where o_orderstatus = 'F' and o_custkey > 100")
_add("src_09_projection", lambda spark, d: frame(spark, d, "documents").select("doc_id", "lang", "source"), "select doc_id, lang, source from documents")
_add("src_10_latest_lookup", lambda spark, d: stores.lookup_latest(_items(spark, d), "entities", "E"), f"with {ITEMS} select * from items where kind = 'entities' and run_id = (select max(run_id) from items where kind = 'entities') and name ilike '%e%' order by name, file limit 100")
_SNAPS = "select o_custkey % 60 as id, o_orderkey as run_id, case when o_orderkey % 3 = 0 then 0 else o_orderkey % 50 end as edges from orders where o_custkey % 60 < 50"
_add("src_12_graph_load", lambda spark, d: stores.load_graphs(made(spark, d, "select distinct c_custkey % 60 as id from customer"), made(spark, d, _SNAPS)), f"with s as ({_SNAPS}), l as (select id, max(run_id) as run_id, arg_max(edges, run_id) as edges from s group by id), p as (select distinct c_custkey % 60 as id from customer) select p.id, run_id, edges, case when run_id is null then 'NO_SNAPSHOT' when edges = 0 then 'NO_GRAPH' end as failure from p left join l on p.id = l.id")


def _written(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "entries")
    sinks.write_rows(frame(spark, d, "catalog").select("entry_id", "endpoint", "criticality"), path)
    return spark.read.parquet(path)


_add("snk_01_written_rows", _written, with_frames("catalog") + " select entry_id, endpoint, criticality from catalog")


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "snapshot")
    n = frame(spark, d, "nodes").select("id", "type")
    for run, rows in (("a", n), ("b", n.where("type = 'SERVICE'")), ("a", n.where("type <> 'VIEW'"))):
        sinks.write_snapshot(rows, path, run)
    return spark.read.parquet(path).groupBy("run_id", "type").agg(F.count("*").alias("n"))


_add("snk_02_snapshots", _snapshots, with_frames("nodes") + " select 'a' as run_id, type, count(*) as n from nodes where type <> 'VIEW' group by type union all select 'b', type, count(*) from nodes where type = 'SERVICE' group by type")
_MISSING = lambda spark, d: classify.missing_endpoints(local(spark, d, "calls").select(F.col("url_id").alias("seq"), F.lit("HTTP").alias("category"), "url", F.nullif("method", F.lit("")).alias("http_method"), (F.col("url_id") % 5 == 0).alias("mapped"), F.lit(0.9).alias("confidence")))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    from evigraph.plans.adapters import catalog

    return stores.findings(catalog(spark, d), _MISSING(spark, d))


_add(
    "snk_03_findings", _findings,
    SEC + f""", calls as ({CALLS['calls']}), m as (select distinct coalesce(nullif(method, ''), 'ANY') as http_method, url from calls where url <> '' and url_id % 5 <> 0), x as (select unnest(entities) as entity, endpoint, verb from c where verb <> 'OTHER'),
k as (select entity, bool_or(verb in ('CREATE', 'UPDATE', 'DELETE')) as w, bool_or(verb = 'READ') as r from x group by entity)
select 'security' as source, type, severity, cast(entry_id as varchar) as subject from s1 union all select 'security', type, severity, cast(entry_id as varchar) from s2 union all select 'security', type, severity, cast(entry_id as varchar) from s3 union all select 'security', type, severity, cast(entry_id as varchar) from s5
union all select 'security', 'INCONSISTENT_PROTECTION', severity, controller from s4 union all select 'consistency', 'MISSING_ENDPOINT', case when http_method = 'POST' then 'high' else 'medium' end, http_method || ' ' || url from m
union all select 'overlap', 'FUNCTIONAL_OVERLAP', 'low', verb || ' ' || entity from x group by verb, entity having count(distinct endpoint) >= 2 union all select 'lifecycle', case when w then 'WRITABLE_NOT_READABLE' else 'READABLE_NOT_WRITABLE' end, 'medium', entity from k where w <> r""",
)
_add("snk_04_export", _entries(stores.export), LISTS + """ select entry_id, row_number() over (order by criticality desc, entry_id) as rank, '{"entry_id":' || entry_id || ',"endpoint":"' || endpoint || '","method":"' || http_method || '","criticality":' || criticality || ',"roles":[' || array_to_string(list_transform(roles, lambda x: '"' || x || '"'), ',') || ']}' as document from c""")
_FIELDS = lambda e: e.select(F.explode("entities").alias("entity"), F.col("sensitive_fields").alias("fields"))
_add("snk_05_schema_fields", _entries(lambda e: stores.schema_fields(_FIELDS(e), _FIELDS(e.where("entry_id < 0")))), LISTS + ", x as (select unnest(entities) as entity, fields from c) select distinct entity, unnest(fields) as field, 'catalog' as source from x")
_add("snk_05_schema_fallback", _entries(lambda e: stores.schema_fields(_FIELDS(e.where("entry_id < 0")), _FIELDS(e))), LISTS + ", x as (select unnest(entities) as entity, fields from c) select distinct entity, unnest(fields) as field, 'graph' as source from x")
_add("snk_06_sarif", _entries(lambda e: sinks.sarif_results(cat.privilege_escalation(e))), SEC + """ select '{"ruleId":"' || type || '","level":"error","message":{"text":"' || type || ' at ' || entry_id || '"}}' as result from s2""")
KEY = b"0123456789abcdef"
_PAD = lambda x: "'" + bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() + "'"
_REPORTS = "select p_partkey as id, p_name || p_type as body from part"
SIGNED = f"with r as ({_REPORTS}), s as (select id, body, sha256(unhex({_PAD(0x5C)}) || unhex(sha256(unhex({_PAD(0x36)}) || encode(body)))) as h from r)"
_add("snk_07_signed_reports", lambda spark, d: stores.signed(made(spark, d, _REPORTS), KEY), SIGNED + " select id, sha256(body) as sha256, h as hmac from s")
_add("snk_07_verified_reports", lambda spark, d: stores.verified(made(spark, d, _REPORTS), stores.signed(made(spark, d, _REPORTS.replace("p_name ||", "case when p_size % 4 = 0 then 'x' else p_name end ||")), KEY), KEY), "select p_partkey as id, not (p_size % 4 = 0 and p_name <> 'x') as valid from part")

_add("prj_01_nodes_by_type", _graph(lambda e, n: n.where("type = 'SERVICE'").select("id", "class_key")), with_frames("nodes") + " select id, class_key from nodes where type = 'SERVICE'")
_add("prj_02_callees_and_data", _graph(lambda e, n: evidence.neighbours(evidence.existing_edges(e, n))), GRAPH + " select src, count(distinct dst) filter (where rel = 'CALLS') as callees, count(distinct dst) filter (where rel = 'WRITES_ENTITY') as written, count(distinct dst) filter (where rel = 'READS_ENTITY') as read from ex group by src")
_SYMBOLS = "select distinct 'shop.' || lower(c_mktsegment) || '.Service' || cast(c_nationkey as varchar(20)) as name from customer"
_ASKED = "select 'service' || cast(n_nationkey as varchar(20)) as symbol from nation union all select 'build' from region where r_regionkey = 0 union all select 'no' from region where r_regionkey = 0"
_add(
    "prj_15_symbol_match", lambda spark, d: matching.symbol_match(made(spark, d, _ASKED), made(spark, d, _SYMBOLS)),
    f"with n as ({_SYMBOLS}), a as ({_ASKED}), x as (select distinct symbol, name from a join n on list_contains(string_split(lower(name), '.'), symbol)) select symbol, name, 'exact' as via from x union all select distinct symbol, name, 'part' from a join n on contains(lower(name), symbol) where length(symbol) >= 3 and symbol not in (select symbol from x)",
)
_add("join_02_left_default", _graph(lambda e, n: n.select("id").join(e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k")), "id", "left").select("id", F.coalesce("k", F.lit(0)).cast("long").alias("callers"))), with_frames("nodes", "edges") + " select id, coalesce(k, 0) as callers from nodes left join (select dst, count(*) as k from edges group by dst) on id = dst")
_add("join_03_membership", _graph(lambda e, n: e.join(n.where("sensitive").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "rel", "seq")), with_frames("nodes", "edges") + " select src, dst, rel, seq from edges where dst in (select id from nodes where sensitive)")
_add("join_05_snapshot_diff", _entries(lambda e: diff.changed_rows(e.where("entry_id % 4 <> 0"), e.where("entry_id % 5 <> 0").withColumn("criticality", F.expr("case when entry_id % 7 = 0 then 1 else criticality end")), ["entry_id"], "criticality")), LISTS + " select entry_id, case when entry_id % 4 = 0 then 'added' when entry_id % 5 = 0 then 'removed' else 'changed' end as change from c where (entry_id % 4 = 0) <> (entry_id % 5 = 0) or entry_id % 4 <> 0 and entry_id % 5 <> 0 and entry_id % 7 = 0 and criticality <> 1")
_PATTERNS = {"metal": "STEEL|BRASS|COPPER|TIN|NICKEL", "big": "^LARGE|ECONOMY", "shiny": "POLISHED|BURNISHED", "brand1": "(?i)anodized"}
_add("join_11_regex_hits", lambda spark, d: matching.regex_hits(made(spark, d, "select p_partkey as id, p_type as name from part"), _PATTERNS), " union all ".join(f"select p_partkey as id, '{k}' as concept from part where regexp_matches(p_type, '{v}')" for k, v in _PATTERNS.items()))
_NAMED = """select case when p_partkey % 3 = 0 then 'SERVICE:a.C' || cast(p_size as varchar(20)) else 'SERVICE:a.C' || cast(p_size as varchar(20)) || '.m' || cast(p_partkey % 5 as varchar(20)) || '(int)' end as id, p_partkey as seq, case when p_partkey % 3 > 0 then 'm' || cast(p_partkey % 5 as varchar(20)) end as method_name,
  case when p_size % 4 = 0 then 'src/x' || cast(p_partkey % 6 as varchar(20)) || '/F' || cast(p_partkey % 4 as varchar(20)) || '.ts' else '' end as source_file from part"""
_add(
    "join_12_name_index", lambda spark, d: matching.name_index(made(spark, d, _NAMED)),
    f"""with n as ({_NAMED}), k as (select *, case when contains(id, '(') then regexp_replace(split_part(id, '(', 1), '\\.[^.]*$', '') else id end as key from n),
i as (select split_part(key, ':', 2) as name, id, id = key as bare, 'i' || key as owner, 0 as s, seq as q from k),
r as (select source_file, arg_min(id, row(method_name is not null, seq)) as id, arg_min(method_name is null and id = key, row(method_name is not null, seq)) as bare, min(seq) as q from k where source_file <> '' group by source_file),
p as (select *, string_split(regexp_replace(source_file, '.ts$', ''), '/') as a from r), f as (select unnest([array_to_string(a, '.'), array_to_string(a[2:], '.'), a[3]]) as name, id, bare, 'f' || source_file as owner, 1 as s, q from p),
u as (select * from i union all select * from f), g as (select name, arg_max(id, row(s, q)) filter (where bare) as c, arg_min(id, row(s, q)) as f, min(owner) as o1, max(owner) as o2 from u group by name) select name, coalesce(c, f) as id from g where c is not null or o1 = o2""",
)
_add("join_13_shared_elements", _entries(lambda e: matching.overlapping(e.select(F.col("entry_id").alias("id"), F.col("entities").alias("items")), ["Order", "BUILDING"])), LISTS + " select entry_id as id, len(list_filter(entities, lambda x: x in ('Order', 'BUILDING')))::bigint as shared from c where len(list_filter(entities, lambda x: x in ('Order', 'BUILDING'))) > 0")
_add("join_14_peers", _entries(lambda e: e.groupBy("controller").agg(F.count_if(F.size("roles") > 0).alias("protected"), F.count_if(F.size("roles") == 0).alias("open")).where("protected > 0 and open > 0")), LISTS + " select controller, count(*) filter (where p) as protected, count(*) filter (where not p) as open from c group by controller having bool_or(p) and bool_or(not p)")
_HINTED = "select p_partkey as entry_id, '/gw/e' || cast(p_size % 12 as varchar(20)) as endpoint, case p_partkey % 4 when 0 then 'save_Order' || cast(p_size % 9 as varchar(20)) || '.v1' when 1 then 'SaveOrder' || cast(p_size % 9 as varchar(20)) || 'Extra' when 2 then 'zz' else '' end as hint, p_partkey % 7 = 0 as resolved from part"
_CONTROLLERS = "select n_nationkey as seq, 'SaveOrder' || cast(n_nationkey as varchar(20)) || 'Controller' as class_name from nation where n_nationkey < 9"
_add(
    "join_16_gateway_hints", lambda spark, d: matching.gateway_operations(made(spark, d, _HINTED), made(spark, d, _CONTROLLERS)),
    f"with h as ({_HINTED}), w as (select endpoint from h group by endpoint having count(*) >= 5) select entry_id, p_size % 9 as seq from h join part on p_partkey = entry_id where endpoint in (select endpoint from w) and not resolved and entry_id % 4 in (0, 1)",
)
_add("win_08_fan_in", lambda spark, d: matching.crowded_endpoints(made(spark, d, _HINTED)), f"select endpoint, count(*) as n from ({_HINTED}) group by endpoint having count(*) >= 5")
_WROUTES = "select cast(user_id as varchar(20)) as trace_id, event_id as seq, '/' || event_type || case event_id % 3 when 0 then '' when 1 then '/a' || cast(event_id % 13 as varchar(20)) else '/detail/' || cast(event_id % 101 as varchar(20)) end as route from events"
_WROOTS = "select cast(user_id as varchar(20)) as trace_id, '/' || min(event_type) as path from events group by user_id"
_add("win_07_refined_routes", lambda spark, d: stores.refined_routes(made(spark, d, _WROUTES), made(spark, d, _WROOTS)), f"with s as ({_WROUTES}), r as ({_WROOTS}), b as (select r.trace_id, arg_min(route, row(-length(route), seq)) as best from s join r on s.trace_id = r.trace_id where starts_with(route, path || '/') group by r.trace_id) select r.trace_id, coalesce(best, path) as route from r left join b on r.trace_id = b.trace_id")
_add("win_09_first_wins", lambda spark, d: frame(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order")), "select o_custkey, arg_min(o_orderkey, row(o_orderdate, o_orderkey)) as first_order from orders group by o_custkey")
_add("win_10_previous_valid", lambda spark, d: diff.run_deltas(frame(spark, d, "runs").withColumn("grp", F.expr("run_id % 3"))).select("grp", "run_id", "d_edges"), with_frames("runs") + ", v as (select *, run_id % 3 as grp from runs where valid) select grp, run_id, edges - lag(edges) over (partition by grp order by run_id) as d_edges from v")
_add("top_02_exposures", _entries(stores.exposures_by_rank), LISTS + ", x as (select entry_id, case when not p then 'none' when len(list_filter(roles, lambda x: x <> 'AUTHENTICATED')) = 0 then 'auth-only' else 'permission' end as guard, criticality, endpoint from c where len(fields) > 0) select * from x order by case guard when 'none' then 0 when 'auth-only' then 1 else 2 end, criticality desc, endpoint, entry_id limit 50")
_add("top_06_by_criticality", _entries(lambda e: e.orderBy(F.desc("criticality"), "entry_id").limit(100).select("entry_id", "criticality")), LISTS + " select entry_id, criticality from c order by criticality desc, entry_id limit 100")
_add("set_05_edge_keys", _graph(lambda e, n: e.where("weight <= 4").select("src", "dst", "rel").distinct().join(e.where("weight >= 3").select("src", "dst", "rel"), ["src", "dst", "rel"], "left_anti")), with_frames("edges") + " select distinct src, dst, rel from edges where weight <= 4 except select src, dst, rel from edges where weight >= 3")
_add("agg_16_fact_sheet", _graph(evidence.facts), GRAPH + ", t as (select src as id from ex union select dst from ex) select (select count(*) from nodes) as nodes, (select count(*) from ex) as edges, (select count(*) from nodes where id not in (select id from t)) as isolated, (select count(*) from nodes where runtime_hot) as hot, round((select count(*) from nodes where id in (select id from t)) / (select count(*) from nodes), 4) as participation")
_add("agg_16_isolated_from_data", _graph(lambda e, n: evidence.isolated(e.where("rel <> 'CALLS'"), n)), GRAPH + " select id, type from nodes where id not in (select src from ex where rel <> 'CALLS') and id not in (select dst from ex where rel <> 'CALLS')")
_add("agg_30_containers", _graph(lambda e, n: models.containers(e, n)), GRAPH + ", k as (select id, case type when 'ENTITY' then 'db' when 'VIEW' then 'frontend' else 'backend' end as container from nodes), q as (select a.container as src, b.container as dst, count(*) as edges, max(conf) as best from ec join k a on src = a.id join k b on dst = b.id where a.container <> b.container group by a.container, b.container) select * from q")
_add("sec_05_missing_protection_apart", _entries(lambda e: cat.missing_protection(e.withColumn("controller", F.concat("controller", F.lit("-"), "entry_id")).withColumn("entities", F.array(F.concat(F.lit("E"), "entry_id"))))), SEC.replace("as verb from catalog)", "as verb from (select * replace (controller || '-' || entry_id as controller, 'E' || entry_id as entities) from catalog))") + " select * from s5")
_BOUNDS = CONFIRMED + """, cf as (select m as method, pairs, confirmed, rate from (select m, count(*) as pairs, count(o.src) as confirmed, round(count(o.src) / count(*), 4) as rate from s left join o on s.src = o.src and s.dst = o.dst group by m)),
b(method, side, n, k, lo, hi, i) as (select method, side, pairs, confirmed, 0.0::double, 1.0::double, 0 from cf, (select unnest(['low', 'high']) as side) union all
  select method, side, n, k, case when up then (lo + hi) / 2 else lo end, case when up then hi else (lo + hi) / 2 end, i + 1 from (select *, case when side = 'low' then
    list_sum(list_transform(range(k, n + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln((lo + hi) / 2) + (n - x) * ln(1 - (lo + hi) / 2)))) < 0.025
    else list_sum(list_transform(range(0, k + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln((lo + hi) / 2) + (n - x) * ln(1 - (lo + hi) / 2)))) > 0.025 end as up from b where i < 40)),
e as (select method, max(lo) filter (where side = 'low') as low, max(hi) filter (where side = 'high') as high from b where i = 40 group by method)
select cf.*, case when confirmed = 0 then 0.0 else round(low, 6) end as low, case when confirmed = pairs then 1.0 else round(high, 6) end as high from cf join e on cf.method = e.method"""  # fmt: skip
_add("agg_23_reliability", _graph(models.reliability), ("with recursive " + _BOUNDS[5:]).replace(" select m as method, count(*) as pairs, count(o.src) as confirmed, round(count(o.src) / count(*), 4) as rate from s left join o on s.src = o.src and s.dst = o.dst group by m, cf as", ", cf as"))
_add(
    "ext_24_suffixes", _entries(lambda e: models.suffixes(e.select(F.concat(F.initcap(F.regexp_replace("controller", "[0-9]", "")), F.initcap("operation"), F.element_at(F.split("endpoint", "/"), -1), F.lit("RestController")).alias("name")))),
    LISTS + ", n as (select distinct 'Controller' || upper(operation[1]) || lower(operation[2:]) || string_split(endpoint, '/')[-1] || 'RestController' as name from c), s as (select regexp_extract_all(name, '[A-Z][a-z0-9]*') as s from n), t as (select unnest([s[-1], s[-2] || s[-1], s[-3] || s[-2] || s[-1]]) as suffix from s) select suffix, count(*) as names from t group by suffix having count(*) >= 5",
)


def _sql_functions(spark: SparkSession, d: str) -> DataFrame:
    sql.register(spark)
    return spark.sql("select p_partkey as k, snake_case('HTTPServer' || replace(p_brand, '#', 'B')) as snake, bare_symbol('a.b.' || p_size) as bare, git_sha(sha1(cast(p_partkey as string))) as sha, external_domain('https://h' || p_size || '.org/x') as host from {part}", part=frame(spark, d, "part"))


_add("udf_05_sql_functions", _sql_functions, "select p_partkey as k, 'http_server_brand_b' || split_part(p_brand, '#', 2) as snake, cast(p_size as varchar) as bare, sha1(cast(p_partkey as varchar)) as sha, 'h' || p_size || '.org' as host from part")
_RULES = {"steel": ("STEEL$", sql.by_regex), "plus": ("ED ", sql.by_text), "never": ("zzz", sql.by_text)}
_add("udf_02_matched_rules", lambda spark, d: sql.matched(frame(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("line")), _RULES), "select 'steel' as rule, count(*) filter (where regexp_matches(p_type, 'STEEL$')) as lines from part union all select 'plus', count(*) filter (where contains(p_type, 'ED ')) from part union all select 'never', 0")
