"""Queries over the scalar functions and predicates: each reads a frame that both engines make of the same SQL, and spells the
function's meaning in SQL for the comparison."""

from __future__ import annotations

import re
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.operators import catalog as cat
from evigraph.operators import classify, evidence, matching, models
from evigraph.plans.adapters import TABLES, _named
from evigraph.plans.queries import _add
from evigraph.sources import readers, sinks


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", sql)]
    return spark.sql(_named(sql, used), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def scalar(query: str, source: str, /, **columns: tuple[Callable[[], Column], str]) -> None:
    """source: SQL with a key `k` and the inputs; columns: name -> (expression, when asked for, SQL)."""
    _add(query, lambda spark, d: made(spark, d, source).select("k", *(c().alias(n) for n, (c, _) in columns.items())), f"with s as ({source}) select k, " + ", ".join(f"{q} as {n}" for n, (_, q) in columns.items()) + " from s")


def _text(c: Column) -> Column:
    return F.array_join(c, "|")


c = F.col
_SNAKE = r"lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'))"
#: Paths of source files, of all kinds of folders.
PATHS = """select p_partkey as k, case p_partkey % 8 when 0 then 'src/main/java/com/shop/web/orders/v1/' when 1 then 'frontend/src/pages/' when 2 then 'server/routes/' when 3 then 'tests/unit/' when 4 then '' when 5 then 'services/gateway/src/' when 6 then 'node_modules/lib/' else 'src/app/main/' end
  || replace(p_brand, '#', '') || case p_size % 6 when 0 then 'ServiceV1.java' when 1 then 'Page.vue' when 2 then '.routes.ts' when 3 then 'Controller.java' when 4 then 'Repository.kt' else '.sql' end as path,
  case p_size % 4 when 0 then 'ENTITY' when 1 then 'VIEW' when 2 then 'SERVICE' else 'ROUTE' end as type, case p_size % 5 when 0 then 'spring' when 1 then 'vue' when 2 then 'express' end as stack from part"""
NAMES = "select o_orderkey as k, case o_orderkey % 5 when 0 then 'HTTPServerName' when 1 then 'orderLines' when 2 then 'a.b.OrderBoxes_v2' when 3 then 'Invoices class' else 'x' end || cast(o_orderkey % 7 as varchar(20)) as name from orders"

scalar(
    "fn_02_entity_tables", "select p_partkey as k, case p_partkey % 3 when 0 then 'app.\"Tbl_' || cast(p_size as varchar(20)) || '\"' when 1 then ' ' end as explicit, 'OrderHTTPLine' || replace(p_brand, 'Brand#', 'B') as cls from part",
    name=(lambda: text.table_of_entity(c("explicit"), c("cls")), f"case when trim(explicit) <> '' then lower(replace(split_part(explicit, '.', 2), '\"', '')) else {_SNAKE.format('cls')} end"),
)
_TAGS = "select event_id as k, case when event_id % 5 = 0 then 'orders_' || cast(event_id % 7 as varchar(20)) else '' end as coll, case when event_id % 3 = 0 then 'Users' else '' end as tbl, case when event_id % 2 = 0 then 'select 1 from app.Items i join b' else 'commit' end as stmt, case when event_id % 4 = 0 then 'insert' else '' end as op, event_type as old from events"
_map = lambda: F.create_map(F.lit("db.collection.name"), "coll", F.lit("db.sql.table"), "tbl", F.lit("db.statement"), "stmt", F.lit("db.operation.name"), "op", F.lit("db.operation"), "old")
scalar("fn_04_span_tables", _TAGS, tables=(lambda: _text(text.tables_of_span(_map())), "case when coll <> '' then coll when tbl <> '' then tbl when k % 2 = 0 then 'items|b' else '' end"))
scalar("fn_06_span_operations", _TAGS, operation=(lambda: text.db_operation(_map()), "upper(case when op <> '' then op else old end)"))
scalar("fn_05_table_names", "select o_orderkey as k, case o_orderkey % 3 when 0 then 'app.OrderLines' when 1 then '`UserHTTPLogs`' else '[dbo].[plain]' end as name from orders", name=(lambda: text.normalize_table(c("name")), "case k % 3 when 0 then 'order_lines' when 1 then 'user_http_logs' else 'plain' end"))
scalar(
    "fn_09_segments", "select o_orderkey as k, case o_orderkey % 5 when 0 then 'find.v1' when 1 then 'x.JSON' when 2 then ':id' when 3 then '{key}' else 'plain.v2.csv' end as part from orders",
    part=(lambda: text.normalize_segment(c("part")), "case k % 5 when 0 then 'find' when 1 then 'x' when 4 then 'plain.v2' else part end"), param=(lambda: text.is_param(c("part")), "k % 5 in (2, 3)"),
)
_PAIRS = "select o_orderkey as k, case o_orderkey % 6 when 0 then '/api/orders/7' when 1 then '/api/orders' when 2 then '{base}/orders/7' when 3 then '/gw/api/orders/7' when 4 then '/api/users/7' else '/orders/7' end as url, case o_orderkey % 2 when 0 then '/api/orders/:id' else '/api/orders' end as path from orders"
_parts = lambda x: F.transform(text.segments(x), text.normalize_segment)
scalar(
    "fn_10_match_scores", _PAIRS,
    score=(lambda: F.round(text.match_score(text.tidy_path(c("url")), text.segments(text.tidy_path(c("url"))), _parts(text.tidy_path(c("url"))), c("path"), _parts(c("path"))), 4), "case k % 6 when 0 then 93.3333 when 1 then 100.0 when 2 then 76.5 when 3 then 60.0 when 4 then 60.0 else 0.0 end"),
)
scalar(
    "fn_11_operation_names", "select p_partkey as k, '/api/' || case when p_partkey % 3 = 0 then 'findOrders.v1' when p_partkey % 3 = 1 then 'saveOrderLine' else 'plain' end || '?x=1' as url, case when p_partkey % 2 = 0 then 'FindOrdersWsV1' else 'SaveOrderController' end as cls from part",
    operation=(lambda: text.operation_of_url(c("url")), "case k % 3 when 0 then 'findOrders' when 1 then 'saveOrderLine' end"), base=(lambda: text.class_base(c("cls")), "case k % 2 when 0 then 'findorders' else 'saveorder' end"),
    score=(lambda: text.operation_score(text.operation_of_url(c("url")), c("cls")).cast("long"), "case when k % 3 = 2 then null when k % 3 = 0 and k % 2 = 0 then 90 when k % 3 = 1 and k % 2 = 1 then 80 else 0 end"),
)
_OPNAMES = "select p_partkey as k, case p_partkey % 6 when 0 then 'listCategories' when 1 then 'findBoxesV2' when 2 then 'createOrder' when 3 then 'removeAddress' when 4 then 'goUp' else 'editX' end as op from part"
scalar(
    "fn_12_operation_entities", _OPNAMES, verb=(lambda: cat.verb_class(c("op")), "case k % 6 when 0 then 'READ' when 1 then 'READ' when 2 then 'CREATE' when 3 then 'DELETE' when 4 then 'OTHER' else 'UPDATE' end"),
    entity=(lambda: text.entity_of_operation(c("op"))["entity"], "case k % 6 when 0 then 'category' when 1 then 'box' when 2 then 'order' when 3 then 'address' end"), many=(lambda: text.entity_of_operation(c("op"))["cardinality"], "case k % 6 when 0 then 'collection' when 1 then 'collection' when 2 then 'single' when 3 then 'single' end"),
)
scalar(
    "fn_14_class_keys", "select o_orderkey as k, case o_orderkey % 4 when 0 then 'ENTITY:a.b.Order::total' when 1 then 'SERVICE:a.b.Run.go(int,x.Y)' when 2 then 'ENTITY:a.Box#id' else 'VIEW:Home' end as id, case when o_orderkey % 2 = 0 then 'ENTITY' else 'SERVICE' end as type from orders",
    key=(lambda: text.class_key(c("id"), c("type")), "case k % 4 when 0 then 'ENTITY:a.b.Order' when 1 then 'SERVICE:a.b.Run' when 2 then 'ENTITY:a.Box' else 'VIEW:Home' end"), name=(lambda: text.class_name(text.class_key(c("id"), c("type"))), "case k % 4 when 0 then 'Order' when 1 then 'Run' when 2 then 'Box' else 'Home' end"),
)
scalar("fn_15_name_suffixes", PATHS, names=(lambda: F.size(text.name_suffixes(c("path"))).cast("long"), "len(string_split(path, '/'))"), longest=(lambda: F.element_at(text.name_suffixes(c("path")), 1), r"replace(regexp_replace(path, '\.(java|kt|ts)$', ''), '/', '.')"))
scalar("fn_16_camel_segments", NAMES, parts=(lambda: _text(text.camel_segments(c("name"))), "case k % 5 when 0 then 'HTTP|Server|Name' when 1 then 'order|Lines' when 2 then 'a|b|Order|Boxes|v2' when 3 then 'Invoices|class' else 'x' end || cast(k % 7 as varchar)"))
scalar("fn_17_tokens", NAMES, tokens=(lambda: text.tokenized(c("name")), "case k % 5 when 0 then 'httpserver name' when 1 then 'order lines' when 2 then 'a b order boxes v2' when 3 then 'invoices class' else 'x' end || cast(k % 7 as varchar) || case k % 5 when 2 then ' boxe' when 3 then ' invoice' else '' end"))
scalar("fn_18_symbols", "select p_partkey as k, 'What OrderLine ' || p_type || ' of Steelworks, ab OrderLine When Xy ' || p_brand as t from part", symbols=(lambda: _text(text.strong_symbols(c("t"), ("When", "What"))), "'OrderLine|Steelworks|Brand'"))
_LINES = """select o_orderkey as k, case o_orderkey % 6 when 0 then '  int total = 3; // the sum (' when 1 then 'say("it (x) is", a);' when 2 then ' * prose (here)' when 3 then '' when 4 then 'public  void run( ) {' else 'x = ''ab'' + `c`' end as line from orders"""
scalar("fn_19_masked_lines", _LINES, masked=(lambda: text.masked_line(c("line")), """case k % 6 when 0 then '  int total = 3; ' when 1 then 'say("         ", a);' when 4 then line when 5 then 'x = ''  '' + ` `' end"""), comment=(lambda: text.is_comment(c("line")), "k % 6 in (2, 3)"))
scalar("fn_20_declarations", _LINES, line=(lambda: text.normalize_declaration(c("line")), r"regexp_replace(regexp_replace(trim(line), '\s+', ' ', 'g'), '\s*[{;]\s*$', '')"))
scalar("fn_21_file_hashes", "select doc_id as k, text from documents", hash=(lambda: F.sha2("text", 256), "sha256(text)"))
scalar(
    "fn_22_canonical_json", "select p_partkey as k, p_size as size, p_brand as brand from part",
    text=(lambda: sinks.canonical_columns(c("size"), c("brand")), """'{"brand":"' || brand || '","size":' || cast(size as varchar) || '}'"""), hash=(lambda: F.sha2(sinks.canonical_columns(c("size"), c("brand")), 256), """sha256('{"brand":"' || brand || '","size":' || cast(size as varchar) || '}')"""),
)
scalar(
    "fn_23_ages", "select event_id as k, cast(ts as timestamp) as t from events",
    hours=(lambda: F.round(text.age_hours(c("t"), F.lit("2024-01-15 00:00:00")), 4), "round(greatest(0.0::double, (epoch_us(timestamp '2024-01-15 00:00:00') - epoch_us(t)) / 3.6e9), 4)"), iso=(lambda: text.iso_time(c("t")), "strftime(t, '%Y-%m-%dT%H:%M:%S.%gZ')"),
)
scalar("fn_29_dates", "select o_orderkey as k, cast(o_orderdate as date) as d from orders", day=(lambda: F.unix_date("d").cast("long"), "date_diff('day', date '1970-01-01', d)"), iso=(lambda: F.date_format("d", "yyyy-MM-dd"), "cast(d as varchar)"))
scalar(
    "fn_30_json", """select p_partkey as k, '{"edges":{"total":' || cast(p_size as varchar(20)) || ',"by":["' || p_brand || '"]}}' as j from part""",
    total=(lambda: F.get_json_object("j", "$.edges.total").cast("long"), "json_extract_string(j, '$.edges.total')::bigint"), first=(lambda: F.from_json("j", "edges struct<total:long,by:array<string>>")["edges"]["by"][0], "json_extract_string(j, '$.edges.by[0]')"),
)
scalar(
    "fn_24_package_keys", PATHS,
    package=(lambda: text.package_key(c("path")), "case k % 8 when 0 then 'shop/web' when 1 then 'frontend/src' when 2 then 'server/routes' when 3 then '' when 4 then '(raiz)' when 5 then 'services/gateway' when 6 then 'node_modules/lib' else 'main' end"),
    component=(lambda: text.component_key(c("path")), "case k % 8 when 0 then 'orders/v1' when 1 then 'frontend/pages' when 2 then 'server/routes' when 5 then 'services/gateway' when 7 then 'app' else '' end"),
    container=(lambda: text.container_of(c("type"), c("stack"), c("path")), "case when type = 'ENTITY' then 'db' when type = 'VIEW' or stack = 'vue' then 'frontend' when stack = 'spring' then 'backend' when stack = 'express' or k % 8 = 5 then 'gateway' end"),
)
scalar(
    "fn_24_route_domains", "select o_orderkey as k, case o_orderkey % 4 when 0 then '/api/v1/orders/:id' when 1 then '/shop/:id' when 2 then '' else '/api' end as endpoint, case when o_orderkey % 8 = 2 then 'src/pages/cart/X.vue' end as path from orders",
    domain=(lambda: text.route_domain(c("endpoint"), c("path")), "case k % 4 when 0 then 'orders' when 1 then 'shop' when 2 then case when k % 8 = 2 then 'cart' else 'geral' end else 'api' end"),
)
scalar("fn_27_safe_ids", "select p_partkey as k, p_name as n, case when p_partkey % 9 = 0 then '--' else p_type end as t from part", id=(lambda: text.safe_id(c("t")), "case when k % 9 = 0 then 'n' else regexp_replace(t, '[^A-Za-z0-9]+', '_', 'g') end"), short=(lambda: text.clamp(c("n"), 12), "case when length(n) > 12 then n[:11] || '…' else n end"))
scalar("fn_28_git_shas", "select o_orderkey as k, case o_orderkey % 3 when 0 then ' ABCDEF0123456789abcdef0123456789abcdef01 ' when 1 then 'abc' end as sha from orders", sha=(lambda: text.git_sha(c("sha")), "case k % 3 when 0 then lower(trim(sha)) end"))
scalar("fn_31_tier_confidence", "select o_orderkey as k, case o_orderkey % 4 when 0 then 'local' when 1 then 'serviceMap' when 2 then 'fuzzyGlobalMatch' else 'other' end as tier from orders", value=(lambda: text.tier_confidence(c("tier")).cast("double"), "case k % 4 when 0 then 1.0::double when 1 then 0.95 when 2 then 0.45 else 0.5 end"))
scalar("fn_33_root_segments", "select o_orderkey as k, case o_orderkey % 3 when 0 then 'br.shop.Order' when 1 then 'Order' else 'a-b.c' end as n from orders", root=(lambda: text.root_segment(c("n")), "case k % 3 when 0 then 'br' end"))
scalar("fn_34_globs", PATHS, java=(lambda: text.matches_glob(c("path"), F.lit(".java")), "suffix(path, '.java')"), pages=(lambda: text.matches_glob(c("path"), F.lit("/pages/")), "contains(path, '/pages/')"), every=(lambda: text.matches_glob(c("path"), F.lit(None).cast("string")), "true"))
scalar("fn_36_server_files", PATHS, server=(lambda: text.is_server_side(c("path")), "k % 8 = 2"))
scalar("fn_37_repositories", "select o_orderkey as k, case o_orderkey % 4 when 0 then 'https://git.example.org/own/shop.git' when 1 then 'git@git.example.org:own/shop' when 2 then 'own/shop' else 'nothing' end as u, 'a.B.run ' as s from orders", slug=(lambda: text.repo_slug(c("u")), "case when k % 4 < 3 then 'own/shop' end"), bare=(lambda: text.bare_symbol(c("s")), "'run'"))
scalar("fn_32_diagram_confidence", "select l_orderkey * 10 + l_linenumber as k, case l_linenumber % 4 when 0 then 'RUNTIME_OBSERVED' when 1 then 'CONFIG_PROVEN' when 2 then 'UNKNOWN' else '' end as m, case when l_linenumber = 7 then 'compiler' end as r from lineitem", kind=(lambda: text.diagram_confidence(c("m"), c("r")), "case when m = 'RUNTIME_OBSERVED' then 'observed' when m = 'CONFIG_PROVEN' or r = 'compiler' then 'proven' else 'inferred' end"))
scalar("fn_35_legacy_types", "select p_partkey as k, case p_size % 3 when 0 then 'UiComponent' when 1 then 'Route' else 'Entity' end as role from part", type=(lambda: text.legacy_type(c("role")), "case role when 'UiComponent' then 'COMPONENT' else upper(role) end"))
_Z = {p: NormalDist().inv_cdf(p) for p in (0.975, 0.95, 0.995)}
scalar("fn_26_normal_quantiles", "select p_partkey as k, p_size as n from part", half=(lambda: F.round(F.lit(models.normal_quantile(0.975)) * F.sqrt(c("n")), 6), f"round({_Z[0.975]!r}::double * sqrt(n), 6)"))
scalar(
    "fn_25_exact_intervals", "select k, k % 11 as hits from (select distinct p_size as k from part)",
    low=(lambda: F.when(c("hits") == 0, 0.0).otherwise(F.round(F.element_at(F.array(*(F.lit(models.clopper_pearson(h, 10)[0]) for h in range(11))), (c("hits") + 1).cast("int")), 6)), "[0.0, 0.002529, 0.025211, 0.066740, 0.121552, 0.187086, 0.262378, 0.347547, 0.443905, 0.554984, 0.691503][hits + 1]::double"),
)

scalar("src_02_file_types", PATHS, type=(lambda: readers.file_type(c("path")), "case k_size when 0 then 'java' when 1 then 'vue' when 2 then 'typescript' when 3 then 'java' when 4 then 'other' else 'sql' end".replace("k_size", "case when suffix(path, '.vue') then 1 when suffix(path, '.ts') then 2 when suffix(path, '.java') then 0 when suffix(path, '.kt') then 4 else 5 end")))
scalar("prj_13_infrastructure", "select o_orderkey as k, case o_orderkey % 6 when 0 then 'QRTZ_jobs' when 1 then 'orders' when 2 then 'row_lock' when 3 then ' Session ' when 4 then 'sessions_of' else '' end as t from orders", infra=(lambda: text.is_infrastructure(c("t")), "k % 6 in (0, 2, 3)"))
scalar(
    "prj_18_ui_only", "select o_orderkey as k, case when o_orderkey % 7 = 0 then '/x' else '' end as endpoint, case when o_orderkey % 5 = 0 then 'UI_ONLY' else 'HTTP' end as cat, case o_orderkey % 6 when 0 then 'button: setOpen' when 1 then 'input: onBlurred' when 2 then 'link: saveOrder' when 3 then 'button: handleSort' when 4 then 'copyRowToClipboard' else 'form: showTable' end as i from orders",
    ui=(lambda: text.is_ui_only(c("endpoint"), c("cat"), c("i")), "endpoint = '' and (cat = 'UI_ONLY' or k % 6 in (0, 1, 3, 4))"),
)
scalar("prj_16_inferred_backend", "select o_orderkey as k, case o_orderkey % 3 when 0 then '/api/sales-orders/:id' when 1 then '/v1/api/users/export' else '/plain' end as u from orders", controller=(lambda: classify.inferred_backend(c("u"))["controller"], "case k % 3 when 0 then 'Sales-OrdersController' when 1 then 'UsersController' else 'PlainController' end".replace("Sales-Orders", "SalesOrders")), entities=(lambda: _text(classify.inferred_backend(c("u"))["entities"]), "case k % 3 when 0 then 'SalesOrder' when 1 then 'User' else 'Plain' end"))
scalar(
    "prj_05_refutations", "select l_orderkey * 10 + l_linenumber as k, case l_linenumber % 4 when 0 then 'REFUTED_LIKELY_DEAD' when 1 then 'nonsense' when 2 then '' end as subtype, l_linenumber % 4 = 2 as bare, l_linenumber - 3 as attempts, case when l_linenumber = 5 then '  ' else ' why ' end as reason from lineitem",
    subtype=(lambda: evidence.refutation(c("subtype"), c("bare"), c("attempts"), c("reason"))["subtype"], "case k % 10 % 4 when 0 then 'REFUTED_LIKELY_DEAD' when 1 then 'REFUTED_UNREACHABLE_BY_ROBOT' when 2 then 'REFUTED_UNREACHABLE_BY_ROBOT' end"),
    attempts=(lambda: evidence.refutation(c("subtype"), c("bare"), c("attempts"), c("reason"))["attempts"].cast("long"), "case when k % 10 % 4 in (0, 1) and attempts >= 0 then attempts end"), reason=(lambda: evidence.refutation(c("subtype"), c("bare"), c("attempts"), c("reason"))["reason"], "case when k % 10 % 4 in (0, 1) and k % 10 <> 5 then 'why' end"),
)
scalar("prj_12_guards", "select o_orderkey as k, case o_orderkey % 3 when 0 then 'ADMIN,X' when 1 then 'USER' else '' end as r from orders", guarded=(lambda: F.size(F.filter(F.split("r", ","), lambda x: x != "")) > 0, "r <> ''"), admin=(lambda: F.exists(F.split("r", ","), lambda x: x.rlike(cat.ADMIN_ROLES)), "k % 3 = 0"))
scalar("imp_02_candidate_symbols", PATHS, bare=(lambda: F.get(matching.candidate_symbols(c("path")), 1), r"case when suffix(path, '.java') or suffix(path, '.kt') then regexp_replace(list_last(string_split(path, '/')), '(ServiceV1|Controller|Repository)\.(java|kt)$', '') when suffix(path, '.sql') then case when contains(path, '/') then path end when suffix(path, '.routes.ts') then regexp_replace(list_last(string_split(path, '/')), '.routes.ts', '') when contains(path, '/') then regexp_replace(path, '.vue$', '') end"))
scalar("set_02_ordered_union", "select p_partkey as k, 'b,a,' || p_brand as x, p_brand || ',c,a' as y from part", both=(lambda: _text(F.array_union(F.split("x", ","), F.split("y", ","))), "'b|a|' || split_part(x, ',', 3) || '|c'"))
scalar("set_04_same_sets", "select p_partkey as k, 'b,a' as x, case when p_size % 2 = 0 then 'a,b' else 'a,b,b' end as y from part", same=(lambda: (F.size(F.split("x", ",")) == F.size(F.split("y", ","))) & (F.sort_array(F.split("x", ",")) == F.sort_array(F.split("y", ","))), "y = 'a,b'"))
scalar("set_06_shared_symbols", "select p_partkey as k, 'a,b,' || p_brand as x, case when p_size % 2 = 0 then p_brand || ',b' else 'z' end as y from part", shared=(lambda: _text(F.array_sort(F.array_intersect(F.split("x", ","), F.split("y", ",")))), "case when y = 'z' then '' else split_part(x, ',', 3) || '|b' end"))
