"""Queries over two manifests, raw metadata and table functions, each with its SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import tables
from evigraph.operators import evidence, manifests
from evigraph.plans.adapters import catalog, frame, with_frames
from evigraph.plans.queries import LISTS, METHOD, _add
from evigraph.plans.scalars import made

_V = "varchar(20)"
#: The manifest before holds entries that the one after doesn't, and the other way round; some endpoints change theirs.
_WAS, _NOW = "entry_id % 5 <> 0", "entry_id % 5 <> 1"


def _endpoints(spark: SparkSession, d: str, where: str) -> DataFrame:
    e = catalog(spark, d).where(where)
    return e.select(F.col("entry_id").alias("seq"), F.col("endpoint").alias("path"), F.lower("http_method").alias("method"), "roles", "criticality", "entities", "operation", "sensitive_fields")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return manifests.endpoint_changes(_endpoints(spark, d, _WAS), _endpoints(spark, d, _NOW))


_KEYED = """select key, r, criticality, e, operation, f from (select http_method || ':' || endpoint as key, list_sort(list_distinct(roles)) as r, criticality, list_sort(list_distinct(entities)) as e, operation, list_sort(list_distinct(fields)) as f,
  row_number() over (partition by http_method, endpoint order by entry_id desc) as k from c where {w}) where k = 1"""
CHANGES = LISTS + f""", a as ({_KEYED.format(w=_WAS)}), b as ({_KEYED.format(w=_NOW)}),
ch as (select coalesce(a.key, b.key) as key, case when a.key is null then 'added' when b.key is null then 'removed' else 'modified' end as change,
  case when a.key is null or b.key is null then [] else list_filter([case when a.r <> b.r then 'roles' end, case when a.criticality <> b.criticality then 'criticality' end, case when a.e <> b.e then 'entities' end, case when a.operation <> b.operation then 'operation' end, case when a.f <> b.f then 'sensitive_fields' end], lambda x: x is not null) end as what,
  a.r as ar, b.r as br, a.criticality as ac, b.criticality as bc from a full outer join b on a.key = b.key), cc as (select * from ch where change <> 'modified' or len(what) > 0)"""
_add("imp_06_endpoint_changes", lambda spark, d: _changes(spark, d).select("key", "change", F.array_join("what", ",").alias("what")), CHANGES + " select key, change, array_to_string(what, ',') as what from cc")
_add(
    "imp_06_security",
    lambda spark, d: manifests.security(_endpoints(spark, d, _WAS), _endpoints(spark, d, _NOW), _changes(spark, d)),
    CHANGES + """, n as (select count(*) as n, count(*) filter (where change = 'added' and len(br) = 0) as open_added, count(*) filter (where change = 'added' and len(br) = 0 and bc >= 70) as high, count(*) filter (where change = 'modified' and len(ar) > 0 and len(br) = 0) as unprotected,
  count(*) filter (where change = 'modified' and bc > ac) as risen, (select floor(count(*) filter (where len(r) > 0) * 100 / count(*) + 0.5)::bigint from a) as coverage_before, (select floor(count(*) filter (where len(r) > 0) * 100 / count(*) + 0.5)::bigint from b) as coverage_after from cc)
select open_added, unprotected, risen, coverage_before, coverage_after, case when unprotected > 0 then 'critical' when high > 0 then 'high' when open_added > 0 then 'medium' when risen > 0 or coverage_after - coverage_before < -5 then 'low' when n = 0 then 'none' else 'low' end as level from n""",
)

#: Screens with interactions and guards, roles with endpoints, entities with fields and operations, by (name, part, item) and the manifests that have it.
_SCREENS = f"select 'Screen' || cast(c_custkey % 60 as {_V}) as name, case when c_custkey % 4 = 0 then 'guards' else 'interactions' end as part, 'i' || cast(c_nationkey as {_V}) as item, c_custkey % 60 <> 7 and c_custkey % 61 <> 0 as was, c_custkey % 60 <> 8 and c_custkey % 83 <> 0 as now from customer"
_ROLES = f"select 'ROLE' || cast(o_custkey % 30 as {_V}) as name, 'endpoints' as part, 'GET:/e/' || cast(o_orderkey % 50 as {_V}) as item, o_custkey % 30 <> 3 and o_orderkey % 97 <> 0 as was, o_custkey % 30 <> 4 and o_orderkey % 89 <> 0 as now from orders"
_ENTITIES = f"select p_brand as name, case when p_size % 2 = 0 then 'fields' else 'operations' end as part, 'x' || cast(p_size as {_V}) as item, p_brand <> 'Brand#11' and p_partkey % 71 <> 0 as was, p_brand <> 'Brand#12' and p_partkey % 67 <> 0 as now from part"
_PARTS = {"screens": (_SCREENS, ("interactions", "guards")), "roles": (_ROLES, ("endpoints",)), "entities": (_ENTITIES, ("fields", "operations"))}


def _named(spark: SparkSession, d: str, section: str) -> DataFrame:
    sql, parts = _PARTS[section]
    rows = made(spark, d, sql)
    of = lambda side: (rows.where(side).select("name"), {p: rows.where(side).where(F.col("part") == p) for p in parts})
    return manifests.named_changes(of("was"), of("now"))


def _named_sql(section: str) -> str:
    return f"""with s as ({_PARTS[section][0]}), n as (select name, bool_or(was) as a, bool_or(now) as b from s group by name having bool_or(was) or bool_or(now)), i as (select name, part, item, bool_or(was) as a, bool_or(now) as b from s group by all),
m as (select name, part, count(*) filter (where b and not a) as came, count(*) filter (where a and not b) as went from i group by name, part), t as (select name, '+' || came || ' ' || part as w from m where came > 0 union all select name, '-' || went || ' ' || part from m where went > 0),
l as (select name, string_agg(w, ',' order by w) as what from t group by name)
select n.name, case when not a then 'added' when not b then 'removed' else 'modified' end as change, case when a and b then what else '' end as what from n left join l on n.name = l.name where not (a and b) or what is not null"""


for _s in _PARTS:
    _add(f"imp_06_{_s}", lambda spark, d, s=_s: _named(spark, d, s).select("name", "change", F.array_join("what", ",").alias("what")), _named_sql(_s))
_add(
    "imp_06_summary",
    lambda spark, d: manifests.summary({"endpoints": _changes(spark, d)} | {s: _named(spark, d, s) for s in _PARTS}),
    CHANGES + " select 'endpoints' as section, change, count(*) as n from cc group by change" + "".join(f" union all select '{s}', change, count(*) from ({_named_sql(s)}) group by change" for s in _PARTS),
)

_BEFORE, _AFTER = "entry_id % 3 <> 0", "entry_id % 3 <> 1 and not (entities like '%BUILDING%' and http_method <> 'POST')"
_GONE = "case when endpoint like '%/7' then '' else entities end"


def _entries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = frame(spark, d, "catalog").select("entry_id", "endpoint", "http_method", "operation", "entities")
    split = F.when(F.col("entities") == "", F.array().cast("array<string>")).otherwise(F.split("entities", ","))
    return e.where(_BEFORE).withColumn("entities", split), e.where(_AFTER).withColumn("entities", F.expr(_GONE)).withColumn("entities", split)


_VERB = "case when operation like 'delete%' then 'DELETE' when operation like 'update%' then 'UPDATE' when operation like 'create%' then 'CREATE' when operation like 'find%' or operation like 'list%' then 'READ' else 'OTHER' end"
_add(
    "imp_07_regressions",
    lambda spark, d: manifests.regressions(*_entries(spark, d)),
    with_frames("catalog") + f""", a as (select endpoint, entities, {_VERB} as verb from catalog where {_BEFORE}), b as (select endpoint, {_GONE} as entities, {_VERB} as verb from catalog where {_AFTER}),
ta as (select endpoint, bool_or(entities <> '') as l from a group by endpoint), tb as (select endpoint, bool_or(entities <> '') as l from b group by endpoint), s as (select (select floor(count(*) filter (where l) * 100 / count(*) + 0.5) from ta) - (select floor(count(*) filter (where l) * 100 / count(*) + 0.5) from tb) as points),
xa as (select endpoint, verb, unnest(string_split(entities, ',')) as entity from a where entities <> '' and verb <> 'OTHER'), xb as (select endpoint, verb, unnest(string_split(entities, ',')) as entity from b where entities <> '' and verb <> 'OTHER'),
oa as (select verb || ':' || entity as k from xa where verb <> 'READ' group by verb, entity having count(distinct endpoint) >= 2), ob as (select verb || ':' || entity as k from xb where verb <> 'READ' group by verb, entity having count(distinct endpoint) >= 2),
ga as (select entity as k from xa group by entity having bool_or(verb <> 'READ') and not bool_or(verb = 'READ')), gb as (select entity as k from xb group by entity having bool_or(verb <> 'READ') and not bool_or(verb = 'READ'))
select 'REMOVED_ENDPOINT' as kind, 'low' as severity, endpoint as target from ta where endpoint not in (select endpoint from tb) union all select 'LOST_ENTITY_LINK', 'high', ta.endpoint from ta join tb on ta.endpoint = tb.endpoint where ta.l and not tb.l
union all select 'COVERAGE_DROP', 'medium', 'coverage' from s where points >= 3 union all select 'NEW_OVERLAP', 'medium', k from ob where k not in (select k from oa) union all select 'RESOLVED_OVERLAP', null, k from oa where k not in (select k from ob)
union all select 'NEW_LIFECYCLE_GAP', 'medium', k from gb where k not in (select k from ga) union all select 'RESOLVED_LIFECYCLE_GAP', null, k from ga where k not in (select k from gb)""",
)

#: Edges with their provenance as JSON; some of it is cut off, some has a field of another type.
METADATA = f"""select src, dst, rel, case when weight % 5 = 4 then '{{"resolution": "compi' else '{{' || case when resolution is not null then '"resolution": "' || resolution || '", ' else '' end || '"synthetic": ' || case when synthetic then 'true' else 'false' end || ', "observed": ' || case when observed then 'true' else 'false' end
  || ', "configProven": ' || case when config_proven then 'true' else 'null' end || ', "count": ' || case when weight = 3 then '"many"' else cast(weight as {_V}) end || ', "refutation": {{"subtype": "R' || cast(weight as {_V}) || '"}}}}' end as metadata"""


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(METADATA.replace("{", "{{").replace("}", "}}") + " from {e}", e=frame(spark, d, "edges"))
    m = evidence.edge_evidence(evidence.from_metadata(rows))
    return m.groupBy("rel", "method", "refuted", "broken").agg(F.count("*").alias("edges"), F.sum("count").alias("observations"))


_add(
    "fn_30_metadata_evidence",
    _metadata,
    with_frames("edges") + f""", e as (select rel, weight % 5 = 4 as broken, case when weight % 5 <> 4 then resolution end as resolution, weight % 5 <> 4 and synthetic as synthetic, weight % 5 <> 4 and observed as observed, weight % 5 <> 4 and config_proven as config_proven, weight from edges)
select rel, {METHOD} as method, case when not broken then 'R' || weight end as refuted, broken, count(*) as edges, sum(case when not broken and weight <> 3 then weight end)::bigint as observations from e group by all""",
)

_DIFFS = f"""select p_partkey as diff_id, '--- a/src/F' || cast(p_size as {_V}) || '.ts' || chr(10) || case when p_size % 3 = 0 then '+++ /dev/null' else '+++ b/src/F' || cast(p_size as {_V}) || '.ts' end || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' same' || chr(10) || '-old ' || p_brand || chr(10) || '+new'
  || chr(10) || '@@ -9 +9 @@' || chr(10) || '--- not a header' || chr(10) || '-- a comment' as diff from part"""


def _sql_tables(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark)
    return spark.sql("select diff_id, c.* from {diffs}, lateral changed_lines(diff) as c", diffs=made(spark, d, _DIFFS))


_add("udf_05_changed_lines", _sql_tables, "select p_partkey as diff_id, 5 as no, '-' as sign, 'old ' || p_brand as line from part union all select p_partkey, 6, '+', 'new' from part union all select p_partkey, 9, '-', '- a comment' from part")


def _diff_reader(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark)
    lines = made(spark, d, _DIFFS.replace("'--- not a header'", "'-minus'")).select("diff_id", F.posexplode(F.split("diff", "\n")).alias("no", "line"))
    return spark.sql("select file, status, hunk, sign, line from diff_reader(table(select * from {lines}) partition by diff_id order by no)", lines=lines).groupBy("file", "status", "hunk", "sign").agg(F.count("*").alias("n"), F.max("line").alias("last"))


_add(
    "udf_05_diff_reader",
    _diff_reader,
    """with p as (select 'src/F' || p_size || '.ts' as file, case when p_size % 3 = 0 then 'removed' else 'modified' end as status, p_brand from part),
l as (select file, status, 1 as hunk, ' ' as sign, 'same' as line from p union all select file, status, 1, '-', 'old ' || p_brand from p union all select file, status, 1, '+', 'new' from p union all select file, status, 2, '-', 'minus' from p union all select file, status, 2, '-', '- a comment' from p)
select file, status, hunk, sign, count(*) as n, max(line) as last from l group by all""",
)


def _zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        made_ = []
        for url, html in zip(pdf.url, pdf.html, strict=True):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("page/url.txt", url or "")
                z.writestr("page/index.html", html or "")
            made_.append(out.getvalue())
        yield pd.DataFrame({"page_id": pdf.page_id, "archive": made_})


def _unzipped(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark)
    archives = frame(spark, d, "pages").select("page_id", "url", "html").mapInPandas(_zipped, "page_id long, archive binary")
    return spark.sql("select page_id, f.path, sha2(f.content, 256) as hash from {archives}, lateral unzip(archive) as f", archives=archives)


_add("src_01_unzip", _unzipped, "select page_id, 'page/url.txt' as path, sha256(coalesce(url, '')) as hash from pages union all select page_id, 'page/index.html', sha256(coalesce(html, '')) from pages")
