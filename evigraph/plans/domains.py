"""Queries over domains: crowds of five services a customer, a bridge between some of them, and one service that all call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import classify, domains, overlays
from evigraph.plans.queries import METHOD, _add
from evigraph.plans.scalars import made

K = "cast(c_custkey as varchar(20))"
_FIVE = "(select 1 as i union all select 2 union all select 3 union all select 4 union all select 5) as five"
_PAIRS = "(select 1 as i, 2 as j union all select 1, 3 union all select 1, 4 union all select 1, 5 union all select 2, 3 union all select 2, 4 union all select 2, 5 union all select 3, 4 union all select 3, 5 union all select 4, 5) as pairs"
_ID = "'SERVICE:shop.d' || {k} || '.S' || cast({i} as varchar(20))"
HUB = "SERVICE:shop.shared.Logger"
NODES = f"select {_ID.format(k=K, i='i')} as id from customer cross join {_FIVE} union all select '{HUB}' as id union all select '{HUB}.Idle'"
_KNOWN = "case (c_custkey + i) % 4 when 0 then 'compiler' when 1 then 'convention-name' end as resolution, i = 5 as synthetic, c_custkey % 5 = 0 and i = 1 as observed, c_custkey % 7 = 0 as config_proven"
EDGES = f"""select {_ID.format(k=K, i='i')} as src, {_ID.format(k=K, i='j')} as dst, 'CALLS' as rel, {_KNOWN} from customer cross join {_PAIRS}
union all select {_ID.format(k=K, i='i')}, '{HUB}', 'CALLS', {_KNOWN} from customer cross join {_FIVE}
union all select {_ID.format(k=K, i='1')}, {_ID.format(k='cast(c_custkey + 1 as varchar(20))', i='1')}, 'CALLS', {_KNOWN.replace("i)", "1)").replace("i = ", "1 = ")} from customer where c_custkey % 3 = 0 and c_custkey in (select c_custkey - 1 from customer)"""
CROWDS = f"""with n as ({NODES}), e as ({EDGES}), em as (select *, {METHOD} as m from e), w as (select c_custkey as k, 'SERVICE:shop.d' || c_custkey || '.S1' as domain from customer),
d as (select id, case when id like '{HUB}%' then null else regexp_replace(id, '[.]S[0-9]$', '.S1') end as domain, id = '{HUB}' as hub from n)"""


def _detected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = made(spark, d, EDGES)
    return e, domains.detect(e, made(spark, d, NODES), hub_share=0.9999)


_add("gra_15_domains", lambda spark, d: _detected(spark, d)[1], CROWDS + " select * from d")
_add("gra_15_domain_names", lambda spark, d: domains.summary(_detected(spark, d)[1]), CROWDS + " select domain, 5::bigint as size, 'd' || k as name from w")
_BETWEEN = "b as (select a.domain as x, c.domain as y, m from em join d a on src = a.id join d c on dst = c.id where a.domain <> c.domain)"
_add("gra_15_domain_seams", lambda spark, d: domains.seams(*_detected(spark, d)), CROWDS + f", {_BETWEEN} select least(x, y) as one, greatest(x, y) as other, count(*) as edges from b group by 1, 2")
_seam_evidence = lambda e, found: overlays.seams(e, found.select("id", "domain"))
_add("ui_05_domain_seams", lambda spark, d: _seam_evidence(*_detected(spark, d)), CROWDS + f", {_BETWEEN} select x as from_domain, y as to_domain, m as method, count(*) as edges from b group by all")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    e, found = _detected(spark, d)
    return classify.domain_evidence(e, found.where("domain is not null")).where(F.col("domain").isNotNull())


_add(
    "ui_04_domains",
    _evidence,
    CROWDS + """, t as (select a.domain as sd, b.domain as dd, m from em left join d a on src = a.id left join d b on dst = b.id), u as (select sd as domain, m from t where sd is not null union all select dd, m from t where dd is not null and dd is distinct from sd),
g as (select domain, count(*) as edges, arg_min(m, case m when 'RUNTIME_OBSERVED' then 5 when 'STATIC_PROVEN' then 4 when 'CONFIG_PROVEN' then 3 when 'STATIC_UNRESOLVED' then 2 else 1 end) as worst, count(*) filter (where m in ('RUNTIME_OBSERVED', 'STATIC_PROVEN', 'CONFIG_PROVEN')) as p from u group by domain)
select domain, 5::bigint as size, edges, worst, round(p / edges, 6) as proven_share from g""",
)
