"""Host-level quality rules with built-in functions only.

Per document: word, symbol, repeated-line and repeated-window counts and the base rules on them. Per host: failures over
documents, shrunk towards an empirical beta prior (method of moments over the hosts' rates). A document is kept if it
passes the base rules and its host's shrunk failure rate is under the limit.

Everything per document is computed in place on arrays; only (host, counts) are shuffled, pre-aggregated before. Windows of
three words are compared by 64-bit hashes.

Rows: a null or empty text has no words and fails; a null host is a host of its own, a null id stays null; repeated rows count each;
a rate at the limit fails its host; texts are taken whole, whatever their length; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import written

SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Strength of the prior where the hosts' rates don't vary, so that moments give none.
FLAT_PRIOR = 10.0


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed, one row per input row."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    flat = F.trim(F.translate(text, SPACES, " " * len(SPACES)))
    base = df.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).cast("string").alias("_text"))
    words = base.select(
        "_id",
        "_host",
        F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +")).alias("_words"),
        F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: _without(x, SPACES) != "").alias("_lines"),
    )
    windows = words.select(
        "_id",
        "_host",
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("sort_array(transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> struct(xxhash64(w, get(_words, i + 1), get(_words, i + 2)) as h, i as i)))").alias("_windows"),
    )
    covered = F.expr(
        """aggregate(
             sort_array(transform(filter(_windows, (x, j) -> x.h = get(_windows, j - 1).h or x.h = get(_windows, j + 1).h), x -> x.i)),
             named_struct('n', 0L, 'last', -3),
             (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p),
             a -> a.n)"""
    )
    counted = windows.select("_id", "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumnsRenamed({"_id": id_col, "_host": host_col})


def host_rates(feats: DataFrame, host_col: str = "source") -> DataFrame:
    """Per host: n, failed and the shrunk failure rate. The prior's two numbers are one row on the driver."""
    hosts = feats.groupBy(host_col).agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    rate = F.col("failed") / F.col("n")
    got = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    mean, var = got["m"] or 0.0, got["v"] or 0.0
    strength = mean * (1 - mean) / var - 1 if var > 1e-12 else FLAT_PRIOR
    strength = strength if strength > 0 else FLAT_PRIOR
    return hosts.withColumn("rate", (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row per input row: the features, base_failed, host_rate and kept."""
    feats = written(features(df, id_col, text_col, host_col), "host-rules")
    hosts = host_rates(feats, host_col).select(F.col(host_col).alias("_host"), F.col("rate").alias("host_rate"))
    joined = feats.join(hosts, F.col(host_col).eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") < max_rate))


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
with w as (
  select doc_id, source, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
win as (
  select doc_id, unnest(range(1, len(ws) - 1)) as i, unnest(list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])) as g from w),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) group by doc_id),
f as (
  select w.doc_id, w.source, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
  from w left join cov on w.doc_id = cov.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
h as (select source, count(*) as n, count(*) filter (where base_failed) as failed from b group by source),
p as (select avg(failed / n) as m, var_pop(failed / n) as v from h),
s as (select m, case when v > 1e-12 and m * (1 - m) / v - 1 > 0 then m * (1 - m) / v - 1 else 10.0 end as k from p)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and (h.failed + s.m * s.k) / (h.n + s.k) < 0.5 as kept
from b join h on b.source is not distinct from h.source, s
"""
