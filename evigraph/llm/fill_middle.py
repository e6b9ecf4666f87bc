"""Fill-in-middle arrangements with built-in functions only.

A text is cut into units (runs of ASCII letters, or one other code point). A digest of the seed and the id gives two cuts and the form: the
text as it is (plain), prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each part behind its own mark. Because a
text that holds a mark stays plain, the marks of an output can be read back without escapes.

Everything is computed in place, row by row: no shuffle, no key. The units of a text are one array beside it.

Rows: a null text is empty, and an empty text is plain; a null id is cut as the empty id and stays null; repeated rows are
cut alike; equal cuts leave an empty middle; texts are taken whole, whatever their length; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = "<[PSM]>"
#: Forms: the marks in the order in which they stand.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


def _number(digest: Column, group: int) -> Column:
    """The group-th 8 hexadecimal digits (from 0) of a digest as an unsigned number."""
    return F.conv(F.substring(digest, 1 + 8 * group, 8), 16, 10).cast("long")


def _joined(units: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(units, start, length), "")


def arrange(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """One row per input row: id, n (units), form, prefix, middle, suffix (null if plain) and output."""
    base = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    read = base.select(
        "_id",
        "_text",
        F.regexp_extract_all("_text", F.lit(UNITS), 0).alias("_units"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256).alias("_digest"),
    )
    drawn = read.select("_id", "_text", "_units", F.size("_units").cast("long").alias("n"), *[_number(F.col("_digest"), i).alias(f"_h{i + 1}") for i in range(4)])
    one, two = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    plain = (F.col("_text") == "") | F.col("_text").rlike(MARK) | (F.col("_h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm")
    cut = drawn.select("_id", "_text", "_units", "n", form.alias("form"), F.least(one, two).cast("int").alias("_a"), F.greatest(one, two).cast("int").alias("_b"))
    part = lambda start, length: F.when(F.col("form") != "plain", _joined(F.col("_units"), start, length))
    parts = cut.select(
        "_id",
        "_text",
        "n",
        "form",
        part(F.lit(1), F.col("_a")).alias("prefix"),
        part(F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("middle"),
        part(F.col("_b") + 1, F.col("n").cast("int") - F.col("_b")).alias("suffix"),
    )
    named = {PREFIX: "prefix", SUFFIX: "suffix", MIDDLE: "middle"}
    laid = lambda form: F.concat(*[x for mark in ORDERS[form] for x in (F.lit(mark), F.col(named[mark]))])
    output = F.when(F.col("form") == "psm", laid("psm")).when(F.col("form") == "spm", laid("spm")).otherwise(F.col("_text"))
    return parts.select(F.col("_id").alias(id_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text, read from the marks of an output; null if the marks aren't those of the form, in its order."""
    pieces = F.split(output, MARK, -1)
    told = F.regexp_extract_all(output, F.lit(MARK), 0)

    def back(name: str) -> Column:
        at = {mark: i + 1 for i, mark in enumerate(ORDERS[name])}
        right = (told == F.array(*[F.lit(m) for m in ORDERS[name]])) & (F.get(pieces, F.lit(0)) == "")
        return F.when(right, F.concat(*[F.get(pieces, F.lit(at[m])) for m in (PREFIX, MIDDLE, SUFFIX)]))

    return F.when(form == "plain", output).when(form == "psm", back("psm")).when(form == "spm", back("spm"))


def query(spark, sf_dir: str) -> DataFrame:
    out = arrange(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
with u as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as us, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
d as (
  select doc_id, t, us, len(us)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from u),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (
  select doc_id, t, n, form, coalesce(array_to_string(us[1:a], ''), '') as pre, coalesce(array_to_string(us[a + 1:b], ''), '') as mid, coalesce(array_to_string(us[b + 1:n], ''), '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from p
"""
