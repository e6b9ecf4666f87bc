"""The scalar functions under names that SQL texts can call, and matchers that rules are run with."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name -> (parameters, type, body): SQL functions, so that Catalyst sees through them and no Python runs.
FUNCTIONS = {
    "snake_case": ("name string", "string", r"lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '$1_$2'), '([A-Z]+)([A-Z][a-z])', '$1_$2'))"),
    "git_sha": ("sha string", "string", "case when lower(trim(sha)) rlike '^[0-9a-f]{40}$' then lower(trim(sha)) end"),
    "external_domain": ("url string", "string", "nullif(regexp_extract(url, '(?i)^https?://([^/]+)', 1), '')"),
    "bare_symbol": ("name string", "string", r"trim(substring_index(name, '.', -1))"),
}


def register(spark: SparkSession) -> list[str]:
    """UDF-05: creates the functions for this session; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    return list(FUNCTIONS)


class Matcher(Protocol):
    """UDF-01: how a rule's pattern is tried on a column of lines."""

    def __call__(self, line: Column, pattern: str) -> Column: ...


def by_regex(line: Column, pattern: str) -> Column:
    return line.rlike(pattern)


def by_text(line: Column, pattern: str) -> Column:
    return F.contains(line, F.lit(pattern))


def matched(lines: DataFrame, rules: dict[str, tuple[str, Matcher]]) -> DataFrame:
    """UDF-02: lines(id, line) -> rule, lines: how many lines each rule of the caller's finds, by its own matcher, all in one pass; 0 for none."""
    counts = lines.agg(*(F.count_if(how(F.col("line"), pattern)).alias(rule) for rule, (pattern, how) in rules.items()))
    return counts.unpivot([], list(rules), "rule", "lines")
