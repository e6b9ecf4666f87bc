"""Sinks: partitioned snapshots, findings as SARIF, signed reports."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str, run_id: str) -> None:
    """SNK-02: one partition per run; a repeated run replaces its own."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_rows(df: DataFrame, path: str) -> None:
    """SNK-01: rows of any number in one write; Spark makes the batches."""
    df.write.mode("append").parquet(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """SNK-06: one JSON result per finding (entry_id, type, severity)."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    return findings.select(F.to_json(F.struct(F.col("type").alias("ruleId"), level.alias("level"), F.struct(F.concat(F.col("type"), F.lit(" at "), F.col("entry_id")).alias("text")).alias("message"))).alias("result"))


def canonical(value: object) -> str:
    """FN-22: JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_columns(size: Column, brand: Column) -> Column:
    """FN-22 on columns: to_json writes the fields in the order given, so they are given sorted."""
    return F.to_json(F.struct(brand.alias("brand"), size.alias("size")))


def sign_report(report: dict, key: bytes) -> dict:
    """SNK-07: content hash and HMAC over the canonical form."""
    text = canonical(report).encode()
    return {"report": report, "sha256": hashlib.sha256(text).hexdigest(), "hmac": hmac.new(key, text, "sha256").hexdigest()}


def verify_report(signed: dict, key: bytes) -> bool:
    return hmac.compare_digest(sign_report(signed["report"], key)["hmac"], signed["hmac"])
