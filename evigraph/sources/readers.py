"""Sources: zip archives of source files, unified diffs, JSON edge payloads with guards."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Limits of one payload.
MOST_EDGES, MOST_CONFIG = 500_000, 100_000
EDGE_SCHEMA = "from string, to string, kind string, resolution string"


def file_type(path):
    """SRC-02"""
    p = F.lower(path)
    return F.when(p.endswith(".java"), "java").when(p.endswith(".vue"), "vue").when(p.rlike("[.](ts|tsx)$"), "typescript").when(p.rlike("[.](js|jsx|mjs)$"), "javascript").when(p.endswith(".sql"), "sql").otherwise("other")


def zip_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: (path, content) of the text files in zip archives; one archive per task step, one member in memory."""

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            for data in pdf.content:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pd.DataFrame({"path": [name], "content": [z.read(name).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "path string, content string")


def unified_diff(diffs: DataFrame) -> DataFrame:
    """SRC-11: (diff_id, text) -> diff_id, file, status, hunk, line_no, sign, line. Markers run on until the next one."""
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    w = Window.partitionBy("diff_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").rlike("^(---|\\+\\+\\+) ")
    marked = lines.withColumns(
        {
            "old": F.last(F.when(F.col("line").startswith("--- "), F.regexp_replace("line", "^--- (a/)?", "")), True).over(w),
            "file": F.last(F.when(F.col("line").startswith("+++ "), F.regexp_replace("line", "^\\+\\+\\+ (b/)?", "")), True).over(w),
            "hunk": F.sum(F.when(F.col("line").startswith("@@"), 1).otherwise(0)).over(w),
        }
    )
    body = marked.where(~head & (F.col("hunk") > 0) & F.col("line").rlike("^[ +-]"))
    status = F.when(F.col("old") == "/dev/null", "added").when(F.col("file") == "/dev/null", "removed").otherwise("modified")
    return body.select("diff_id", F.when(F.col("file") == "/dev/null", F.col("old")).otherwise(F.col("file")).alias("file"), status.alias("status"), "hunk", "no", F.substring("line", 1, 1).alias("sign"), F.substring("line", 2, 1 << 30).alias("line"))


def edge_payload(spark: SparkSession, path: str, most: int = MOST_EDGES) -> DataFrame:
    """SRC-05: JSON lines of edges; malformed rows fail, and so do more than `most` rows. Of a folder of payloads (payload=<name>/), each may have so many."""
    df = spark.read.schema(EDGE_SCHEMA).option("mode", "FAILFAST").json(path)
    return _guarded(df, most)


def config_payload(edges: DataFrame, most: int = MOST_CONFIG) -> DataFrame:
    """SRC-06: the rows of payloads that a configuration proves; more than `most` of one fail."""
    return _guarded(edges.where("resolution = 'config'"), most)


def _guarded(edges: DataFrame, most: int) -> DataFrame:
    sizes = edges.groupBy(*[c for c in edges.columns if c == "payload"]).agg(F.count("*").alias("n"))
    n = sizes.agg(F.max("n")).first()[0] or 0
    if n > most:
        raise ValueError(f"{n} edges; at most {most} are taken")
    return edges
