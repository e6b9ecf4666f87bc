import json
import zipfile

import pytest

from evigraph.operators import models
from evigraph.sources import readers, sinks
from evigraph.streaming import spans as streams


def test_zip_and_file_types(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("src/A.java", "class A {}")
        z.writestr("b.vue", "é")
    df = readers.zip_files(spark, str(tmp_path / "a.zip"))
    got = {r["path"]: (r["content"], r["t"]) for r in df.withColumn("t", readers.file_type(df["path"])).collect()}
    assert got == {"src/A.java": ("class A {}", "java"), "b.vue": ("é", "vue")}


def test_unified_diff(spark):
    text = "--- a/x.ts\n+++ b/x.ts\n@@ -1,2 +1,2 @@\n one\n-two\n+three\n--- /dev/null\n+++ b/new.ts\n@@ -0,0 +1 @@\n+hello\n"
    got = readers.unified_diff(spark.createDataFrame([(1, text)], "diff_id long, text string")).orderBy("no").collect()
    assert [(r["file"], r["status"], r["hunk"], r["sign"], r["line"]) for r in got] == [("x.ts", "modified", 1, " ", "one"), ("x.ts", "modified", 1, "-", "two"), ("x.ts", "modified", 1, "+", "three"), ("new.ts", "added", 2, "+", "hello")]


def test_edge_payload_guard(spark, tmp_path):
    (tmp_path / "e.json").write_text("".join(json.dumps({"from": "a", "to": "b", "kind": "k", "resolution": "compiler"}) + "\n" for _ in range(3)))
    assert readers.edge_payload(spark, str(tmp_path / "e.json")).count() == 3
    with pytest.raises(ValueError):
        readers.edge_payload(spark, str(tmp_path / "e.json"), most=2)


def test_snapshot_replaces_its_own_run(spark, tmp_path):
    path = str(tmp_path / "s")
    for run, n in (("a", 2), ("b", 3), ("a", 1)):
        sinks.write_snapshot(spark.range(n), path, run)
    assert {(r["run_id"], r["count"]) for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {("a", 1), ("b", 3)}


def test_sarif_and_signature(spark):
    row = sinks.sarif_results(spark.createDataFrame([(7, "T", "high")], "entry_id long, type string, severity string")).first()
    assert json.loads(row["result"]) == {"ruleId": "T", "level": "error", "message": {"text": "T at 7"}}
    signed = sinks.sign_report({"b": 1, "a": [2]}, b"k")
    assert sinks.verify_report(signed, b"k") and not sinks.verify_report(signed | {"report": {}}, b"k")


def test_exact_interval():
    low, high = models.clopper_pearson(5, 10)
    assert abs(low - 0.187086) < 1e-5 and abs(high - 0.812914) < 1e-5
    assert models.clopper_pearson(0, 10)[0] == 0 and abs(models.clopper_pearson(0, 10)[1] - 0.308497) < 1e-5


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1, h)
    for k, hours in enumerate(([1, 1, 8], [9], [2, 20], [23])):
        spark.createDataFrame([(i, at(h), "x") for i, h in enumerate(hours)], "event_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p{k}"))
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {(r["began"].hour, r["n"]) for r in streams.run_available(streams.windowed(stream), "append").collect()}
    assert (1, 2) in got and (2, 1) not in got
