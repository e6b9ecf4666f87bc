"""Reports on small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from evigraph.operators import reports


def axes(spark, pushes=(), runs=(), traces=()):
    df = reports.health(
        spark.createDataFrame(list(pushes), "axis string, seq long, pushed_at string"), spark.createDataFrame(list(runs), "id long, status string, started string, completed string").selectExpr("id", "status", "timestamp(started) as started", "timestamp(completed) as completed"),
        spark.createDataFrame(list(traces), "trace_id long, last_seen string, anchored boolean").selectExpr("trace_id", "timestamp(last_seen) as last_seen", "anchored"), F.lit("2024-01-10 00:00:00"),
    )
    return {r["axis"]: (r["status"], r["reason"]) for r in df.collect()}, tuple(reports.overall(df).first())


def test_health(spark):
    nothing = {"static": ("absent", "never-pushed"), "config": ("absent", "never-pushed"), "runtime": ("absent", "no-traces"), "analysis": ("absent", "never-analyzed")}
    assert axes(spark) == (nothing, ("starving", "runtime"))
    got = axes(spark, [("static", 1, "2024-01-09"), ("static", 2, "2024-01-03 00:00:00"), ("config", 1, None)], [(1, "completed", "2024-01-09", None), (2, "Failed", "2024-01-09 23:00:00", None)], [(1, "2024-01-09 23:30:00", False)])
    assert got == ({"static": ("fresh", None), "config": ("unknown", "no-timestamp"), "runtime": ("absent", "no-anchorable-traces"), "analysis": ("stale", "last-run-failed")}, ("degraded", "analysis,runtime"))
    got = axes(spark, [("static", 1, "2024-01-02 23:59:00"), ("config", 1, "nonsense")], [(1, "completed", "2024-01-01", "2024-01-09")], [(1, "2024-01-08", False), (2, "2024-01-09 12:00:00", True)])
    assert got == ({"static": ("stale", None), "config": ("unknown", "invalid-timestamp"), "runtime": ("fresh", None), "analysis": ("fresh", None)}, ("degraded", "static"))


def test_completeness(spark):
    rows = [("a", "x"), ("a", "x"), ("b", "y"), ("c", "x"), ("c", "y"), ("d", "x"), ("d", "y"), ("d", "z")]
    assert tuple(reports.completeness(spark.createDataFrame(rows, "item string, occasion string")).first()) == (4, 2, 1, 4.5, 4.3333, 0.0769)
    assert tuple(reports.completeness(spark.createDataFrame([], "item string, occasion string")).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize(
    "file,package",
    [("src/main/java/com/acme/shop/cart/A.java", "acme/shop/cart"), ("src/A.java", "src"), ("A.java", "(root)"), ("a/tests/b/C.ts", None), ("/server/x//y/z/w/C.ts", "server/x/y"), ("src/main/A.ts", "main"), (None, None)],
)
def test_package_of(spark, file, package):
    assert spark.createDataFrame([(file,)], "file string").select(reports.package_of(F.col("file"))).first()[0] == package
