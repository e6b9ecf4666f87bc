from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.operators import evidence, fixpoint, runtime


def test_method_order_and_nulls(spark):
    rows = [("a", None, None, True, None), ("b", "config", None, None, None), ("c", "syntactic-declared", None, None, None), ("d", "syntactic-resolved", None, None, None), ("e", "compiler", True, None, None), ("f", None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, resolution string, synthetic boolean, observed boolean, config_proven boolean")
    got = {r["id"]: r["method"] for r in evidence.edge_evidence(df).collect()}
    assert got == {"a": "RUNTIME_OBSERVED", "b": "CONFIG_PROVEN", "c": "STATIC_UNRESOLVED", "d": "STATIC_PROVEN", "e": "STATIC_UNRESOLVED", "f": "UNKNOWN"}


def test_cycle_is_one_component_with_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    parts = fixpoint.strong_components(edges, nodes)
    assert {r["node"]: r["component"] for r in parts.collect()} == {"a": "a", "b": "b", "c": "b", "d": "d", "e": "e"}
    assert {r["component"]: r["level"] for r in fixpoint.levels(edges, parts).collect()} == {"a": 0, "b": 1, "d": 2, "e": 0}


def test_widest_path_takes_the_best_weakest_link(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "r", 0.4), ("a", "c", 0.8), ("c", "r", 0.7)], "src string, dst string, confidence double")
    got = fixpoint.widest(edges, spark.createDataFrame([("r",)], "id string"))
    assert {r["node"]: r["width"] for r in got.collect()} == {"r": 1.0, "b": 0.4, "c": 0.7, "a": 0.7}


def test_reach_stops_at_the_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    root = spark.createDataFrame([("a",)], "id string")
    assert {(r["node"], r["depth"]) for r in fixpoint.reach(edges, root, 1).collect()} == {("a", 0), ("b", 1)}
    assert {(r["node"], r["depth"]) for r in fixpoint.reach(edges, root).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_chao_fixture(spark):
    # three occasions, two items seen once, one twice
    rows = [(1, "a"), (1, "b"), (2, "c"), (1, "c"), (1, "d"), (2, "d"), (3, "d")]
    got = runtime.chao(spark.createDataFrame(rows, "occasion int, item string")).first()
    assert (got["seen"], got["f1"], got["f2"]) == (4, 2, 1) and abs(got["estimate"] - 4.3333) < 1e-4


def test_text_functions(spark):
    row = spark.range(1).select(
        text.snake_case(F.lit("HTTPServerName")).alias("s"), text.path_of(F.lit("https://x.org:80/a/b/?q#f")).alias("p"), text.external_domain(F.lit("/a")).alias("d"),
        text.camel_segments(F.lit("HTTPServerName2")).alias("c"), text.tables_of_sql(F.lit("select 1 from a.B join c on 1=1 join a.b")).alias("t"), text.git_sha(F.lit("zz")).alias("g"), text.normalize_segment(F.lit("{id}")).alias("n"),
    ).first()
    assert row["s"] == "http_server_name" and row["p"] == "/a/b" and row["d"] is None and row["t"] == ["b", "c"] and row["g"] is None and row["n"] == "{id}"
    assert row["c"] == ["HTTP", "Server", "Name2"] or row["c"][0].startswith("HTTP")
