import random

from evigraph.functions import sql
from evigraph.operators import assembly, code, domains, fixpoint, overlays, runtime, stores


def test_communities_are_the_dense_parts(spark):
    rows = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0"), ("c0", "c1")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in sorted({v for r in rows for v in r} | {"alone"})], "id string")
    got = {r["id"]: r["domain"] for r in domains.detect(edges, nodes, hub_share=1.0).collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and len({got[f"b{i}"] for i in range(5)}) == 1 and got["a1"] != got["b1"]
    assert got["c0"] is None and got["alone"] is None


def test_components_of_two_linked_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "x")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdefx"], "id string")
    got = {r["node"]: r["component"] for r in fixpoint.strong_components(edges, nodes).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "x": "x"}


def test_fixpoints_go_on_beyond_forty_steps(spark):
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", 0.9) for i in range(45)], "src string, dst string, confidence double")
    root = spark.createDataFrame([("n045",)], "id string")
    assert fixpoint.widest(chain, root).count() == 46


def test_innermost_of_nested_and_crossing_ranges(spark):
    ranges = [("d", 0, 100, "outer"), ("d", 10, 20, "inner"), ("d", 15, 60, "later"), ("d", 5, 5, "empty"), ("e", 0, 7, "other")]
    points = [("d", p) for p in (0, 9, 10, 19, 20, 59, 60, 99, 100)] + [("e", 6), ("e", 7), ("f", 1)]
    got = {(r["doc"], r["p"]): r["name"] for r in runtime.innermost(spark.createDataFrame(points, "doc string, p long"), spark.createDataFrame(ranges, "doc string, lo long, hi long, name string")).collect()}
    want = {}
    for doc, p in points:
        hits = [(lo, -hi, name) for d, lo, hi, name in ranges if d == doc and lo <= p < hi]
        if hits:
            want[doc, p] = max(hits)[2]
    assert got == want


def test_walk_stops_at_entities_and_depth(spark):
    node = "id string, seq string, type string, class_name string, method_name string, http_method string, full_path string, synthetic boolean, roles array<string>, annotations array<string>, sensitive_fields array<string>, source_file string"
    row = lambda i, t, m=None, roles=(), fields=(): (i, i, t, i.upper(), m, None, None, False, list(roles), [], list(fields), "")
    nodes = spark.createDataFrame([row("c", "CONTROLLER", "go", ["R"]), row("s", "SERVICE", "run", ["Q"]), row("e", "ENTITY", fields=["pin"]), row("t", "SERVICE", "far")], node)
    edges = spark.createDataFrame([("c", "s", "CALLS", None), ("s", "e", "CALLS", None), ("e", "t", "CALLS", None), ("c", "e", "WRITES_ENTITY", "save")], "src string, dst string, rel string, operation string")
    r = assembly.walk(nodes, edges, spark.createDataFrame([("c",)], "id string")).first()
    assert r["services"] == ["S.run"] and r["entities"] == ["E"] and r["operations"] == ["save"] and r["roles"] == ["Q", "R"] and r["sensitive_fields"] == ["E.pin"] and r["depth"] == 2
    shallow = assembly.walk(nodes, edges, spark.createDataFrame([("c",)], "id string"), max_depth=0).first()
    assert shallow["services"] == [] and shallow["entities"] == ["E"]


def test_hmac_on_columns_equals_the_library(spark):
    rows = [(1, "é"), (2, ""), (3, "x" * 500)]
    got = {r["id"]: r["hmac"] for r in stores.signed(spark.createDataFrame(rows, "id long, body string"), b"key").collect()}
    assert got == {i: stores.plain_hmac(t, b"key") for i, t in rows}


def test_too_large_payload_fails(spark):
    import pytest

    body = '{"entities":[' + ",".join('{"name":"a","file":"b"}' for _ in range(4)) + "]}"
    df = spark.createDataFrame([(1, body)], "run_id long, body string")
    assert stores.payload_items(df, 4).count() == 4
    with pytest.raises(Exception, match="too many items"):
        stores.payload_items(df, 3).collect()


def test_sql_functions(spark):
    assert "git_sha" in sql.register(spark)
    assert spark.sql("select snake_case('HTTPServerName') as s").first()["s"] == "http_server_name"


def test_ambiguous_wiring_is_left_out(spark):
    beans = [("I", "A", False, False), ("I", "B", False, False), ("J", "A", False, False), ("K", "A", False, True), ("L", "A", False, False), ("L", "B", True, False)]
    got = {r["interface"]: (r["concrete"], r["reason"]) for r in code.wiring(spark.createDataFrame(beans, "interface string, concrete string, is_primary boolean, opaque boolean"), spark.createDataFrame([], "cls string, parent string")).collect()}
    assert got == {"J": ("A", "single"), "L": ("B", "primary")}


def test_reach_counts_equal_a_plain_walk(spark):
    """Circles, diamonds, loops, nodes that no root reaches, and roots without edges."""
    rng = random.Random(8)
    rows = [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(140)] + [("a", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "n1")]
    roots = ["a", "b", "alone", *[f"n{i}" for i in range(0, 90, 3)]]
    out = {}
    for s, d in rows:
        out.setdefault(s, set()).add(d)

    def walk(root):
        seen, todo = {root}, [root]
        while todo:
            for x in out.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return len(seen) - 1

    got = fixpoint.reach_counts(spark.createDataFrame(rows, "src string, dst string"), spark.createDataFrame([(r,) for r in roots], "id string"))
    assert {r["root"]: r["reached"] for r in got.collect()} == {r: walk(r) for r in roots}
