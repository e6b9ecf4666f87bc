"""Dead code, blind impact, impact of a change, drift and risk on small cases with known answers."""

import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from evigraph.operators import snapshots

DEAD, ROBOT = "REFUTED_LIKELY_DEAD", "REFUTED_UNREACHABLE_BY_ROBOT"
NODES = [
    # id, type, entry_point, observed, source_file, verdict
    ("iso", "SERVICE", None, False, "a", "isolated"),
    ("out", "SERVICE", None, False, None, "no-proven-caller"),
    ("entry", "SERVICE", "scheduled", False, "a", "entry-point"),
    ("started", "SERVICE", None, False, "main", "entry-point"),
    ("shared", "SERVICE", None, False, "lib", "import-reachable"),
    ("hot", "SERVICE", None, True, "a", "runtime-observed"),
    ("hot_called", "SERVICE", None, True, "a", None),
    ("view", "VIEW", None, False, "a", "entry-surface"),
    ("entity", "ENTITY", None, False, "a", None),
    ("refuted", "SERVICE", None, False, "lib", "runtime-refuted"),
    ("half", "SERVICE", None, False, "a", None),
    ("robot", "SERVICE", None, False, "a", "unreachable-by-robot"),
    ("node:f", "SERVICE", None, False, "a", None),
    ("node:f::run", "SERVICE", None, False, "a", None),
]
EDGES = [("out", "half", None), ("x", "half", DEAD), ("x", "refuted", DEAD), ("y", "refuted", DEAD), ("x", "robot", DEAD), ("y", "robot", ROBOT), ("x", "hot_called", None), ("x", "node:f::run", None)]


def test_dead_code_and_what_is_excused(spark):
    nodes = spark.createDataFrame([r[:5] for r in NODES], "id string, type string, entry_point string, observed boolean, source_file string")
    edges = spark.createDataFrame(EDGES, "src string, dst string, refuted string")
    one = lambda f: spark.createDataFrame([(f,)], "file string")
    judged = snapshots.liveness(edges, nodes, one("lib"), one("main"))
    assert {r["id"]: r["verdict"] for r in judged.collect()} == {r[0]: r[5] for r in NODES}
    told = Observation()
    got = {r["id"]: (r["tier"], r["confidence"]) for r in snapshots.dead_code(judged, told).collect()}
    assert got == {"iso": ("isolated", 0.75), "out": ("no-proven-caller", 0.4), "refuted": ("runtime-refuted", 0.7)}
    assert told.get == {"entry-point": 2, "entry-surface": 1, "runtime-observed": 1, "unreachable-by-robot": 1, "import-reachable": 1}
    assert {r["verdict"] for r in snapshots.liveness(edges, nodes).where("id = 'shared'").collect()} == {"isolated"}


M = {"o": ("RUNTIME_OBSERVED", 0.95), "p": ("STATIC_PROVEN", 0.8), "c": ("CONFIG_PROVEN", 0.78), "u": ("STATIC_UNRESOLVED", 0.4), "x": ("UNKNOWN", 0.2)}


def links(spark, rows):
    return spark.createDataFrame([(s, d, "CALLS", *M[m]) for s, d, m in rows], "src string, dst string, rel string, method string, confidence double")


def one(spark, root):
    return spark.createDataFrame([(root,)], "id string")


def test_impact_goes_by_the_weakest_link(spark):
    df = links(spark, [("repo", "entity", "p"), ("service", "repo", "p"), ("controller", "service", "p"), ("report", "service", "u"), ("facade", "report", "p"), ("far", "away", "x")])
    found = snapshots.graded(snapshots.impact(df, one(spark, "entity")))
    got = {r["id"]: (r["grade"], r["method"], r["confidence"], r["next"]) for r in found.collect()}
    assert got == {
        "repo": ("proven", "STATIC_PROVEN", 0.8, "entity"), "service": ("proven", "STATIC_PROVEN", 0.8, "repo"), "controller": ("proven", "STATIC_PROVEN", 0.8, "service"),
        "report": ("possible", "STATIC_UNRESOLVED", 0.4, "service"), "facade": ("possible", "STATIC_UNRESOLVED", 0.4, "report"),
    }
    spots = snapshots.blind_spots(df, found, one(spark, "entity"))
    assert [tuple(r) for r in spots.collect()] == [("report", "service", "CALLS", "STATIC_UNRESOLVED")]
    assert snapshots.impact_summary(found, spots).first().asDict() == {"proven": 3, "possible": 2, "overall_confidence": 0.4, "overall_method": "STATIC_UNRESOLVED", "blind_spots": 1}


def test_the_surest_of_several_chains_is_taken(spark):
    df = links(spark, [("repo", "entity", "p"), ("service", "entity", "u"), ("dual", "repo", "o"), ("dual", "service", "u")])
    got = {r["id"]: (r["method"], r["next"]) for r in snapshots.impact(df, one(spark, "entity")).collect()}
    assert got == {"repo": ("STATIC_PROVEN", "entity"), "service": ("STATIC_UNRESOLVED", "entity"), "dual": ("STATIC_PROVEN", "repo")}
    assert snapshots.impact(df, one(spark, "nothing")).count() == 0


def test_chains_lead_to_a_root_and_none_is_surer(spark):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice("opcux")) for _ in range(180)]
    roots = {"n1", "n2"}
    found = {r["id"]: r for r in snapshots.impact(links(spark, rows), spark.createDataFrame([(r,) for r in roots], "id string")).collect()}
    width = dict.fromkeys(roots, 1.0)
    while True:
        offers = {}
        for s, d, m in rows:
            if d in width:
                offers[s] = max(offers.get(s, 0), min(width[d], M[m][1]))
        better = {s: w for s, w in offers.items() if w > width.get(s, 0)}
        if not better:
            break
        width |= better
    assert {i: r["confidence"] for i, r in found.items()} == {i: w for i, w in width.items() if i not in roots}
    best = {}
    for s, d, m in rows:
        best[s, d] = max(best.get((s, d), 0), M[m][1])
    for i in found:
        at, low, steps = i, 1.0, 0
        while at not in roots:
            low, at, steps = min(low, best[at, found[at]["next"]]), found[at]["next"], steps + 1
            assert steps < 100
        assert low == found[i]["confidence"]


def test_blind_impact_of_nothing_is_not_measured(spark):
    nodes = spark.createDataFrame([("e", "ENTITY", "E", None, False, False, False, 0)], "id string, type string, class_name string, table_name string, observed boolean, synthetic boolean, runtime_only boolean, hits int")
    edges = spark.createDataFrame([("e", False)], "dst string, observed boolean")
    r = snapshots.blind_impact(snapshots.hot_entities(edges, nodes)).first()
    assert (r["measurable"], r["observed"], r["minted_ratio"]) == (False, 0, 0.0)
    hot = snapshots.hot_entities(spark.createDataFrame([("e", True)], "dst string, observed boolean"), nodes).first()
    assert (hot["kind"], hot["orphan"], hot["table"]) == ("resolved", True, "E")


def test_only_new_circles_of_services_are_told(spark):
    nodes = spark.createDataFrame([(x, "SERVICE") for x in "abcdef"] + [("v", "VIEW")], "id string, type string")
    graph = lambda *pairs: (spark.createDataFrame([(p[0], p[1], "USES" if len(p) > 2 else "CALLS") for p in pairs], "src string, dst string, rel string"), nodes)
    before, after = graph("ab", "ba", "cd"), graph("ab", "ba", "cd", "dc", "efu", "feu", "av", "va")
    assert [tuple(r) for r in snapshots.new_cycles(before, after).collect()] == [("c", 2)]
    grown = graph("ab", "bc", "ca")
    assert [tuple(r) for r in snapshots.new_cycles(before, grown).collect()] == [("a", 3)]
    assert snapshots.new_cycles(after, before).count() == 0


def test_fan_in_of_changed_symbols(spark):
    chains = spark.createDataFrame([("/a", "OrderService.save"), ("/b", "orderservice.SAVE"), ("/c", "OrderService.load"), ("/c", "OrderServiceX.save"), ("/d", "save")], "endpoint string, step string")
    changed = spark.createDataFrame([("x/OrderService.java", "Save"), ("x/OrderService.java", "gone"), ("x/OrderServiceX.ts", "save")], "path string, symbol string")
    assert [tuple(r) for r in snapshots.hot_symbols(chains, changed).collect()] == [("OrderService", 3), ("OrderService.Save", 2)]


def test_age_of_a_snapshot_is_never_negative(spark):
    edges, nodes = spark.createDataFrame([], "src string, dst string, rel string"), spark.createDataFrame([("wsv1:x", "ROUTE", None)], "id string, type string, entry_point string")
    at = lambda t: F.lit(t).cast("timestamp")
    rows = {(r["section"], r["key"]): r["n"] for r in snapshots.fact_sheet(edges, nodes, at("2024-01-02 00:00:00"), at("2024-01-01 00:00:00")).collect()}
    assert rows[("provenance", "freshness_seconds")] == 0 and rows[("layer", "ENDPOINT")] == 1 and rows[("totals", "isolated")] == 1
