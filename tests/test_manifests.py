"""Manifests side by side, what got worse, and evidence from raw metadata, on small cases with known answers."""

import pytest

from evigraph.operators import evidence, manifests

ENDPOINT = "seq long, path string, method string, roles array<string>, criticality int, entities array<string>, operation string, sensitive_fields array<string>"


def endpoints(spark, *rows):
    return spark.createDataFrame([(i, p, "get", r, c, e, o, f) for i, (p, r, c, e, o, f) in enumerate(rows)], ENDPOINT)


def test_endpoints_that_changed(spark):
    before = endpoints(spark, ("/a", ["X", "Y"], 5, ["E"], "READ", []), ("/b", ["X"], 5, ["E"], "READ", []), ("/c", [], 5, [], "READ", ["f"]), ("/d", [], 1, [], "READ", []), ("/d", ["Z"], 9, [], "READ", []))
    after = endpoints(spark, ("/a", ["Y", "X"], 5, ["E"], "READ", []), ("/b", [], 9, ["E", "F"], "WRITE", ["f"]), ("/d", ["Z"], 9, [], "READ", []), ("/e", [], 20, [], "READ", []))
    got = {r["key"]: (r["change"], list(r["what"])) for r in manifests.endpoint_changes(before, after).collect()}
    assert got == {"GET:/b": ("modified", list(manifests.FIELDS)), "GET:/c": ("removed", []), "GET:/e": ("added", [])}


@pytest.mark.parametrize(
    "before,after,level",
    [
        ([("/a", ["X"], 5)], [("/a", [], 5)], "critical"),
        ([("/a", ["X"], 5)], [("/a", ["X"], 5), ("/b", [], 70)], "high"),
        ([("/a", ["X"], 5)], [("/a", ["X"], 5), ("/b", [], 69)], "medium"),
        ([("/a", ["X"], 5)], [("/a", ["X"], 6)], "low"),
        ([("/a", ["X"], 5), ("/b", ["X"], 5)], [("/a", ["X"], 5)], "low"),
        ([("/a", ["X"], 5)], [("/a", ["X"], 5)], "none"),
    ],
)
def test_level_of_security(spark, before, after, level):
    a, b = (endpoints(spark, *[(p, r, c, [], "READ", []) for p, r, c in rows]) for rows in (before, after))
    assert manifests.security(a, b, manifests.endpoint_changes(a, b)).first()["level"] == level


def test_screens_that_changed(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    items = lambda *p: spark.createDataFrame(list(p), "name string, item string")
    before = names("same", "gone", "more", "quiet"), {"interactions": items(("same", "a"), ("more", "a"), ("more", "b")), "guards": items(("more", "g"))}
    after = names("same", "new", "more", "quiet"), {"interactions": items(("same", "a"), ("more", "a"), ("more", "c"), ("more", "d"), ("new", "z")), "guards": items()}
    got = {r["name"]: (r["change"], list(r["what"])) for r in manifests.named_changes(before, after).collect()}
    assert got == {"gone": ("removed", []), "new": ("added", []), "more": ("modified", ["+2 interactions", "-1 guards", "-1 interactions"])}


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), "endpoint string, operation string, entities array<string>")


def test_what_got_worse_and_what_better(spark):
    before = entries(spark, ("/a", "findA", ["A"]), ("/b", "createA", ["A"]), ("/c", "deleteC", ["C"]), ("/d", "updateD", ["D"]), ("/e", "updateD", ["D"]), ("/f", "findD", ["D"]))
    after = entries(spark, ("/a", "findA", []), ("/b", "createA", ["A"]), ("/b2", "createA", ["A"]), ("/c", "deleteC", ["C"]), ("/c2", "findC", ["C"]), ("/d", "updateD", ["D"]), ("/f", "findD", ["D"]))
    got = {(r["kind"], r["severity"], r["target"]) for r in manifests.regressions(before, after).collect()}
    assert got == {
        ("REMOVED_ENDPOINT", "low", "/e"), ("LOST_ENTITY_LINK", "high", "/a"), ("COVERAGE_DROP", "medium", "coverage"), ("NEW_OVERLAP", "medium", "CREATE:A"), ("RESOLVED_OVERLAP", None, "UPDATE:D"),
        ("NEW_LIFECYCLE_GAP", "medium", "A"), ("RESOLVED_LIFECYCLE_GAP", None, "C"),
    }
    assert manifests.regressions(before, before).count() == 0


def test_evidence_from_raw_metadata(spark):
    texts = ['{"observed": true, "count": 3}', '{"resolution": "compiler", "synthetic": false}', '{"configProven": true}', '{"resolution": 5, "observed": "no"}', '{"resolution": "comp', "", None, "[1]", '{"refutation": {"subtype": "REFUTED_LIKELY_DEAD"}}']
    df = spark.createDataFrame([(str(i), "d", "CALLS", t) for i, t in enumerate(texts)], "src string, dst string, rel string, metadata string")
    got = {int(r["src"]): (r["method"], r["count"], r["refuted"], r["broken"]) for r in evidence.edge_evidence(evidence.from_metadata(df)).collect()}
    assert got[0] == ("RUNTIME_OBSERVED", 3, None, False) and got[1][0] == "STATIC_PROVEN" and got[2][0] == "CONFIG_PROVEN" and got[3][0] == "UNKNOWN"
    assert got[4] == ("UNKNOWN", None, None, True) and got[5][3] and not got[6][3] and not got[7][3] and got[8][2] == "REFUTED_LIKELY_DEAD"
