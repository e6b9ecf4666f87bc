"""Domains of two slices, two crowds and a hub; and a plain check that labels can't be bettered."""

import random
from collections import Counter

import pytest

from evigraph.operators import domains


def frames(spark, edges, ids=None):
    ids = ids if ids is not None else sorted({x for e in edges for x in e})
    return spark.createDataFrame(edges, "src string, dst string").repartition(3), spark.createDataFrame([(i,) for i in ids], "id string")


def parts(found):
    got = {}
    for r in found.collect():
        got.setdefault(r["domain"], set()).add(r["id"])
    return got


HUB = "SERVICE:shop.shared.Logger"


def crowds():
    a, b = ([f"SERVICE:shop.{p}.S{i}" for i in range(5)] for p in ("financial", "contract"))
    return a, b, [(x, y) for g in (a, b) for x in g for y in g if x != y] + [(x, HUB) for x in a + b]


def test_a_shared_hub_makes_no_blob(spark):
    a, b, edges = crowds()
    found = domains.detect(*frames(spark, edges), least=3, hub_share=0.9)
    got = parts(found)
    assert got == {min(a): set(a), min(b): set(b), None: {HUB}}
    assert [r["id"] for r in found.where("hub").collect()] == [HUB]
    assert {(r["size"], r["name"]) for r in domains.summary(found).collect()} == {(5, "financial"), (5, "contract")}


def test_two_slices_and_one_seam(spark):
    def cut(p):
        c, r, e = f"CONTROLLER:{p}.Ctrl", f"REPOSITORY:{p}.Repo", f"ENTITY:{p}.Ent"
        s = [f"SERVICE:{p}.S{i}" for i in range(1, 5)]
        return s, [(c, x) for x in s] + [(x, r) for x in s] + [(r, e)]

    (s1, a), (s2, b) = cut("shop.financial"), cut("shop.contract")
    edges, nodes = frames(spark, a + b + [(s1[0], s2[0])])
    found = domains.detect(edges, nodes, least=3, hub_share=0.999)
    got = parts(found)
    assert sorted(map(len, got.values())) == [7, 7] and None not in got
    assert [r["edges"] for r in domains.seams(edges, found).collect()] == [1]


def test_small_domains_and_empty_graphs(spark):
    assert parts(domains.detect(*frames(spark, [("x", "y")]), least=3)) == {None: {"x", "y"}}
    assert domains.detect(*frames(spark, [], [])).count() == 0
    assert parts(domains.detect(*frames(spark, [("x", "x"), ("x", "gone")], ["x"]))) == {None: {"x"}}


@pytest.mark.parametrize("seed", range(3))
def test_no_node_would_part_from_its_label(spark, seed):
    rng = random.Random(seed)
    groups = [[f"g{i}n{j}" for j in range(rng.randrange(3, 12))] for i in range(12)]
    edges = [(x, y) for g in groups for x in g for y in g if x < y and rng.random() < 0.7] + [(rng.choice(rng.choice(groups)), rng.choice(rng.choice(groups))) for _ in range(30)]
    links = domains.weighted(domains.undirected(frames(spark, edges)[0]))
    label = {r["id"]: r["label"] for r in domains.propagate(links).collect()}
    again = {r["id"]: r["label"] for r in domains.propagate(links.repartition(5)).collect()}
    assert label == again
    near = {}
    for r in links.collect():
        near.setdefault(r["a"], Counter())[label[r["b"]]] += r["w"]
    assert all(votes[label[node]] == max(votes.values()) for node, votes in near.items())
