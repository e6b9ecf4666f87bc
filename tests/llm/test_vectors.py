"""Fill-in-middle, clusters and top-k search against SQL on the small tables, and against plain versions on edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import block_max, fill_middle, queries, vectors, yinyang
from tests.conftest import SF


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_yinyang_clusters", "op13_block_max_search"])
def test_query_equals_sql(spark, duck, same_rows, name):
    same_rows(queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name]))


def arranged(i, text, seed=1):
    """(n, form, output) by the plain rule."""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", text
    return (len(units), "spm", f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 20 else (len(units), "psm", f"<P>{pre}<S>{suf}<M>{mid}")


def test_arrangements_equal_the_plain_rule(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "é😀\n<", "<P", "x<P>y", "<S", "<M><", "word " * 20_000, "q" * 300_000, *["".join(rng.choice("ab <PSM>\n😀é") for _ in range(rng.randrange(30))) for _ in range(300)]]
    rows = [(None if i == 7 else i // 2, t, "n", "form", "x", "y") for i, t in enumerate(texts)]
    out = fill_middle.arrange(spark.createDataFrame(rows, "doc_id long, text string, n string, form string, _text string, output string"))
    got = out.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert sorted((str(r["doc_id"]), r["n"], r["form"], r["output"]) for r in got) == sorted((str(i), *arranged(i, t or "")) for i, t, *_ in rows)
    assert sorted(r["back"] for r in got) == sorted(t or "" for t in texts)
    assert {"psm", "spm", "plain"} == {r["form"] for r in got}
    assert fill_middle.arrange(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_outputs_without_their_marks_are_refused(spark):
    bad = spark.createDataFrame([("<P>a<M>b<S>c", "psm"), ("<P>a<S>b<M>c<M>", "psm"), ("x<S>b<P>a<M>c", "spm"), ("<S>b<P>a<M>c", "psm")], "output string, form string")
    assert [r[0] for r in bad.select(fill_middle.restore(F.col("output"), F.col("form"))).collect()] == [None] * 4


def lloyd(rows, k, rounds, dims, factor, seed=3):
    """rows: (id, vector). {row number: (cluster, distance)} and the centroids, by plain rounds in whole numbers."""
    usable = [(n, i, [math.floor(factor * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(usable, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[1] is None else r[1]}".encode()).hexdigest(), r[2]))[:k]
    centroids = [r[2] for r in first]
    for turn in range(rounds + 1):
        found = {}
        for n, _, v in usable:
            d, c = min((sum((x - y) ** 2 for x, y in zip(v, w, strict=True)), c) for c, w in enumerate(centroids))
            found[n] = (c, d)
        if turn < rounds:
            for c in range(len(centroids)):
                mine = [v for n, _, v in usable if found[n][0] == c]
                if mine:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return found, centroids


ODD = [None, [], [1.0], [None, 1.0, 2.0, 3.0], [float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0]]


@pytest.mark.parametrize("k,spread,rounds", [(6, 3, 10), (12, 40, 8), (9, 1, 10), (1, 5, 3), (500, 9, 3)])
def test_clusters_equal_plain_rounds(spark, k, spread, rounds):
    """Few distinct values: many ties, equal vectors, hot groups and empty clusters."""
    rng = random.Random(k)
    rows = [(rng.randrange(200), [rng.randrange(spread) / 8 - 0.3 for _ in range(4)]) for _ in range(400)] + [(7, [0.5] * 4)] * 150 + [(None, [0.25] * 4)] * 3 + [(900 + i, v) for i, v in enumerate(ODD)]
    df = spark.createDataFrame([(i, v, "c", "b") for i, v in rows], "vec_id long, embedding array<float>, cluster string, v string").repartition(5)
    out, model = yinyang.cluster(df, k=k, rounds=rounds, dims=4, factor=16)
    found, centroids = lloyd(rows, k, rounds, 4, 16)
    got = sorted((str(r["vec_id"]), list(r["v"]), r["cluster"], r["distance"]) for r in out.collect())
    assert got == sorted((str(rows[n][0]), [math.floor(16 * float(np.float32(x))) for x in rows[n][1]], *found[n]) for n in found)
    assert model.centroids.tolist() == centroids


def test_bounds_leave_vectors_out_and_hold(spark):
    """On clustered points most vectors are passed over, and no bound lies on the wrong side."""
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(4000, 8)) * 20 + rng.integers(0, 12, 4000)[:, None] * 900).astype("i8")
    model = yinyang.Model(v[rng.choice(4000, 12, replace=False)], [], np.zeros(12))
    model.groups = yinyang.group(model.centroids, 4)
    assert sorted(np.concatenate(model.groups)) == list(range(12))
    cluster, upper, lower = yinyang.first_bounds(model, v)
    for _ in range(6):
        now = np.array([v[cluster == c].mean(0) if (cluster == c).any() else model.centroids[c] for c in range(12)]).astype("i8")
        model = yinyang.Model(now, model.groups, np.nextafter(np.sqrt(((now - model.centroids) ** 2).sum(1)), np.inf))
        cluster, upper, lower = yinyang.next_bounds(model, v, cluster, upper.copy(), lower)
        far = np.sqrt(((v[:, None, :] - now) ** 2).sum(-1))
        assert (cluster == far.argmin(1)).all() and (upper >= far.min(1)).all()
        for g, members in enumerate(model.groups):
            others = np.where(members[None, :] == cluster[:, None], np.inf, far[:, members])
            assert (lower[:, g] <= others.min(1) + 1e-9).all()
    assert (lower.min(1) > upper).mean() > 0.5


def test_no_vectors_no_clusters(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    out, model = yinyang.cluster(df)
    assert model is None and out.count() == 0 and out.columns == ["vec_id", "v", "cluster", "distance"]


def searched(rows, k, factor, asks):
    """(query row, rank, id, score) by scoring every row."""
    usable = [(i, [math.floor(factor * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(usable):
        if asks(i):
            scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), j is None, j or 0, j) for m, (j, w) in enumerate(usable) if m != n]
            out += [(i, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("case", ["ties", "spread", "few", "lengths", "hot"])
def test_search_equals_scoring_all(spark, monkeypatch, case):
    rng = random.Random(len(case))
    width = {"spread": 16}.get(case, 3)
    n = 4 if case == "few" else 900
    values = (lambda: rng.gauss(0, 1)) if case == "spread" else (lambda: rng.randrange(-2, 3) / 4)
    size = (lambda: rng.randrange(5)) if case == "lengths" else (lambda: width)
    rows = [(None if rng.random() < 0.05 else rng.randrange(700), [values() for _ in range(size())]) for _ in range(n)] + [(5000 + 7 * i, v) for i, v in enumerate(ODD)]
    if case == "hot":
        rows += [(10_000 + i, [0.5, -0.25, 0.5]) for i in range(600)]
    monkeypatch.setattr(block_max, "BLOCK", 16)
    monkeypatch.setattr(block_max, "GROUP", 7)
    monkeypatch.setattr(block_max, "SHARD", (64, 256))
    df = spark.createDataFrame([(i, v, "q", "n") for i, v in rows], "vec_id long, embedding array<float>, near string, score string").repartition(3)
    got = block_max.top_k(df, F.col("vec_id") % 7 == 0, factor=8)
    assert sorted(map(tuple, got.collect()), key=repr) == searched(rows, 5, 8, lambda i: i is not None and i % 7 == 0)


def test_search_passes_blocks_over():
    """Groups of near rows: most blocks fall below the k-th score unseen."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(40, 32)) * 100
    v = (middles[:, None, :] + rng.normal(size=(40, 64, 32)) * 5).astype("i8")
    shard = block_max.Shard([(i, list(range(64 * i, 64 * i + 64)), 32, vectors.packed(b), vectors.packed(b.max(0)), vectors.packed(b.min(0))) for i, b in enumerate(v)])
    q = v[:, 0, :]
    scores, ranks, scored = shard.search(q, [i * block_max.BLOCK_PLACES for i in range(40)], [None] * 40, 5)
    plain = q @ v.reshape(-1, 32).T
    plain[np.arange(40), np.arange(40) * 64] = block_max.LOW
    assert (scores == -np.sort(-plain, axis=1)[:, :5]).all() and scored < 40 * 40 / 4


def test_no_vectors_no_results(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert block_max.top_k(df, F.col("vec_id") % 50 == 0).count() == 0


def test_products_and_packing_are_exact():
    big = np.array([[2**30, -(2**29), 1]])
    assert vectors.products(big, big)[0, 0] == 2**60 + 2**58 + 1
    with pytest.raises(OverflowError):
        vectors.products(big * 8, big)
    for top in (2**15 - 1, 2**15, 2**31, 2**40):
        a = np.array([[top, -top], [0, 5]])
        assert (vectors.unpacked(vectors.packed(a), 2) == a).all()
