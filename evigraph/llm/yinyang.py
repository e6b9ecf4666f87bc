"""K-means with the bounds of Yinyang grouping, in whole numbers.

The first centroids are grouped once, by a small k-means over themselves. Beside each vector stand its cluster, an upper
bound of its distance from it and one lower bound per group of its distance from the other centroids of the group. When centroids have
moved, the bounds give way by how far; a vector whose upper bound is under all its lower bounds keeps its cluster unseen. Otherwise
its distance is measured, the test repeated, then groups are left out by their bound, then single centroids by theirs; only
the centroids that survive are compared exactly, so that ties go to the smaller number. Bounds are rounded away from
what they bound, so they never decide a tie.

Vectors, clusters and bounds are a table in the shared folder, written anew each round without a shuffle; vectors that changed
their cluster are added up by task, then by (cluster, component). The driver holds the centroids, k * dims numbers, and k sums.

Rows: vectors that are null, of another length than dims, or hold null or non-finite components are left out; a null id is
hashed as the empty id and stays null; of equal ids the vector decides which comes first; repeated rows count each; fewer vectors than k
make as many centroids; an empty table gives no rows; components whose squares could exceed 64 bits are an error; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import settled, small_batches, steps_so_far
from evigraph.llm.vectors import matrix, squares, usable, whole

STATE = "cluster int, before int, upper double, lower array<double>"
#: Rounds of the k-means that groups the first centroids.
GROUP_ROUNDS = 5


@dataclass
class Model:
    """Centroids, the members of each group in ascending order, and how far each centroid moved in the last round."""

    centroids: np.ndarray
    groups: list[np.ndarray]
    moved: np.ndarray

    def digest(self, i: int) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.centroids[i]).encode()).hexdigest()


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, -np.inf), -np.inf)


def group(centroids: np.ndarray, groups: int) -> list[np.ndarray]:
    """The numbers of the centroids, dealt into at most `groups` groups of near ones."""
    points = centroids.astype("f8")
    middles = points[:groups].copy()
    for _ in range(GROUP_ROUNDS):
        of = ((points[:, None, :] - middles) ** 2).sum(-1).argmin(1)
        for g in range(len(middles)):
            if (of == g).any():
                middles[g] = points[of == g].mean(0)
    return [np.flatnonzero(of == g) for g in range(len(middles)) if (of == g).any()]


def first_bounds(model: Model, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper and lower bounds of vectors seen for the first time: all distances."""
    far = np.stack([squares(v, c) for c in model.centroids], axis=1)
    cluster = far.argmin(1)
    rows = np.arange(len(v))
    upper = _up(np.sqrt(far[rows, cluster].astype("f8")))
    roots = _down(np.sqrt(far.astype("f8")))
    roots[rows, cluster] = np.inf
    return cluster, upper, np.stack([roots[:, g].min(1) for g in model.groups], axis=1)


def next_bounds(model: Model, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same after the centroids moved, from the bounds of the round before."""
    upper = _up(upper + model.moved[cluster])
    held, lower = lower, np.stack([_down(lower[:, g] - model.moved[m].max()) for g, m in enumerate(model.groups)], axis=1)
    cluster = cluster.copy()
    rows = np.flatnonzero(lower.min(1) <= upper)  # all groups at once
    own = squares(v[rows], model.centroids[cluster[rows]])
    upper[rows] = _up(np.sqrt(own.astype("f8")))
    open_ = lower[rows].min(1) <= upper[rows]
    rows, own = rows[open_], own[open_]
    old, best, near = cluster[rows], cluster[rows].copy(), own.copy()
    seen: list[tuple[int, np.ndarray, np.ndarray]] = []
    for g, members in enumerate(model.groups):
        at = np.flatnonzero(lower[rows, g] <= upper[rows])  # rows whose group survives
        least = np.full((len(at), len(members)), np.inf)
        for j, c in enumerate(members):
            mine = old[at] == c
            bound = _down(held[rows[at], g] - model.moved[c])
            least[:, j] = np.where(mine, _down(np.sqrt(own[at].astype("f8"))), bound)
            look = np.flatnonzero(~mine & (bound <= upper[rows[at]]))  # rows for which the centroid itself survives
            far = squares(v[rows[at[look]]], model.centroids[c])
            least[look, j] = _down(np.sqrt(far.astype("f8")))
            won = (far < near[at[look]]) | ((far == near[at[look]]) & (c < best[at[look]]))
            near[at[look[won]]], best[at[look[won]]] = far[won], c
        seen.append((g, at, least))
    for g, at, least in seen:
        least[best[at][:, None] == model.groups[g][None, :]] = np.inf
        lower[rows[at], g] = least.min(1)
        left = np.setdiff1d(np.flatnonzero((best != old) & np.isin(old, model.groups[g])), at)  # group not looked at, its centroid given up
        lower[rows[left], g] = np.minimum(lower[rows[left], g], _down(np.sqrt(own[left].astype("f8"))))
    cluster[rows] = best
    upper[rows] = _up(np.sqrt(near.astype("f8")))
    return cluster, upper, lower


def _pass(model: Model, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column("v"), model.centroids.shape[1])
            if first:
                cluster, upper, lower = first_bounds(model, v)
                before = np.full(len(v), -1)
            else:
                before = b.column("cluster").to_numpy(zero_copy_only=False)
                cluster, upper, lower = next_bounds(model, v, before, b.column("upper").to_numpy(zero_copy_only=False).copy(), matrix_of_doubles(b.column("lower")))
            offsets = pa.array(np.arange(0, lower.size + 1, lower.shape[1]), pa.int32())
            bounds = pa.ListArray.from_arrays(offsets, pa.array(lower.ravel()))
            columns = [b.column("i"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(before, pa.int32()), pa.array(upper), bounds]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "v", "cluster", "before", "upper", "lower"])

    return run


def matrix_of_doubles(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _sums(k: int, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per batch: what its moved vectors add to (cluster, component); component -1 counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"), dims)
            v = np.concatenate([np.ones((len(v), 1), "i8"), v], axis=1)
            total = np.zeros((k, dims + 1), "i8")
            for name, sign in (("cluster", 1), ("before", -1)):
                of = b.column(name).to_numpy(zero_copy_only=False)
                np.add.at(total, of[of >= 0], sign * v[of >= 0])
            c, d = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d - 1, pa.int32()), pa.array(total[c, d])], names=["c", "d", "s"])

    return run


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, groups: int = 3, dims: int = 64, factor: int = 1024, seed: int = 3) -> tuple[DataFrame, Model | None]:
    """(rows, model): id, v (whole numbers), cluster and distance (squared), a row per usable vector; no model if there is none.

    The vectors of the k smallest digests of seed and id are the first centroids. After `rounds` rounds, or when no
    centroid moved any more, the vectors are assigned once more.
    """
    small_batches(df.sparkSession)
    before = steps_so_far()
    found = df.select(F.col(id_col).alias("i"), F.col(vector_col).alias("_v"))
    found = found.where((F.size("_v") == dims) & usable(F.col("_v"))).select("i", whole(F.col("_v"), factor).alias("v"))
    drawn = found.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("i").cast("string"), F.lit(""))), 256), "v").limit(k).collect()
    if not drawn:
        return found.select(F.col("i").alias(id_col), "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), None
    model = Model(np.array([r["v"] for r in drawn], "i8"), [], np.zeros(len(drawn)))
    model.groups = group(model.centroids, groups)
    n, total = len(drawn), np.zeros((len(drawn), dims + 1), object)
    kind = f"i {found.schema['i'].dataType.simpleString()}, v array<bigint>, {STATE}"
    state = settled(found.mapInArrow(_pass(model, True), kind), "yinyang", before)
    for _ in range(rounds):
        added = state.where("cluster <> before").select("v", "cluster", "before").mapInArrow(_sums(n, dims), "c int, d int, s long")
        for r in added.groupBy("c", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
            total[r["c"], r["d"] + 1] += int(r["s"])
        now = np.array([[x // row[0] for x in row[1:]] if row[0] else old for row, old in zip(total, model.centroids.tolist(), strict=True)], "i8")
        moved = squares(now, model.centroids)
        model = Model(now, model.groups, _up(np.sqrt(moved.astype("f8"))) * (moved > 0))
        if not moved.any():  # nothing changes from here on
            break
        state = settled(state.mapInArrow(_pass(model, False), kind), "yinyang", before)
    at = df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.centroids)], "cluster int, _c array<bigint>")
    gap = F.aggregate(F.zip_with("v", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    return state.join(at, "cluster").select(F.col("i").alias(id_col), "v", "cluster", gap.alias("distance")), model


def query(spark, sf_dir: str) -> DataFrame:
    before = steps_so_far()
    rows, model = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = settled(rows.drop("v"), "clusters", before)
    found = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    told = [(c, s, sum(found.values()), model.digest(c)) for c, s in found.items()]
    return rows.join(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"), "cluster")


def _sql(k: int = 8, rounds: int = 10) -> str:
    """The same rounds without bounds, one after the other."""
    gap = "list_sum(list_transform(list_zip(v, w), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    steps = [
        f"""with kept as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
m0 as materialized (select row_number() over (order by h, v) - 1 as c, v as w from (select sha256('3:' || coalesce(vec_id::varchar, '')) as h, v from kept order by h, v limit {k}))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select k.rowid_ as r, vec_id, v, arg_min(c, row(d, c)) as c, min(d)::bigint as d from (select *, {gap} as d from (select row_number() over () as rowid_, * from kept) k, m{r}) k group by r, vec_id, v)")
        if r < rounds:
            steps.append(
                f"""s{r} as (select c, i, sum(x) as s, count(*)::bigint as n from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by c, i),
m{r + 1} as materialized (select m{r}.c, coalesce(n.w, m{r}.w) as w from m{r} left join (select c, list(((s - ((s % n + n) % n)) // n)::bigint order by i) as w from s{r} group by c) n on m{r}.c = n.c)"""
            )
    last = f"""
select vec_id, a.c::int as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(w, ',')) as centroid_sha256
from a{rounds} a join m{rounds} m on a.c = m.c"""
    return ",\n".join(steps) + last


SQL = _sql()
