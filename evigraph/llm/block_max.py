"""Exact top-k search by inner product, pruned a block of rows at a time.

Rows are ordered so that near ones stand together (by the nearest of a few pivots, then by how near, then by id) and cut
into blocks. A block keeps a forward index (its vectors and ids) and, for each component, its greatest and least value: a query's greatest possible
score in a block is the sum over its components of weight times greatest value (least, for negative weights). A query goes
through the blocks in the order of these sums, in waves of 1, 2, 4, ... blocks, until they fall below its k-th score; where a
sum equals the k-th score, the block's smallest id decides.

Blocks are dealt into shards; the queries, gathered in groups, go to each shard, and a task holds one shard and one group. Where
a query starts is the k-th score within the block that it stands in. Of each shard come at most k rows a query, and a window picks the k best.

Rows: vectors that are null or hold null or non-finite components take no part; a shorter vector counts as zero beyond its end, an empty
one scores 0; a query doesn't find its own row, but rows equal to it, also those of its id; each of the queries that share an id gives
its rows; equal scores go by id, a null id last; with fewer rows than k there are fewer results, and an empty table gives none; products
that could exceed 64 bits are an error; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import arrow_stage, small_batches, written
from evigraph.llm.vectors import matrix, packed, products, unpacked, usable, whole

BLOCK, GROUP, PIVOTS = 256, 512, 64
#: Places of a block, so that block and place make one number.
BLOCK_PLACES = 1 << 12
#: Rows of a shard: so many that each core has two shards, within these bounds (the upper one is 32 MB of small numbers).
SHARD = (4096, 262_144)
NO_ID = np.iinfo(np.int64).max
#: Below every score; it can be negated.
LOW = -NO_ID

BLOCKS = "block long, ids array<long>, width int, vectors binary, most binary, least binary, asked array<int>, floors array<long>"
#: kind 0: a block (ids, vectors, most, least); kind 1: a group of queries (ids, vectors, where each stands, its first k-th score).
DEALT = "shard int, kind int, block long, ids array<long>, width int, vectors binary, most binary, least binary, homes array<long>, floors array<long>"
FOUND = "home long, query_id long, vec_id long, score long"


def _near(pivots: np.ndarray):
    length = np.sqrt((pivots.astype("f8") ** 2).sum(1))
    unit = pivots / np.where(length, length, 1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column("v"))
            width = min(v.shape[1], unit.shape[1])
            likeness = v[:, :width] @ unit[:, :width].T
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(likeness.argmax(1), pa.int32()), pa.array(-likeness.max(1))], names=[*b.schema.names, "near", "close"])

    return run


def _padded(rows: list[list[int]]) -> np.ndarray:
    return matrix(pa.array(rows, pa.list_(pa.int64())))


def _cut(size: int, k: int):
    """Blocks of `size` rows of a sorted partition; the queries in them with the k-th score within the block."""

    def rows(batches: Iterator[dict]) -> Iterator[tuple]:
        held: list[tuple] = []
        base, n = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            held.extend(zip(b["id"], b["v"], b["q"], strict=True))
            while len(held) >= size:
                yield block(base + n, held[:size])
                held, n = held[size:], n + 1
        if held:
            yield block(base + n, held)

    def block(number: int, held: list[tuple]) -> tuple:
        held.sort(key=lambda r: (r[0] is None, r[0]))
        v = _padded([r[1] for r in held])
        asked = [i for i, r in enumerate(held) if r[2]]
        floors: list[int | None] = []
        if asked:
            scores = products(v[asked], v)
            for row, i in zip(scores, asked, strict=True):
                others = np.delete(row, i)
                floors.append(int(np.partition(others, -k)[-k]) if len(others) >= k else None)
        return number, [r[0] for r in held], v.shape[1], packed(v), packed(v.max(0)), packed(v.min(0)), asked, floors

    return rows


def _queries(batches: Iterator[dict]) -> Iterator[tuple]:
    """Groups of queries out of blocks: where each stands (block and place), its id, its vector and its first k-th score."""
    held: list[tuple] = []

    def group(held: list[tuple]) -> tuple:
        v = _padded([h[2] for h in held])
        return [h[1] for h in held], v.shape[1], packed(v), [h[0] for h in held], [h[3] for h in held]

    for b in batches:
        for number, ids, width, data, asked, floors in zip(b["block"], b["ids"], b["width"], b["vectors"], b["asked"], b["floors"], strict=True):
            v = unpacked(data, width)
            held.extend((number * BLOCK_PLACES + i, ids[i], v[i].tolist(), floor) for i, floor in zip(asked, floors, strict=True))
            while len(held) >= GROUP:
                yield group(held[:GROUP])
                held = held[GROUP:]
    if held:
        yield group(held)


class Shard:
    """Forward indexes and bounds of some blocks."""

    def __init__(self, blocks: list[tuple]) -> None:
        width = max(b[2] for b in blocks)
        self.vectors = [unpacked(b[3], b[2]) for b in blocks]
        self.most, self.least = (np.zeros((len(blocks), width), "i8") for _ in range(2))
        for i, b in enumerate(blocks):
            self.most[i, : b[2]], self.least[i, : b[2]] = unpacked(b[4], b[2])[0], unpacked(b[5], b[2])[0]
        ids = [x for b in blocks for x in b[1]]
        self.known = np.array([x is not None for x in ids])
        self.ids = np.array([NO_ID if x is None else x for x in ids], "i8")
        self.starts = np.cumsum([0, *[len(b[1]) for b in blocks]])
        #: rows by id, null last; results and ties go by these ranks
        self.by_rank = np.lexsort((~self.known, self.ids))
        self.rank = np.empty(len(ids), "i8")
        self.rank[self.by_rank] = np.arange(len(ids))
        self.first = np.minimum.reduceat(self.rank, self.starts[:-1])
        self.at = {b[0]: i for i, b in enumerate(blocks)}

    def search(self, q: np.ndarray, homes: list[int], floors: list[int | None], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, ranks) of the k best of each query, unused places with rank `none`; and how many (query, block) pairs were scored."""
        none = len(self.ids)
        width = min(q.shape[1], self.most.shape[1])
        q = q[:, :width]
        bounds = products(np.maximum(q, 0), self.most[:, :width]) + products(np.minimum(q, 0), self.least[:, :width])
        order = np.lexsort((np.broadcast_to(self.first, bounds.shape), -bounds), axis=-1)
        scores, ranks = np.full((len(q), k), LOW), np.full((len(q), k), none)
        floor = np.array([LOW if f is None else f for f in floors])
        own = [(self.at.get(h // BLOCK_PLACES), h % BLOCK_PLACES) for h in homes]
        own_block, own_place = (np.array([-1 if o[0] is None else o[i] for o in own]) for i in range(2))
        scored, at, wave = 0, 0, 1
        asking = np.arange(len(q))
        while len(asking) and at < order.shape[1]:
            turn = order[asking, at : at + wave]
            for b in np.unique(turn):
                rows = asking[(turn == b).any(1)]
                last, bound = np.maximum(scores[rows, -1], floor[rows]), bounds[rows, b]
                rows = rows[(bound > last) | ((bound == last) & ((scores[rows, -1] < last) | (self.first[b] < ranks[rows, -1])))]
                if len(rows):
                    scored += len(rows)
                    self._score(int(b), rows, q, scores, ranks, floor, own_block, own_place, k)
            at, wave = at + wave, wave * 2
            if at < order.shape[1]:  # sums only fall from here on
                last = np.maximum(scores[asking, -1], floor[asking])
                asking = asking[bounds[asking, order[asking, at]] >= last]
        return scores, ranks, scored

    def _score(self, b: int, rows: np.ndarray, q: np.ndarray, scores: np.ndarray, ranks: np.ndarray, floor: np.ndarray, own_block: np.ndarray, own_place: np.ndarray, k: int) -> None:
        v = self.vectors[b]
        width = min(q.shape[1], v.shape[1])
        got = products(q[rows, :width], v[:, :width])
        mine = np.flatnonzero(own_block[rows] == b)
        got[mine, own_place[rows[mine]]] = LOW
        hit = got.max(1) >= np.maximum(scores[rows, -1], floor[rows])
        rows, got = rows[hit], got[hit]
        best = np.argsort(-got, axis=1, kind="stable")[:, :k]  # rows of a block stand by id
        new = np.take_along_axis(got, best, 1)
        new_ranks = self.rank[self.starts[b] + best]
        new_ranks[(new == LOW) | (new < floor[rows][:, None])] = len(self.ids)
        new[new_ranks == len(self.ids)] = LOW
        s, r = np.concatenate([scores[rows], new], axis=1), np.concatenate([ranks[rows], new_ranks], axis=1)
        order = np.lexsort((r, -s), axis=-1)[:, :k]
        scores[rows], ranks[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(r, order, 1)


def _search(k: int):
    def rows(batches: Iterator[dict]) -> Iterator[tuple]:
        now, blocks, shard = None, [], None
        for b in batches:
            for i, (number, kind) in enumerate(zip(b["shard"], b["kind"], strict=True)):
                if number != now:
                    now, blocks, shard = number, [], None
                if kind == 0:
                    blocks.append((b["block"][i], b["ids"][i], b["width"][i], b["vectors"][i], b["most"][i], b["least"][i]))
                    continue
                if not blocks and shard is None:  # a shard without rows
                    continue
                if shard is None:
                    shard, blocks = Shard(blocks), []
                ids, homes = b["ids"][i], b["homes"][i]
                scores, ranks, _ = shard.search(unpacked(b["vectors"][i], b["width"][i]), homes, b["floors"][i], k)
                for j, place in zip(*np.nonzero(ranks < len(shard.ids)), strict=True):
                    row = shard.by_rank[ranks[j, place]]
                    yield homes[j], ids[j], int(shard.ids[row]) if shard.known[row] else None, int(scores[j, place])

    return rows


def top_k(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of the highest inner products for each row where `queries` is true."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("q"), F.col(vector_col).alias("_v"))
    rows = rows.where(usable(F.col("_v"))).select("id", "q", whole(F.col("_v"), factor).alias("v"))
    drawn = rows.orderBy(F.xxhash64("v")).limit(PIVOTS).collect()
    pivots = _padded([r["v"] for r in drawn] or [[0]])
    near = rows.mapInArrow(_near(pivots), "id long, q boolean, v array<long>, near int, close double")
    order = ["near", "close", "id"]
    blocks = written(arrow_stage(near.repartitionByRange(*order).sortWithinPartitions(*order), BLOCKS, _cut(BLOCK, k), out_rows=64), "blocks")
    n = (blocks.agg(F.sum(F.size("ids"))).first()[0] or 0) // (2 * spark.sparkContext.defaultParallelism)
    shards = -(-blocks.count() * BLOCK // min(max(n, SHARD[0]), SHARD[1])) or 1
    null = lambda kind: F.lit(None).cast(kind)
    held = blocks.select(
        F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "block", "ids", "width", "vectors", "most", "least", null("array<long>").alias("homes"), null("array<long>").alias("floors")
    )
    asked = arrow_stage(blocks.where(F.size("asked") > 0).select("block", "ids", "width", "vectors", "asked", "floors"), "ids array<long>, width int, vectors binary, homes array<long>, floors array<long>", _queries)
    asked = written(asked, "queries")
    dealt = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), null("long").alias("block"), "ids", "width", "vectors", null("binary").alias("most"), null("binary").alias("least"), "homes", "floors"
    )
    both = held.unionByName(dealt).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    found = arrow_stage(both, FOUND, _search(k))
    best = Window.partitionBy("home").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SQL = r"""
with u as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v, row_number() over () as r from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.r, a.vec_id as query_id, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda x: coalesce(x[1], 0) * coalesce(x[2], 0))), 0)::bigint as score
  from u a join u b on a.r <> b.r where a.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by r order by score desc, vec_id nulls last) as rank from s) where rank <= 5
"""
