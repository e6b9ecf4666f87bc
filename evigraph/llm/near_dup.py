"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

Sketch: in round i every shingle is hashed to a bin and a value i + v; a bin keeps its least value, so later rounds only
reach bins that are still empty. Rounds from `size` on hash to one fixed bin each, so that after 2 * size rounds every
coordinate is filled. Two sets agree in a coordinate with a probability equal to their Jaccard similarity.

Steps: documents with equal shingle sets collapse to a class; each band of a class's sketch names a bucket. Within a bucket
all sketches that may belong to similar sets are found in memory, but only links that span them leave the task, at most one
per class. The components of these links are clusters. Within a cluster the full sets are compared, exactly and again in
memory, and spanning links of what is similar leave the task; their components are the result. Neither buckets nor
clusters emit pairs, and large ones are dealt to pairs of blocks.

A pair at the threshold escapes all bands with a probability of (1 - similarity**rows)**bands, 1.2e-7 by default; its
sketches agree in too few coordinates with one below 3e-7. Shingles are 64-bit hashes.

Rows: a null text, or one without words, is linked with nothing; a text of fewer words than a shingle counts as one
shingle; texts are taken whole, whatever their length; repeated rows fall into one class; rows with one id but unlike texts are
documents of their own with that id; the least id names a group, so there are no ties; other columns, whatever their names, are
ignored. A row of a null id is linked with nothing, its component is null, and it is kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import arrow_stage, numbered, settled, steps_so_far, written
from evigraph.llm.components import components

KEPT_WORDS = 100_000
#: Classes, and their shingles, that are compared in one block; larger buckets and clusters are dealt to pairs of blocks.
BLOCK, BLOCK_SHINGLES = 4000, 750_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ASCII-lower-cased words between ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def sketch(items: np.ndarray, size: int) -> np.ndarray:
    """The coordinates: round << 32 | value. items must not be empty."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(size, full, np.uint64)
    for i in range(2 * size):
        if i < size:
            h = _mix(items + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF))
            bins = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            value = (h & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32)
            if i:
                empty = out[bins] > np.uint64(i << 32)
                bins, value = bins[empty], value[empty]
            np.minimum.at(out, bins, value)
        elif out[i - size] == full:
            h = _mix(items + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF))
            out[i - size] = (h & np.uint64(0xFFFFFFFF)).min() | np.uint64(i << 32)
        if i + 1 >= size // 8 or len(items) * (i + 1) >= size:
            if not (out == full).any():
                break
    return out


def buckets(coords: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket per band; the band's number is part of it."""
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + coords[k : bands * rows : rows])
    return h.view(np.int64)


def least_agreement(size: int, similarity: float) -> int:
    """Coordinates that sketches of similar sets agree in but for a chance below 3e-7 (5 standard deviations)."""
    return max(1, math.floor(size * similarity - 5 * math.sqrt(size * similarity * (1 - similarity))))


def _profiles(df: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for key, x, text in zip(b["k"], b["x"], b["t"], strict=True):
                s = shingles(text, width)
                if not len(s):
                    yield key, x, 0, None, None, None
                    continue
                coords = sketch(s, bands * rows)
                yield key, x, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), buckets(coords, bands, rows).tolist(), (_mix(coords) & np.uint64(255)).astype(np.uint8).tobytes()
        _words.clear()  # a worker lives on after its task

    return arrow_stage(df, "id long, x long, n long, digest binary, bands array<long>, coords binary", run)


class _Forest:
    """Union-find over 0..n-1 that remembers the links which joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, k: int, others: np.ndarray) -> None:
        """Joins k with the others, one link for each tree that is new to it."""
        roots, first = np.unique(self.root[others], return_index=True)
        new = roots != self.root[k]
        if new.any():
            self.links += [(k, int(m)) for m in others[first[new]]]
            self.root[np.isin(self.root, roots)] = self.root[k]

    def apart(self, n: int):
        """First 0, then each member outside the largest tree: all pairs not in it have one of these."""
        yield 0
        largest = np.bincount(self.root).argmax()
        yield from np.flatnonzero(self.root != largest).tolist()


def _in_blocks(members: DataFrame, group: str, blocks: str) -> DataFrame:
    """Deals the rows of large groups to all pairs of blocks (i, j); `blocks` says how many a group has."""
    own = F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", blocks)


def _candidates(members: DataFrame, least: int, percent: int) -> DataFrame:
    """(bucket, i, j, node, n, coords) -> links (a, b) that span, in each bucket, what may be similar by size and sketch.

    A group's output is at most one link per member, however many of its pairs agree.
    """

    def spanning(group):
        m = len(group)
        if m < 2:
            return
        n = np.array([g[1] for g in group])
        coords = np.frombuffer(b"".join(g[2] for g in group), np.uint8).reshape(m, -1)
        forest = _Forest(m)
        for k in forest.apart(m):
            near = ((coords == coords[k]).sum(axis=1) >= least) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
            forest.join(k, np.flatnonzero(near))
        for x, y in forest.links:
            yield group[x][0], group[y][0]

    return arrow_stage(members.select("bucket", "i", "j", "node", "n", "coords"), "a long, b long", lambda batches: _by_group(batches, ("bucket", "i", "j"), ("node", "n", "coords"), spanning))


def _by_group(batches, keys: tuple, values: tuple, solve):
    """Calls solve with the rows of each run of equal keys."""
    at, group = None, []
    for x in batches:
        for key, row in zip(zip(*(x[k] for k in keys), strict=True), zip(*(x[v] for v in values), strict=True), strict=True):
            if key != at:
                yield from solve(group)
                at, group = key, []
            group.append(row)
    yield from solve(group)


def _links(dealt: DataFrame, width: int, percent: int) -> DataFrame:
    """(cluster, i, j, node, text) -> links (a, b) between similar sets that span each group's components.

    The intersections of one set with all others of its group are counted at once, over lists of the sets that hold a
    shingle.
    """

    def spanning(group):
        m = len(group)
        if m < 2:
            return
        sets = [shingles(t, width) for _, t in group]
        _words.clear()
        n = np.array([len(s) for s in sets])
        sets = np.concatenate(sets)
        item = np.unique(sets, return_inverse=True)[1].astype(np.int32)
        del sets
        ends = np.cumsum(n)
        holders, sizes = np.repeat(np.arange(m, dtype=np.int32), n)[np.argsort(item, kind="stable")], np.bincount(item)
        begins = np.cumsum(sizes) - sizes
        forest = _Forest(m)
        for k in forest.apart(m):
            own = item[ends[k] - n[k] : ends[k]]
            size = sizes[own]
            places = np.repeat(begins[own] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
            both = np.bincount(holders[places], minlength=m)
            forest.join(k, np.flatnonzero(100 * both >= percent * (n + n[k] - both)))
        for x, y in forest.links:
            yield group[x][0], group[y][0]

    return arrow_stage(dealt.select("cluster", "i", "j", "node", "text"), "a long, b long", lambda batches: _by_group(batches, ("cluster", "i", "j"), ("node", "text"), spanning))


def _classes(profiles: DataFrame) -> DataFrame:
    """One row per shingle set: digest, n, bands, coords, rep (least id), x (of that row's text) and node, its number.

    The number is the least id. Where an id has rows with unlike texts, their sets have a hash for a number instead.
    """
    sets = profiles.where("n > 0 and id is not null")
    h = F.xxhash64("digest")
    several = written(sets.groupBy("id").agg(F.min(h).alias("a"), F.max(h).alias("z")).where("a <> z").select("id"), "several")
    one = sets.groupBy("digest").agg(F.min(F.struct("id", "x")).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("coords").alias("coords"))
    one = one.select("digest", "n", "bands", "coords", F.col("least.id").alias("rep"), F.col("least.x").alias("x"))
    named = one.join(several, F.col("rep") == F.col("id"), "left").withColumn("node", F.when(F.col("id").isNotNull(), h).otherwise(F.col("rep")))
    return written(named.drop("id"), "classes")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """One row per input row: id, n_shingles (size of its set), component_id (smallest id reachable) and kept."""
    found = _grouped(df, id_col, text_col, width, percent, bands, rows)
    out = found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _grouped(df: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """One row per input row: id, x (hash of the text), n, grp (a number of the group; null without words) and component."""
    before = steps_so_far()
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("x", F.xxhash64("text"))
    profiles = written(_profiles(texts.select(F.col("id").alias("k"), "x", F.col("text").alias("t")), width, bands, rows), "sketches")
    least = least_agreement(bands * rows, percent / 100)
    classes = _classes(profiles)
    placed = classes.select("node", F.explode("bands").alias("bucket"))
    shared = written(placed.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1").drop("m"), "shared")
    members = _in_blocks(placed.join(shared, "bucket"), "bucket", "blocks").join(classes.select("node", "n", "coords"), "node")
    pairs = _candidates(members.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node"), least, percent)
    clusters = components(pairs).withColumnRenamed("component", "cluster").join(classes.select("node", "rep", "x", "n"), "node")
    sizes = written(clusters.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks")), "sizes")
    # a row may be repeated any number of times: one text of each class goes to the blocks
    held = texts.withColumnRenamed("id", "rep").join(clusters.select("rep", "x"), ["rep", "x"], "left_semi").groupBy("rep", "x").agg(F.first("text").alias("text"))
    dealt = _in_blocks(clusters.drop("n").join(sizes, "cluster"), "cluster", "blocks").join(held, ["rep", "x"])
    found = written(components(_links(dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node"), width, percent)).withColumnRenamed("component", "grp"), "groups")
    ids = classes.select("digest", "node", "rep")
    smallest = found.join(ids, "node").groupBy("grp").agg(F.min("rep").alias("component"))
    named = ids.join(found, "node", "left").join(smallest, "grp", "left").select("digest", F.coalesce("grp", "node").alias("grp"), F.coalesce("component", "rep").alias("component"))
    known = F.col("id").isNotNull()
    out = profiles.select("id", "x", "n", "digest").join(written(named, "named"), "digest", "left").select("id", "x", "n", F.when(known, F.col("grp")).alias("grp"), F.when(known, F.coalesce("component", "id")).alias("component"))
    return settled(out, "near", before)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of the documents that stay, all columns as they were.

    A row goes if the least id of its group isn't its own; of a group's rows with that id one stays, and one of the rows that
    repeat an id and a text without words: that whose text's hash, then whose other columns' JSON text, is the least. Rows with
    one id but unlike texts are judged each by its own text. Rows of a null id all stay.
    """
    own = numbered(df.select(*[F.col(f"`{c}`") for c in df.columns], F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))))
    *columns, key, x = own.columns
    found = _grouped(df, id_col, text_col, **params).where("id = component")
    # decided on keys alone; the texts are dealt once, by (id, x), which serves the join and the window
    stays = found.groupBy("id", F.coalesce("grp", "x").alias("g"), F.col("grp").isNull().alias("e")).agg(F.min("x").alias("least")).select("id", "least")
    rest = own.join(stays, (F.col(key) == F.col("id")) & (F.col(x) == F.col("least")))
    others = F.to_json(F.struct(*[c for c, name in zip(columns, df.columns, strict=True) if name != text_col]))
    first = rest.withColumn("n", F.row_number().over(Window.partitionBy(key, x).orderBy(others))).where("n = 1")
    return first.select(*columns).unionByName(own.where(F.col(key).isNull()).select(*columns)).toDF(*df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 1 then ws else list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]) end) as g from w where len(ws) > 0),
z as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select i.a, i.b from i join z x on i.a = x.doc_id join z y on i.b = y.doc_id where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select a, b from l union select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
m as (select a, min(b) as b from r group by a)
select w.doc_id, coalesce(z.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) as component_id, w.doc_id <= coalesce(m.b, w.doc_id) as kept
from w left join z on w.doc_id = z.doc_id left join m on w.doc_id = m.a
"""
