"""Removal of long repeated byte strings by column-wise suffix construction over many documents.

A byte is removed if a string of `length` bytes that covers it also starts anywhere else in the table. without_passages()
measures in words instead: each word becomes one symbol, 32 bits of its hash, and the same construction runs over these. A Measure
says what the symbols are; lengths, starts and runs below are in symbols.

Inserting one symbol per document each round over whole documents takes as many rounds as the longest document has bytes,
and each round passes over all that was inserted before. So the documents are first cut where equal strings must agree:

1. Every window of `length` symbols chooses an anchor, its k-gram of least hash (the leftmost on ties). Equal windows choose
   equal anchors at equal offsets. The windows of one anchor occurrence are consecutive; their symbols are its context.
2. Contexts are counted by (anchor, context). Equal contexts are repeats as a whole; an anchor with one context is none.
3. The distinct contexts of an anchor are a small collection, aligned at the anchor, on which the suffix order and the
   common prefixes are built column by column from the right: each round inserts one symbol of every context, a stable
   sort by that symbol updates the order (its permuted symbols are the column's part of the transform), and range minima
   update the common prefixes. Because equal windows are aligned, only suffixes of one column need comparing. A window
   whose suffix shares `length` symbols with a neighbour is a repeat. Contexts reach a task from the shuffle's sorted files in
   sequence; a batch's columns, below 2 * length symbols for each of its contexts, are the only ones in memory.
4. Anchors of more than `hot` distinct contexts would fill one task. Their windows are counted one by one, by 128-bit
   hashes, in an aggregation that any number of tasks share.

Rows: a null or empty text has nothing to remove; texts shorter than `length` neither; repeated rows, those of a null id too,
are repeats of each other; of ties no order matters, since all copies go; matches never cross documents; texts are taken whole,
whatever their length; an empty table gives no rows; other columns, whatever their names, are ignored, or kept as they were by
without_repeats() and without_passages().
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.llm.common import arrow_stage, numbered, settled, steps_so_far, written
from evigraph.llm.near_dup import _mix

#: Contexts in one batch; the last anchor group of a batch comes on top, with `hot` contexts at most.
BATCH = 20_000
#: Tasks that the windows of one text are dealt to where they are counted one by one.
SALTS = 64
#: Scripts without spaces, of which each character is a word, and what is not of any word: spaces and punctuation.
_SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_NOT_WORD = r"\s!-/:-@\[-`{-~\xa1\xab\xb7\xbb\xbf\u2000-\u206f\u3000-\u303f\uff01-\uff0f"
WORD = re.compile(f"[{_SINGLE}]|[^{_NOT_WORD}{_SINGLE}]+(?:['\u2019-][^{_NOT_WORD}{_SINGLE}]+)*")
_STEP, _POWER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TABLE = _mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
#: Characters of a text that are looked at at a time; a piece without a space in it is taken whole.
PIECE = 1 << 17


def grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` symbols (a power of two) from each position on."""
    h, step = (_TABLE[data] if data.dtype == np.uint8 else _mix(data.astype(np.uint64) * _STEP)), 1
    power = _POWER
    while step < gram:
        h = h[:-step] * power + h[step:]
        power, step = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF), step * 2
    return _mix(h)


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window start, last window start) of the anchors of all windows, by position.

    Of a window's k-grams the one whose hash has the least upper half is taken, the leftmost on ties: the least of these numbers.
    """
    v = grams(data, gram)
    size = length - gram + 1  # k-grams in a window
    half = np.uint64(0xFFFFFFFF)
    low, step = (v & ~half) | np.arange(len(v), dtype=np.uint64), 1
    while step * 2 <= size:
        low, step = np.minimum(low[:-step], low[step:]), step * 2
    if size > step:
        low = np.minimum(low[: step - size], low[size - step :])
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    last = np.r_[first[1:], len(low)] - 1
    at = (low[first] & half).astype(np.int64)
    return v[at], at, first, last


def _bytes(text: str | bytes | None) -> bytes:
    if isinstance(text, bytes):
        return text
    return text.encode("utf-8", "surrogatepass") if text else b""


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])


class _Words:
    """WORD on arrays: finds a text's words by the kinds of its characters, and hashes each by sums of powers."""

    def __init__(self):
        every = "".join(map(chr, range(0x110000)))
        #: Of each character: 1 in a word, 2 joins two parts of a word, 3 a word of its own, 0 else.
        self.kind = np.zeros(len(every), np.uint8)
        for kind, chars in enumerate((f"[^{_NOT_WORD}{_SINGLE}]+", "['\u2019-]", f"[{_SINGLE}]+"), 1):
            for m in re.finditer(chars, every):
                self.kind[m.start() : m.end()] = kind
        self.latin = self.kind[:256].tobytes()
        self.value = _mix(np.arange(1, len(every) + 1, dtype=np.uint64) * _STEP)
        self.powers = self.scale(PIECE)

    @staticmethod
    def scale(n: int) -> tuple[np.ndarray, np.ndarray]:
        """The powers that weigh the characters, and their inverses."""
        return _powers(int(_POWER), n), _powers(pow(int(_POWER), -1, 1 << 64), n)

    def codes(self, text: str) -> bytes:
        """32 bits for each word of the text, one after the other."""
        try:
            data = text.encode("latin-1")
            chars, kind = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(self.latin), np.uint8)
        except UnicodeEncodeError:
            chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            kind = self.kind[chars]
        inside = np.zeros(len(chars) + 2, bool)
        inside[1:-1] = kind == 1
        joins = np.flatnonzero(kind == 2)
        inside[joins[inside[joins] & inside[joins + 2]] + 1] = True
        first, after = np.flatnonzero(inside[1:] > inside[:-1]), np.flatnonzero(inside[1:] < inside[:-1])
        alone = np.flatnonzero(kind == 3)
        if len(alone):
            first, after = np.sort(np.r_[first, alone]), np.sort(np.r_[after, alone + 1])
        power, inverse = self.powers if len(chars) <= PIECE else self.scale(len(chars))
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(self.value[chars] * power[: len(chars)], out=total[1:])
        return (((total[after] - total[first]) * inverse[first]) >> np.uint64(32)).astype("<u4").tobytes()


@lru_cache(maxsize=1)
def _words() -> _Words:
    """One per worker process, of 12 MB."""
    return _Words()


def _word_codes(text: str | None) -> bytes:
    """The codes of the text's words one after the other."""
    codes, at = [], 0
    while text and at < len(text):
        end = at + PIECE
        if end < len(text):
            end = text.rfind(" ", at, end) + 1 or text.find(" ", end) + 1 or len(text)
        codes.append(_words().codes(text[at:end]))
        at = end
    return b"".join(codes)


class Measure(NamedTuple):
    """What repeats are measured in: a text's symbols as bytes, bytes of a symbol, symbols of an anchor's k-gram."""

    data_of: Callable[[str | None], bytes]
    unit: int
    gram: int


BYTES = Measure(_bytes, 1, 32)
WORDS = Measure(_word_codes, 4, 8)


def _occurrences(texts: DataFrame, length: int, measure: Measure) -> DataFrame:
    """One row per document and distinct context: h, c, starts (of the first window, ascending), off (anchor - start), w (windows - 1)."""
    unit, gram = measure.unit, measure.gram

    def run(batches):
        for b in batches:
            for key, x, text in zip(b["id"], b["x"], b["text"], strict=True):
                data = measure.data_of(text)
                if len(data) < length * unit:
                    continue
                hs, pos, first, last = anchors(np.frombuffer(data, f"<u{unit}"), length, gram)
                h, off, w = hs.view(np.int64).tolist(), (pos - first).tolist(), (last - first).tolist()
                lo = first.tolist()
                c = [xxhash.xxh3_64_intdigest(data[s * unit : (s + n + length) * unit], seed=o) - (1 << 63) for s, n, o in zip(lo, w, off, strict=True)]
                starts: dict[tuple, list[int]] = {}
                for k, s in zip(zip(h, c, off, w, strict=True), lo, strict=True):
                    starts.setdefault(k, []).append(s)
                ks = list(starts)
                yield key, x, [k[0] for k in ks], [k[1] for k in ks], list(starts.values()), [k[2] for k in ks], [k[3] for k in ks]

    out = arrow_stage(texts, "id long, x long, h array<long>, c array<long>, starts array<array<int>>, off array<int>, w array<int>", run, out_rows=500)
    out = out.select("id", "x", F.explode(F.arrays_zip("h", "c", "starts", "off", "w")).alias("o"))
    return out.select("id", "x", "o.h", "o.c", "o.starts", "o.off", "o.w")


def repeated_windows(contexts: list[bytes], offs: list[int], groups: list[int], length: int, unit: int = 1) -> list[list[tuple[int, int]]]:
    """For each context the runs (first, last) of window starts whose window another context of its group has at the same
    distance from the anchor. Equal groups must be adjacent."""
    m = len(contexts)
    kind, bits = np.dtype(f"<u{unit}"), 8 * unit + 1
    sizes = np.array([len(c) // unit for c in contexts])
    off = np.array(offs)
    left, right = int(-off.max()), int((sizes - off).max())
    columns = np.zeros((right - left, m), kind)
    for k in range(0, m, 256):
        block = np.zeros((min(256, m - k), right - left), kind)
        for i, c in enumerate(contexts[k : k + 256]):
            at = -left - offs[k + i]
            block[i, at : at + len(c) // unit] = np.frombuffer(c, kind)
        columns[:, k : k + 256] = block.T
    ids = np.asarray(groups)
    rank = np.cumsum(np.r_[0, ids[1:] != ids[:-1]]).astype(np.int64) << bits
    outside = 1 << (bits - 1)
    order = np.arange(m)
    common = np.zeros(m + 1, np.int32)  # of each suffix with the one before it in the order; the last entry bounds ranges
    start_last = sizes - length - off
    runs: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    open_at = np.full(m, -1, np.int64)
    for col in range(right - 1, left - 1, -1):
        symbol = columns[col - left].astype(np.int64)
        inside = (col >= -off) & (col < sizes - off)
        key = (rank + np.where(inside, symbol, outside))[order]
        new = np.argsort(key, kind="stable")
        q, p = new[:-1], new[1:]
        same = (key[q] == key[p]) & (key[p] & (2 * outside - 1) < outside)
        pairs = np.flatnonzero(same)
        lcp = np.zeros(m + 1, np.int32)
        if len(pairs):
            ends = np.empty(2 * len(pairs), np.int64)
            ends[0::2], ends[1::2] = q[pairs] + 1, p[pairs] + 1
            lcp[pairs + 1] = np.minimum.reduceat(common, ends)[0::2] + 1
        order, common = order[new], lcp
        if col <= right - length:
            hit = np.zeros(m, bool)
            near = np.maximum(lcp[:-1], lcp[1:])
            hit[order] = near >= length
            hit &= inside & (col <= start_last)
            began, ended = hit & (open_at < 0), ~hit & (open_at >= 0)
            for i in np.flatnonzero(ended).tolist():
                runs[i].append((col + 1 + offs[i], int(open_at[i])))
                open_at[i] = -1
            for i in np.flatnonzero(began).tolist():
                open_at[i] = col + offs[i]
    for i in np.flatnonzero(open_at >= 0).tolist():
        runs[i].append((left + offs[i], int(open_at[i])))
    return runs


def _cut(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The contexts of the chosen occurrences: h, c, off, ctx, hot."""
    lists = reps.groupBy("id", "x").agg(F.collect_list(F.struct("h", "c", "start", "off", "w", "hot")).alias("want"))
    both = lists.join(texts.withColumnsRenamed({"id": "tid", "x": "tx"}), (F.col("id").eqNullSafe(F.col("tid"))) & (F.col("x") == F.col("tx")))
    # a row may be repeated any number of times: its contexts are cut once
    return both.groupBy("id", "x").agg(F.first("want").alias("want"), F.first("text").alias("text")).select("want", "text")


def _group_runs(cut: DataFrame, length: int, measure: Measure) -> DataFrame:
    unit = measure.unit

    def pieces(batches):
        for b in batches:
            for want, text in zip(b["want"], b["text"], strict=True):
                data = measure.data_of(text)
                for o in want:
                    if not o["hot"]:
                        yield o["h"], o["c"], o["off"], data[o["start"] * unit : (o["start"] + o["w"] + length) * unit]

    def solve(batches):
        def done(held):
            got = repeated_windows([r[3] for r in held], [r[2] for r in held], [r[0] for r in held], length, unit)
            for (h, c, _, _), runs in zip(held, got, strict=True):
                if runs:
                    yield h, c, [{"a": a, "b": z} for a, z in runs]

        held: list[tuple] = []
        for b in batches:
            for row in zip(b["h"], b["c"], b["off"], b["ctx"], strict=True):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield from done(held)
                    held = []
                held.append(row)
        if held:
            yield from done(held)

    parts = arrow_stage(cut, "h long, c long, off int, ctx binary", pieces).repartition("h").sortWithinPartitions("h", "c")
    return arrow_stage(parts, "h long, c long, runs array<struct<a:int,b:int>>", solve)


def _hot_runs(cut: DataFrame, length: int, measure: Measure) -> DataFrame:
    unit = measure.unit

    def windows(batches):
        for b in batches:
            for want, text in zip(b["want"], b["text"], strict=True):
                data = measure.data_of(text)
                for o in want:
                    if o["hot"]:
                        for k in range(o["w"] + 1):
                            d = xxhash.xxh3_128_intdigest(data[(o["start"] + k) * unit : (o["start"] + k + length) * unit])
                            yield o["h"], o["c"], k, (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)

    one = arrow_stage(cut, "h long, c long, k int, p long, q long", windows)
    many = one.groupBy("p", "q").agg(F.count("*").alias("n")).where("n > 1").select("p", "q", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return one.withColumn("salt", F.pmod(F.xxhash64("c", "k"), F.lit(SALTS)).cast("int")).join(many, ["p", "q", "salt"]).groupBy("h", "c").agg(F.collect_list(F.struct(F.col("k").alias("a"), F.col("k").alias("b"))).alias("runs"))


def _covers(texts: DataFrame, length: int, hot: int, measure: Measure = BYTES) -> DataFrame:
    """(sid, sx, cover) of the documents with something to remove; cover: array of (a, b) ranges of symbols, in no order.

    Sides of joins on an anchor are tables, so that Spark can split the partition of a frequent one.
    """
    before = steps_so_far()
    found = written(_occurrences(texts.select("id", "x", "text"), length, measure), "anchors", drop_shuffles=True)
    shared = written(found.groupBy("h").agg(F.sum(F.size("starts")).alias("total")).where("total > 1").select("h"), "shared", drop_shuffles=True)
    found = settled(found.join(shared, "h"), "common", before)  # an anchor that stands nowhere else is never read again
    one = F.struct("id", "x", F.element_at("starts", 1).alias("start"))
    contexts = written(found.groupBy("h", "c", "off", "w").agg(F.sum(F.size("starts")).alias("total"), F.min(one).alias("rep")), "contexts", drop_shuffles=True)
    several = written(contexts.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h", (F.col("m") > hot).alias("hot")), "several", drop_shuffles=True)
    cut = _cut(contexts.join(several, "h").select("h", "c", "off", "w", "rep.*", "hot"), texts)
    runs = _group_runs(cut, length, measure)
    if several.where("hot").take(1):
        runs = runs.unionByName(_hot_runs(cut, length, measure))
    whole = contexts.where("total > 1").select("h", "c", F.array(F.struct(F.lit(0).alias("a"), F.col("w").alias("b"))).alias("runs"))
    single = contexts.where("total = 1").select("h", "c")
    flags = written(whole.unionByName(runs.join(single, ["h", "c"], "left_semi")), "flags", drop_shuffles=True)
    starts = found.join(flags, ["h", "c"]).select("id", "x", F.explode("starts").alias("s"), "runs")
    ranges = F.transform("runs", lambda r: F.struct((F.col("s") + r["a"]).alias("a"), (F.col("s") + r["b"] + length).alias("b")))
    return settled(starts.groupBy(F.col("id").alias("sid"), F.col("x").alias("sx")).agg(F.flatten(F.collect_set(ranges)).alias("cover")), "covers", before)


def _spans(cover: list[dict] | None) -> list[dict]:
    """The maximal runs of the ranges' union, in order."""
    spans: list[dict] = []
    for a, z in sorted((c["a"], c["b"]) for c in cover or ()):
        if spans and a <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], z)
        else:
            spans.append({"start": a, "end": z})
    return spans


def _without(data: bytes, spans: list[dict]) -> bytes:
    kept, at = [], 0
    for s in spans:
        kept.append(data[at : s["start"]])
        at = s["end"]
    return b"".join([*kept, data[at:]])


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, words: int = 51, hot: int = 20_000) -> DataFrame:
    """One row per input row: id, n_bytes, spans (array of (start, end) of the maximal removed runs, in bytes), kept (binary) and
    passages, an array of (start, end) of the maximal runs, in words, of what repeats for `words` words or more."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("x", F.xxhash64("text"))
    joined = texts
    for name, covers in (("cover", _covers(texts, length, hot)), ("passages", _covers(texts, words, hot, WORDS))):
        covers = covers.withColumnRenamed("cover", name)
        joined = joined.join(covers, F.col("id").eqNullSafe(F.col("sid")) & (F.col("x") == F.col("sx")), "left").drop("sid", "sx")

    def remove(batches):
        for b in batches:
            for key, text, cover, passages in zip(b["id"], b["text"], b["cover"], b["passages"], strict=True):
                data, spans = _bytes(text), _spans(cover)
                yield key, len(data), spans, _without(data, spans), _spans(passages)

    span = "array<struct<start:long,end:long>>"
    return arrow_stage(joined.select("id", "text", "cover", "passages"), f"`{id_col}` long, n_bytes long, spans {span}, kept binary, passages {span}", remove)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot: int = 20_000) -> DataFrame:
    """The same rows and columns with the repeats taken out of the text, and n_chars (if there) following.

    A character of which a part is removed goes as a whole. Rows with nothing to remove stay as they are.
    """
    keys = (F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")))
    texts = df.select(keys[0].alias("id"), F.col(text_col).cast("string").alias("text"), keys[1].alias("x"))
    return _taken_out(df, keys, _covers(texts, length, hot), text_col, lambda text, cover: _without(_bytes(text), _spans(cover)).decode("utf-8", "ignore"))


def _taken_out(df: DataFrame, keys: tuple, covers: DataFrame, text_col: str, without: Callable[[str, list[dict]], str]) -> DataFrame:
    names = df.columns
    at, size = names.index(text_col), names.index("n_chars") if "n_chars" in names else -1
    own = numbered(df.select(*[F.col(f"`{c}`") for c in names], *keys))
    key, x = own.columns[-2:]
    joined = own.join(covers, F.col(key).eqNullSafe(F.col("sid")) & (F.col(x) == F.col("sx")), "left").select(*own.columns[:-2], "cover")

    def remove(batches):
        for b in batches:
            for *row, cover in zip(*b.values(), strict=True):
                if cover:
                    row[at] = without(row[at], cover)
                    if size >= 0:
                        row[size] = len(row[at])
                yield tuple(row)

    return arrow_stage(joined, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]), remove)


def _without_words(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans, and without what separates each span from the word after it."""
    at = [m.span() for m in WORD.finditer(text)]
    kept, done = [], 0
    for first, after in ((s["start"], s["end"]) for s in spans):
        kept.append(text[done : at[first][0]])
        done = at[after][0] if after < len(at) else at[after - 1][1]
    return "".join([*kept, text[done:]])


def without_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 51, hot: int = 20_000) -> DataFrame:
    """The same rows and columns with the passages of `words` words or more that stand anywhere else taken out of the text, and
    n_chars (if there) following.

    Passages are alike if their words are, in order and case; spaces and punctuation between the words don't count. Rows with
    nothing to remove stay as they are.
    """
    keys = (F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")))
    texts = df.select(keys[0].alias("id"), F.col(text_col).cast("string").alias("text"), keys[1].alias("x"))
    return _taken_out(df, keys, _covers(texts, words, hot, WORDS), text_col, lambda text, cover: _without_words(text, _spans(cover)))


def query(spark, sf_dir: str) -> DataFrame:
    out = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    in_passages = F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"])
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), in_passages.alias("n_passage_words"))
