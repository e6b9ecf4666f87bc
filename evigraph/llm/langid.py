"""Language identification by nearest centroids.

A text becomes a vector of hashed letter n-grams (1 to 3, over lower-cased letters with all else as one gap), weighted by
1 + log(count) and inverse document frequency, of length 1. Each language has several centroids, found by spherical
k-means. The nearest centroid by cosine gives the language; a text that is farther (1 - cosine) from all centroids than the limit
for texts of its length is rejected. Short texts lie far from any centroid, long ones of a learned language don't, so limits
are learned for lengths by powers of two: MARGIN above the distance that all but OUTLIERS of the texts of that length or longer
keep within, and MOST_DISTANCE at most. They are measured on the learning rows, whole and in one fragment of each length.

Learning uses at most `per_language` labelled rows of each language, those with the least hashes of their id; frequencies,
centroids and limits come from these rows. Prediction takes every whole text of all rows.

Rows: a null text, or one without letters, is `und` with score 0, and rejected; with nothing to learn from all are `und`;
repeated rows give repeated results, and those of a null id too; ties go to the language that sorts first; texts are taken whole,
whatever their length; an empty table gives no rows; other columns, whatever their names, are ignored, or kept by keep_known().
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.llm.common import arrow_stage, written

DIMS = 1 << 13
UND = "und"
#: Languages that one model may have: bounds what the driver and each worker hold (3 vectors of 32 KB each).
MOST_LANGUAGES = 2000
#: Farthest that a text of any length may be from its nearest centroid.
MOST_DISTANCE = 0.88
#: Share of the learning texts that may lie beyond the limit less MARGIN; fewest texts that a limit rests on.
OUTLIERS, MARGIN, FEWEST = 0.01, 0.18, 100
#: Classes of length: bits of the number of a text's n-grams.
CLASSES = 64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, counts) of a text's n-grams; empty without letters."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return none
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c], c, 32)
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
    if len(c) < 3:
        return none
    h1 = c * np.uint32(0x9E3779B1)
    h2 = (h1[:-1] ^ (h1[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[1:]
    h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + c[2:]
    h = np.concatenate([h1[c != 32], h2 * np.uint32(0x27D4EB2F), h3 * np.uint32(0x165667B1)])
    counts = np.bincount((h ^ (h >> np.uint32(16))) & np.uint32(DIMS - 1), minlength=DIMS)
    dims = np.flatnonzero(counts)
    return dims, counts[dims]


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf
    return w / np.linalg.norm(w)


def _clusters(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, the next ones are the farthest rows."""
    mean = x.mean(axis=0)
    centres = [mean / np.linalg.norm(mean)]
    while len(centres) < min(k, len(x)):
        near = (x @ np.array(centres).T).max(axis=1)
        centres.append(x[int(near.argmin())])
    c = np.array(centres)
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (at == i).any():
                m = x[at == i].mean(axis=0)
                c[i] = m / np.linalg.norm(m)
    return c


def fit(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, centroids: int = 3) -> dict:
    """The model, a few MB: languages, idf and centroids. Rows where `train` holds and the language isn't null are used."""
    rows = df.where(train & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {"langs": []}
    # the rows of least hash: a threshold that lets through about 1.5 times as many, then the exact number per language
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * per_language / n + 20 / n))])
    sample = rows.where(F.col("h") / F.lit(float(1 << 64)) + 0.5 <= share[F.col("lang")])

    def to_grams(batches):
        for b in batches:
            for lang, h, text in zip(b["lang"], b["h"], b["text"], strict=True):
                dims, n = grams(text)
                if len(dims):
                    yield lang, h, dims.astype("<i4").tobytes(), n.astype("<i4").tobytes(), text

    vectors = arrow_stage(sample, "lang string, h long, dims binary, n binary, text string", to_grams)
    chosen = written(vectors.withColumn("r", F.expr("row_number() over (partition by lang order by h, dims, n)")).where(F.col("r") <= per_language).drop("r"), "langid")

    def frequencies(batches):
        total = np.zeros(DIMS + 1, np.int64)
        for b in batches:
            for dims in b["dims"]:
                total[np.frombuffer(dims, "<i4")] += 1
                total[DIMS] += 1
        yield from ((int(i), int(total[i])) for i in np.flatnonzero(total))

    df_counts = np.zeros(DIMS + 1)
    for r in arrow_stage(chosen.select("dims"), "dim int, n long", frequencies).groupBy("dim").agg(F.sum("n").alias("n")).collect():
        df_counts[r["dim"]] = r["n"]
    idf = np.log((1 + df_counts[DIMS]) / (1 + df_counts[:DIMS])) + 1

    def cluster(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["h", "dims"])
        x = np.zeros((len(pdf), DIMS), np.float32)
        for k, (d, n) in enumerate(zip(pdf.dims, pdf.n, strict=True)):
            d = np.frombuffer(d, "<i4")
            x[k, d] = weights(np.frombuffer(n, "<i4"), idf[d])
        c = _clusters(x, centroids, 8)
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "model": [pickle.dumps(c.astype("<f4"))]})

    found = sorted((r["lang"], r["model"]) for r in chosen.drop("text").groupBy("lang").applyInPandas(cluster, "lang string, model binary").collect())
    parts = [pickle.loads(m) for _, m in found]
    model = {"langs": [lang for lang, _ in found], "idf": idf, "of": np.repeat(np.arange(len(parts)), [len(c) for c in parts]), "centroids": np.concatenate(parts).T.copy(), "limits": np.full(CLASSES, 1.0)}
    return model | {"limits": _limits(chosen, model)}


def _limits(chosen: DataFrame, model: dict) -> np.ndarray:
    """The greatest distance that isn't rejected, by class of length."""
    shared = chosen.sparkSession.sparkContext.broadcast(model)

    def distances(batches):
        seen: Counter = Counter()
        for b in batches:
            for h, text in zip(b["h"], b["text"], strict=True):
                size, parts = 8, [text]
                while size < len(text):
                    start = h % (len(text) - size)
                    parts.append(text[start : start + size])
                    size *= 2
                for part in parts:
                    _, score, length = _nearest(shared.value, part)
                    if length:
                        seen[length, math.ceil((1 - score) * 1000)] += 1
        yield from ((length, d, n) for (length, d), n in seen.items())

    counts = np.zeros((CLASSES, 1001), np.int64)
    for r in arrow_stage(chosen.select("h", "text"), "length int, d int, n long", distances).groupBy("length", "d").agg(F.sum("n").alias("n")).collect():
        counts[r["length"], r["d"]] = r["n"]
    limits = np.full(CLASSES, MOST_DISTANCE)
    longest, held, farthest = CLASSES, np.zeros(1001, np.int64), 0.0
    for length in range(CLASSES - 1, 0, -1):  # lengths with few texts share the limit of the next shorter ones
        held = held + counts[length]
        if held.sum() >= FEWEST:
            farthest = max(farthest, float(np.searchsorted(np.cumsum(held), (1 - OUTLIERS) * held.sum()) / 1000))
            limits[length:longest] = min(MOST_DISTANCE, farthest + MARGIN)
            longest, held = length, np.zeros(1001, np.int64)
    return limits


def _nearest(model: dict, text: str | None) -> tuple[int, float, int]:
    """(language's number, cosine from 0 to 1, class of length); length 0 without letters or languages."""
    dims, counts = grams(text) if model["langs"] else (np.empty(0), None)
    if not len(dims):
        return 0, 0.0, 0
    near = weights(counts, model["idf"][dims]).astype(np.float32) @ model["centroids"][dims]
    best = int(near.argmax())
    return int(model["of"][best]), float(min(1.0, max(0.0, near[best]))), int(counts.sum()).bit_length()


def predict_text(model: dict, text: str | None, most_distance: float = MOST_DISTANCE) -> tuple[str, float, bool]:
    """(language, cosine from 0 to 1, rejected)."""
    lang, score, length = _nearest(model, text)
    if not length:
        return UND, 0.0, True
    return model["langs"][lang], score, 1 - score > min(most_distance, model["limits"][length])


def predict(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", most_distance: float = MOST_DISTANCE) -> DataFrame:
    """One row per input row: id, lang_pred, score and rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b in batches:
            for key, text in zip(b["k"], b["t"], strict=True):
                yield key, *predict_text(shared.value, text, most_distance)

    return arrow_stage(df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")), f"`{id_col}` long, lang_pred string, score double, rejected boolean", rows)


def keep_known(df: DataFrame, model: dict, text_col: str = "text", most_distance: float = MOST_DISTANCE) -> DataFrame:
    """The rows that aren't rejected, all their columns as they were."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def rows(batches):
        for b in batches:
            for row in zip(*b.values(), strict=True):
                if not predict_text(shared.value, row[at], most_distance)[2]:
                    yield row

    return arrow_stage(df, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]), rows)


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; 0 for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4, F.lit(0))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, remainder() != 2)
    return predict(docs, model).withColumn("held_out", remainder() == 2).select("doc_id", "held_out", "lang_pred", "score", "rejected")
