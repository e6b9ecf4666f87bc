"""Secret scans: fixed patterns, and a guess-cost model for the values of credential contexts.

The guess cost of a value is the least total, over all its segmentations, of the costs (log10 of guesses) of words,
dates, repeats, keyboard walks and brute-force spans, found by dynamic programming. Every value in a credential context is
costed, whether a fixed pattern finds it or not; one whose cost reaches `min_cost` becomes a span of kind `cred`.

Kinds `assign`, `access` and `hex` are the fixed patterns. Spans are in code points, the end is exclusive.

Words are ranked by three lists, of which the best rank counts: WORDS, the whole words of the tokenizer's vocabulary in the order
of their merges, and the words of the table itself by the number of documents that hold them outside of credential values. Any
number of words is ranked: only those that stand inside a value are looked up, by a join, and each value gets its own. Distinct
values are costed once.

Rows: a null or empty text has no spans; texts are scanned whole; repeated rows give repeated results; spans that start alike
come in the order of the kinds; an empty table gives no rows; other columns, whatever their names, are ignored. Repeats and
walks are segments of any length: repeats come from the longest Lyndon words, and of the starts of a segment only those are kept
that can still become the best, so work grows with n log n in a value's length, and linearly in the rest of a text.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.llm.bpe import default_vocabulary
from evigraph.llm.common import arrow_stage, numbered, written

KINDS = ("assign", "access", "hex", "cred")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Credential contexts of the cost model; wider than ASSIGN. Keys that other words end in begin after no letter, or at a capital
#: letter after a small one (accessToken).
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)|(?-i:(?<![^\W\d_])|(?<=[a-z])(?=[A-Z]))(?:pass|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer|auth))["']?[\x20\t]*(?:[:=]|=>)[\x20\t]*["']?([^\s"',;<>(){}]{6,})""", re.I | re.A)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: Words that guessers try first, the most frequent first.
WORDS = (
    "password", "admin", "welcome", "letmein", "monkey", "dragon", "master", "login", "princess", "sunshine", "shadow", "football",
    "baseball", "iloveyou", "trustno", "hello", "freedom", "whatever", "secret", "superman", "batman", "michael", "jordan", "hunter",
    "test", "guest", "root", "user", "default", "changeme", "example", "sample", "dummy", "placeholder", "your", "token", "apikey",
    "key", "api", "pass", "word", "the", "and", "for", "with", "this", "that", "from", "have", "not", "are", "was", "none", "null",
    "true", "false", "undefined", "redacted", "hidden", "value", "string", "here", "insert", "summer", "winter", "spring", "autumn",
    "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december", "monday",
    "friday", "sunday", "love", "money", "house", "computer", "internet", "server", "database", "service", "account", "system",
)
#: Keyboard rows and orders along which walks go, either way.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv", "qazwsxedcrfv")
#: A year alone, with a month, or with a month and a day; either order; digits only or with one separator.
_YEAR, _MONTH, _DAY, _SEP = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", "[-/._]?"
DATES = [re.compile(_SEP.join(form)) for form in ((_YEAR,), (_YEAR, _MONTH), (_YEAR, _MONTH, _DAY), (_DAY, _MONTH, _YEAR))]
#: Year that guessers begin with.
THIS_YEAR = 2025
#: What counts as a word of the table: letters only, and in so many documents at least, whatever the table's size.
WORD = re.compile(r"[^\W\d_]{3,}")
LEAST = 3
#: Longest word that is looked for at any place of a value; a longer one must be all letters between two others.
INSIDE = 24
_LETTERS = re.compile(r"[^\W\d_]+")


def _date_cost(date: str) -> float:
    """log10 of guesses: years by their distance from THIS_YEAR, 20 at least, times months and days, times separators."""
    digits = re.sub(r"\D", "", date)
    year = int(digits[:4] if digits[:2] in ("19", "20") else digits[-4:])
    days = {4: 1, 6: 12}.get(len(digits), 366)
    return math.log10(max(20, abs(year - THIS_YEAR)) * days * (4 if len(digits) < len(date) else 1))


def _ranks(words: list[str]) -> dict[str, float]:
    return {w: math.log10(i + 2) for i, w in reversed(list(enumerate(words)))}


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[str, float], frozenset[str]]:
    with open(default_vocabulary(), encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    whole = [p[:-4] for p in sorted(pieces, key=pieces.get) if p.endswith("</w>")]
    ranks = _ranks([w for w in whole if WORD.fullmatch(w)])
    for w, rank in _ranks(list(WORDS)).items():
        ranks[w] = min(rank, ranks.get(w, rank))
    steps = frozenset(a + b for row in WALKS for line in (row, row[::-1]) for a, b in zip(line, line[1:], strict=False))
    return ranks, steps


def _orders(a: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, ... characters from each place on, up to the size at which all differ."""
    n, size = len(a), 1
    levels = [np.unique(a, return_inverse=True)[1].astype(np.int32)]
    while size < n and levels[-1].max() < n - 1:
        after = np.zeros(n, np.int64)
        after[:-size] = levels[-1][size:] + 1
        levels.append(np.unique(levels[-1].astype(np.int64) * (n + 1) + after, return_inverse=True)[1].astype(np.int32))
        size *= 2
    return levels


def _lyndon(rank: list[int]) -> np.ndarray:
    """Lengths of the longest Lyndon words from each place on: they end where the next smaller suffix begins."""
    n = len(rank)
    sizes, later = np.empty(n, np.int64), []
    for i in range(n - 1, -1, -1):
        while later and rank[later[-1]] > rank[i]:
            later.pop()
        sizes[i] = (later[-1] if later else n) - i
        later.append(i)
    return sizes


def _repeats(low: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of the maximal repeats: twice the period or longer, and no repeat of a part of the period.

    Each has a longest Lyndon word of its period's length, in the order of the characters or in its reverse, that extends to it.
    """
    a = np.array([ord(c) for c in low], np.int64)
    n = len(a)
    if n < 2:
        return []
    levels = _orders(a)
    i = np.tile(np.arange(n), 2)
    p = np.r_[_lyndon(levels[-1].tolist()), _lyndon(_orders(a.max() - a)[-1].tolist())]
    i, p = i[i + p < n], p[i + p < n]
    ahead, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank, size = levels[k], 1 << k
        x, y = i + ahead, i + p + ahead
        ahead += size * ((y < n) & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]))
        x, y = i - back - size, i + p - back - size
        back += size * ((x >= 0) & (rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)]))
    whole = back + p + ahead >= 2 * p
    return sorted(set(zip((i - back)[whole].tolist(), (i + p + ahead)[whole].tolist(), p[whole].tolist(), strict=True)))


class _Stretch:
    """The least cost of a segment inside a stretch that ends where the text so far does.

    The size's logarithm is concave: of two starts the earlier one gains with each step, and a later one that isn't better when it
    comes in never is. `starts` holds those that can still be the best, the best last, each overtaken by the one before it sooner
    than that is by the one before it.
    """

    __slots__ = ("base", "end", "least", "starts")

    def __init__(self, end: int, least: int, base: float):
        self.end, self.least, self.base = end, least, base
        self.starts: list[tuple[float, int]] = []

    @staticmethod
    def _overtakes(old: tuple[float, int], new: tuple[float, int]) -> float:
        """Where the earlier start is as good as the later one."""
        if new[0] <= old[0]:
            return math.inf
        ratio = 10 ** (new[0] - old[0])
        return (ratio * new[1] - old[1]) / (ratio - 1) if ratio > 1 else math.inf

    def cost(self, end: int, best: list[float], log: list[float]) -> float:
        starts = self.starts
        while len(starts) > 1 and starts[-2][0] + log[end - starts[-2][1]] <= starts[-1][0] + log[end - starts[-1][1]]:
            starts.pop()
        new = best[end - self.least], end - self.least
        if not starts or new[0] + log[self.least] < starts[-1][0] + log[end - starts[-1][1]]:
            while len(starts) > 1 and self._overtakes(starts[-2], starts[-1]) <= self._overtakes(starts[-1], new):
                starts.pop()
            starts.append(new)
        return self.base + starts[-1][0] + log[end - starts[-1][1]]


def _lowered(value: str) -> str:
    low = value.lower()
    return low if len(low) == len(value) else value


def guess_cost(value: str, words: dict[str, float] | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation takes; 0 for an empty value. words: costs of further words."""
    ranks, steps = _tables()
    words = words or {}
    n = len(value)
    low = _lowered(value)
    sizes = ((10, r"[0-9]"), (26, r"[a-z]"), (26, r"[A-Z]"), (33, r"[^0-9a-zA-Z]"))
    per_char = math.log10(max(10, sum(size for size, kind in sizes if re.search(kind, value))))
    dates: dict[int, list[int]] = {}
    for start in range(n):
        if value[start].isdigit():
            for form in DATES:
                if m := form.match(value, start):
                    dates.setdefault(m.end(), []).append(start)
    extra = 0.3  # for guessing where segments begin
    # (start, end, least size, cost but for log10 of the size): any part of such a stretch can be a segment
    stretches = [(s, e, max(3, 2 * p), p * per_char - math.log10(p) + extra) for s, e, p in _repeats(low)]
    start = 0
    for at in range(1, n + 1):
        if at == n or low[at - 1 : at + 1] not in steps:
            stretches.append((start, at, 3, math.log10(20) + extra))
            start = at
    opening: dict[int, list[_Stretch]] = {}
    for s, e, least, base in stretches:
        if s + least <= e:
            opening.setdefault(s + least, []).append(_Stretch(e, least, base))
    letters = [0] * (n + 1)  # how many letters end here
    closed = bytearray(n + 2)  # where letters end
    for m in _LETTERS.finditer(low):
        letters[m.start() + 1 : m.end() + 1] = range(1, m.end() - m.start() + 1)
        closed[m.end()] = 1
    log = [0.0, *np.log10(np.arange(1, n + 1)).tolist()]
    best = [0.0] * (n + 1)
    active: list[_Stretch] = []
    for end in range(1, n + 1):
        cost = best[end - 1] + per_char
        active = [x for x in active if x.end >= end] + opening.pop(end, [])
        for x in active:
            cost = min(cost, x.cost(end, best, log))
        for start in dates.get(end, ()):
            cost = min(cost, best[start] + _date_cost(value[start:end]) + extra)
        run = letters[end]
        for size in (*range(3, min(INSIDE, run) + 1), *((run,) if closed[end] and run > INSIDE else ())):
            part = low[end - size : end]
            rank = ranks.get(part, math.inf)
            if words:
                rank = min(rank, words.get(part, math.inf))
            if rank < math.inf:
                word = value[end - size : end]
                cost = min(cost, best[end - size] + rank + extra + (0 if word.islower() else 0.3 if word.isupper() or word[:1].isupper() else 1))
        best[end] = cost
    return best[n]


def _parts(value: str):
    """Sets of what can be a word inside a value, for a bounded number of places each."""
    low, held = _lowered(value), set()
    for m in _LETTERS.finditer(low):
        run = m[0]
        if len(run) > INSIDE:
            held.add(run)
        for i in range(len(run) - 2):
            held.update(run[i : i + size] for size in range(3, min(INSIDE, len(run) - i) + 1))
            if len(held) > 50_000:
                yield held
                held = set()
    yield held


class _Words(dict):
    """The words of each piece between white space; a store for speed, emptied when full."""

    def __missing__(self, piece: str) -> list[str]:
        if len(self) >= 50_000:
            self.clear()
        found = self[piece] = WORD.findall(piece)
        return found


_words = _Words()


def _outside(text: str) -> set[str]:
    """The words of a text, without the values of credential contexts and what the fixed patterns find."""
    low = text.lower()
    if any(h in low for h in CONTEXT_HINTS):
        low = CONTEXT.sub(" ", ASSIGN.sub(" ", text)).lower()
    return set().union(*map(_words.__getitem__, set(low.split())))


def ranked_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, rank) of all words that LEAST documents or more hold: rank is log10 of one more than the number of words in as many or more.

    The running sum goes over the distinct numbers of documents, of which there are at most as many as the square root of twice
    the number of (document, word) pairs.
    """

    def count(batches):
        held: Counter = Counter()
        for b in batches:
            for text in b["t"]:
                if text:
                    held.update(_outside(text))
                if len(held) > 50_000:
                    yield from held.items()
                    held.clear()
        yield from held.items()
        _words.clear()  # a worker lives on after its task

    parts = arrow_stage(df.select(F.col(text_col).cast("string").alias("t")), "w string, n long", count)
    counts = written(parts.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST), "words")
    many = counts.groupBy("n").agg(F.count("*").alias("words"))
    ranks = many.select("n", F.log10(1 + F.sum("words").over(Window.orderBy(F.desc("n")))).alias("rank"))
    return counts.join(written(ranks, "ranks"), "n").select("w", "rank")


def credentials(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cost: float = 9.0) -> DataFrame:
    """(sid, sx, creds) of the documents with values that cost min_cost or more; sx is the text's hash, creds an array of (start, end, cost)."""
    source = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).withColumn("x", F.xxhash64("t"))

    def values(batches):
        for b in batches:
            for key, x, text in zip(b["k"], b["x"], b["t"], strict=True):
                yield from ((key, x, m.start(1), m.end(1), m[1]) for m in _contexts(text))

    places = arrow_stage(source, "k long, x long, start long, end long, value string", values).withColumn("v", F.sha2("value", 256))
    places = written(places, "places")
    distinct = written(places.groupBy("v").agg(F.first("value").alias("value")), "values")

    def parts(batches):
        for b in batches:
            for v, value in zip(b["v"], b["value"], strict=True):
                yield from ((v, w) for held in _parts(value) for w in held)

    asked = written(arrow_stage(distinct, "v string, w string", parts), "parts")
    # the counts are cut down to what is asked for; the few words left then meet the values
    ranked = written(ranked_words(df, text_col).join(asked.select("w").distinct(), "w", "left_semi"), "ranked")
    known = asked.join(ranked, "w").groupBy("v").agg(F.collect_set(F.struct("w", "rank")).alias("words"))

    def costs(batches):
        for b in batches:
            for v, value, words in zip(b["v"], b["value"], b["words"], strict=True):
                cost = guess_cost(value, {x["w"]: x["rank"] for x in words or ()})
                if cost >= min_cost:
                    yield v, cost

    costed = written(arrow_stage(distinct.join(known, "v", "left"), "v string, cost double", costs), "costs")
    spans = places.join(costed, "v").groupBy(F.col("k").alias("sid"), F.col("x").alias("sx"))
    return written(spans.agg(F.collect_set(F.struct("start", "end", "cost")).alias("creds")), "creds")


def _contexts(text: str | None):
    if text and any(h in text.lower() for h in CONTEXT_HINTS):
        yield from CONTEXT.finditer(text)


def base_spans(text: str | None) -> list[tuple[int, int, int, None]]:
    """(start, number of the kind, end, None) of what the fixed patterns find."""
    if not text:
        return []
    low = text.lower()
    found: list[tuple[int, int, int, None]] = []
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]


def _ordered(found: list[tuple]) -> list[tuple[str, int, int, float | None]]:
    return [(KINDS[k], s, e, c) for s, k, e, c in sorted(found, key=lambda x: x[:3])]


def scan(text: str | None, min_cost: float, words: dict[str, float] | None = None) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, guess cost of the value if any) of one text, by start, then kind as in KINDS."""
    costed = ((m.start(1), 3, m.end(1), guess_cost(m[1], words)) for m in _contexts(text))
    return _ordered([*base_spans(text), *(x for x in costed if x[3] >= min_cost)])


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cost: float = 9.0) -> DataFrame:
    """For each row: the id and `found`, an array of (kind, start, end, cost)."""

    def base(batches):
        for b in batches:
            for key, x, text in zip(b["k"], b["x"], b["t"], strict=True):
                yield key, x, [{"start": s, "kind": k, "end": e, "cost": None} for s, k, e, _ in sorted(base_spans(text), key=lambda x: x[:3])]

    source = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).withColumn("x", F.xxhash64("t"))
    fixed = arrow_stage(source, "k long, x long, base array<struct<start:long,kind:int,end:long,cost:double>>", base)
    creds = credentials(df, id_col, text_col, min_cost)
    both = fixed.join(creds, F.col("k").eqNullSafe(F.col("sid")) & (F.col("x") == F.col("sx")), "left")
    more = F.transform("creds", lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"), c["cost"].alias("cost")))
    spans = F.array_sort(F.when(F.col("creds").isNull(), F.col("base")).otherwise(F.concat("base", more)))
    kinds = F.array(*map(F.lit, KINDS))
    named = F.transform(spans, lambda x: F.struct(F.element_at(kinds, x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["cost"].alias("cost")))
    return both.select(F.col("k").alias(id_col), named.alias("found"))


def redact(df: DataFrame, id_col: str = "doc_id", min_cost: float = 9.0, mark: str = "[SECRET]") -> DataFrame:
    """The same columns; in `text` each run of overlapping spans is replaced by the mark, and `n_chars` follows if there.

    A row without spans keeps its text and n_chars as they are.
    """
    names = df.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
    own = numbered(df)
    key, text = own.columns[names.index(id_col)], own.columns[at]
    creds = credentials(own.select(key, text), key, text, min_cost)
    joined = own.withColumns({"sk": F.col(key).cast("long"), "sh": F.xxhash64(F.col(text).cast("string"))})
    joined = joined.join(creds, F.col("sk").eqNullSafe(F.col("sid")) & (F.col("sh") == F.col("sx")), "left").select(*own.columns, "creds")

    def rows(batches):
        for b in batches:
            for *row, creds in zip(*b.values(), strict=True):
                spans = _ordered([*base_spans(row[at]), *((c["start"], 3, c["end"], c["cost"]) for c in creds or ())])
                if spans:
                    parts, done = [], 0
                    for _, s, e, _ in spans:
                        if s >= done:
                            parts += [row[at][done:s], mark]
                        done = max(done, e)
                    row[at] = "".join([*parts, row[at][done:]])
                    if size >= 0:
                        row[size] = len(row[at])
                yield tuple(row)

    return arrow_stage(joined, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]), rows)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(_joined(F.filter("found", lambda x: x["kind"] != "cred")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
    )
