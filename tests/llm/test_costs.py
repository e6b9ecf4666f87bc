"""What operators leave on disk and what their inner loops cost, beside results that plain Python gives too."""

import os
import random
import time

import numpy as np

from evigraph.llm import bpe, packing, repeats
from tests.llm.test_llm import ODD, frame
from tests.llm.test_passages import prose


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}


def test_op10_leaves_no_shuffle_files(spark):
    """They filled the disk until the driver happened to collect garbage."""
    rng = random.Random(4)
    shared = prose(rng, 150)
    texts = [f"{prose(rng, 60)} {shared} {prose(rng, 60)}" for _ in range(6)]
    docs = frame(spark, texts).selectExpr("doc_id as id", "text", "xxhash64(text) as x")
    before = shuffle_files(spark)
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    covers = repeats._covers(docs, 400, 20_000)
    left = shuffle_files(spark) - before
    assert not left and covers.count() == 6
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def words_equal(text, codes, seen):
    words, got = repeats.WORD.findall(text), np.frombuffer(codes, "<u4").tolist()
    assert len(words) == len(got), text[:100]
    for word, code in zip(words, got, strict=True):
        assert seen.setdefault(word, code) == code, word


def test_codes_are_of_the_pattern_s_words(monkeypatch):
    """One code for each word that WORD finds, the same for the same word in any text and at any place."""
    rng, seen = random.Random(1), {}
    for _ in range(4000):
        words_equal(text := "".join(rng.choices("ab'’-- \n.,é東京ก\x00\x1c_😀　ß", k=rng.randint(0, 25))), repeats._word_codes(text), seen)
    for text in ("'", "-", "a'", "'a", "a-b-c'd", "a--b", "x" * 300_000, "ab -" * 60_000, "é" * 140_000 + " b 東東", "ab " * 100_000):
        words_equal(text, repeats._word_codes(text), seen)
    assert repeats._word_codes(None) == repeats._word_codes("") == b"" and len(set(seen.values())) == len(seen)


def test_codes_of_new_words_cost_less_than_finding_them_by_the_pattern():
    """Half of the words of a large table occur once: a store of known words is of no help with them."""
    rng = random.Random(2)
    repeats._word_codes("a")

    def spent(run, text):
        began = time.process_time()
        run(text)
        return time.process_time() - began

    texts = [" ".join(f"{rng.getrandbits(48):x}" for _ in range(60_000)) for _ in range(3)]
    assert min(spent(repeats._word_codes, t) for t in texts) < min(spent(repeats.WORD.findall, t) for t in texts)


def test_anchors_agree_in_equal_windows():
    """Windows with equal symbols choose their anchor at the same distance, and it is the leftmost of the least."""
    rng = np.random.default_rng(5)
    for symbols, kind, length, gram in ((256, np.uint8, 60, 32), (2, np.uint8, 40, 4), (3, "<u4", 12, 8), (1, np.uint8, 50, 32)):
        data = rng.integers(0, symbols, 400).astype(kind)
        upper = (repeats.grams(data, gram) >> np.uint64(32)).tolist()
        h, at, first, last = repeats.anchors(data, length, gram)
        assert first[0] == 0 and last[-1] == len(data) - length and (first[1:] == last[:-1] + 1).all()
        assert (h == repeats.grams(data, gram)[at]).all()
        for p, a, z in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
            for s in range(a, z + 1):
                window = upper[s : s + length - gram + 1]
                assert p == s + window.index(min(window))


def test_words_in_use_stay_in_the_store(monkeypatch):
    """A full store was emptied, and every frequent word merged anew after that; op7's ids are the library's either way."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "KEPT_WORDS", 40)
    merged = []
    own = bpe.LibraryBpe(bpe.default_vocabulary())
    monkeypatch.setattr(own, "merge", lambda word, merge=own.merge: merged.append(word) or merge(word))
    library, rng = Tokenizer.from_file(bpe.default_vocabulary()), random.Random(9)
    texts = [*ODD, *(f"frequent {prose(rng, 5)}" for _ in range(200))]
    for text in texts:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want
        assert len(own) + len(own.older) <= 40
    assert merged.count(b"frequent") == 1 and len(merged) > 400


def test_op7_takes_ids_by_the_library(spark):
    """Merging in Python was most of op7's work; the pieces are the same by either encoder."""
    texts, vocabulary = [*ODD, *(prose(random.Random(i), 40) for i in range(20))], bpe.default_vocabulary()
    by_hand = bpe.load(vocabulary)
    assert all(by_hand.encode(t) == bpe.load_library(vocabulary).encode(t) for t in texts)
    rows = packing.pack(frame(spark, texts), vocabulary).groupBy("doc_id").agg({"doc_tokens": "max", "length": "sum"}).collect()
    assert {r["doc_id"]: (r[1], r[2]) for r in rows} == {i: (n, n) for i, t in enumerate(texts) for n in [len(by_hand.encode(t)) // 4 + 1]}
