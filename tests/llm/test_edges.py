"""Clashing columns, null and repeated ids, ties, long texts and empty tables; and checks against the library and plain versions."""

import hashlib
import random
import struct
import unicodedata
import zlib

import numpy as np
import pytest

import corpus_pipeline
from evigraph.llm import bpe, chat, host_rules, langid, matroska, near_dup, packing, repeats, secrets, warc
from tests.llm.test_llm import ODD, frame, near_expected, repeats_expected
from tests.llm.test_passages import prose

#: Names that the operators use for columns of their own.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, cover string, sid string, sx string, id string, x string, n string, grp string, c0 string, c6 string, k string, t string, h string, node string, found string"


def clashing(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *"abcdefghijklmn") for i, t in rows], CLASH)


def test_stages_keep_clashing_columns(spark):
    rng = random.Random(2)
    passage = prose(rng, 60)
    docs = clashing(spark, [(1, f"{prose(rng, 40)}\n{passage}"), (2, f"{prose(rng, 40)}\n{passage}"), (3, "password=abcdefghijkl1 x"), (None, "words of a null id"), (4, None), (5, "")])
    for stage in (near_dup.one_of_each, repeats.without_repeats, repeats.without_passages, secrets.redact):
        out = stage(docs)
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {tuple("abcdefghijklmn")} and out.count() == 6
    assert sorted(r["n_passage_words"] for r in _passage_words(docs)) == [0, 0, 0, 0, 60, 60]


def _passage_words(docs):
    return [{"n_passage_words": sum(p["end"] - p["start"] for p in r["passages"])} for r in repeats.repeats(docs).collect()]


def test_stages_take_empty_tables(spark):
    docs = clashing(spark, [(1, "a")]).where("doc_id > 1")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.expand(turns)).count() == 0
    _, index = warc.archive(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.lookup(spark.createDataFrame([("k",)], "key string"), index).count() == 0


def test_null_ids_stay(spark):
    docs = clashing(spark, [(None, "one two three four five six"), (None, "one two three four five six"), (7, "one two three four five six")])
    vocabulary = bpe.default_vocabulary()
    model = langid.fit(docs, langid.remainder() != 2)
    for df in (bpe.encode_decode(docs, vocabulary), secrets.find_secrets(docs), host_rules.judge(docs), repeats.repeats(docs), matroska.store(docs), langid.predict(docs, model)):
        assert sorted(str(r["doc_id"]) for r in df.collect()) == ["7", "None", "None"]
    assert {r["doc_id"] for r in packing.pack(docs, vocabulary).collect()} == {7, None}
    near = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect())
    assert near == [("7", 7, True), ("None", None, True), ("None", None, True)]
    assert near_dup.one_of_each(docs).count() == 3


def test_one_id_with_unlike_texts(spark):
    a, b = [" ".join(f"{w}{i}" for i in range(40)) for w in "ab"]
    docs = clashing(spark, [(3, a), (5, b), (5, a), (5, b), (5, ""), (5, None), (5, a + " end"), (9, b)])
    kept = sorted((r["doc_id"], r["text"] or "") for r in near_dup.one_of_each(docs).collect())
    assert kept == [(3, a), (5, ""), (5, ""), (5, b)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect()}
    assert got == {(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False)}


def test_long_texts_and_ties(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["ab", "cd", "ef", "gh"]) + str(rng.randrange(3000)) for _ in range(15_000))
    texts = [long, long[: len(long) // 2] + " changed " + long[len(long) // 2 :], "z" * 60_000, "z" * 60_000, "password: " + "Zx9" * 700]
    docs = clashing(spark, list(enumerate(texts)))
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in near_dup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(5)] == near_expected(texts, 5)
    want = repeats_expected([t[:9000] for t in texts], 400)
    cut = clashing(spark, [(i, t[:9000]) for i, t in enumerate(texts)])
    assert {r["doc_id"]: (bytes(r["kept"]), len(r["spans"])) for r in repeats.repeats(cut).collect()} == dict(enumerate(want))
    assert {r["doc_id"]: len(r["kept"]) for r in repeats.repeats(docs).collect()}[2] == 0
    assert [s["kind"] for s in secrets.find_secrets(docs).where("doc_id = 4").first()["found"]] == ["assign"]
    rules = {r["doc_id"]: r for r in host_rules.judge(docs).collect()}
    assert rules[0]["n_words"] == 15_000 and rules[2]["n_words"] == 1


def test_passages_do_not_grow_by_chance(spark):
    """A word next to a passage whose code begins or ends alike stays."""
    rng = random.Random(6)
    passage = prose(rng, 52).split()
    code = repeats._word_codes
    words = iter(f"w{i}" for i in range(10**7))
    first = next(words)
    near = next(w for w in words if code(w)[-1] == code(first)[-1])
    texts = [" ".join([prose(rng, 70), w, *passage, prose(rng, 70)]) for w in (first, near)]
    got = {r["doc_id"]: r["text"] for r in repeats.without_passages(clashing(spark, list(enumerate(texts)))).collect()}
    assert f" {first} " in got[0] and f" {near} " in got[1] and not any(" ".join(passage[:3]) in t for t in got.values())


def test_packed_ids_are_the_library_s(spark, duck):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_vocabulary())
    texts = [*ODD, "ᲉꟋꟌ\U00010d50 ǅx", *[t for (t,) in duck.sql("select text from documents order by doc_id limit 60").fetchall()]]
    pieces: dict = {}
    for r in packing.pack(clashing(spark, list(enumerate(texts))), bpe.default_vocabulary()).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = struct.pack(f"<{(n := len(x := [*tok.encode(t or '', add_special_tokens=False).ids, 2]))}I", *x)
        for p in pieces[i]:
            assert p["doc_tokens"] == n and p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])


def test_every_letter_is_lower_cased_as_in_the_library():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(bpe.default_vocabulary()), bpe.load(bpe.default_vocabulary())
    letters = [c for c in range(0x110000) if unicodedata.category(chr(c)) in ("Lu", "Lt", "Cn", "Mn", "No")]
    for start in range(0, len(letters), 8000):
        text = " ".join(f"a{chr(c)}b" for c in letters[start : start + 8000])
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_language_equals_a_plain_nearest_centroid(spark):
    docs = clashing(spark, [])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs, langid.remainder() != 2)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in langid.predict(docs, model).limit(60).collect():
        dims, counts = langid.grams(texts[r["doc_id"]])
        v = np.zeros(langid.DIMS)
        v[dims] = (1 + np.log(counts)) * model["idf"][dims]
        cosines = (v / np.linalg.norm(v)) @ model["centroids"] / np.linalg.norm(model["centroids"], axis=0)
        assert model["langs"][model["of"][cosines.argmax()]] == r["lang_pred"] and abs(cosines.max() - r["score"]) < 1e-4


def test_long_noise_is_rejected_and_no_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, langid.remainder() != 2)
    rng = random.Random(1)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (2000, 5000, 20_000) for _ in range(5)]
    assert all(langid.predict_text(model, t)[2] for t in noise)
    assert docs.count() - langid.keep_known(docs, model).count() <= 1


def test_media_samples_read_by_a_plain_reader(spark):
    """The sample blocks of the stored form, found by walking its elements without the operator's parser."""

    def walk(data, at, end):
        while at < end:
            size = 1
            while not data[at] & (0x80 >> (size - 1)):
                size += 1
            key, at = data[at : at + size], at + size
            size = 1
            while not data[at] & (0x80 >> (size - 1)):
                size += 1
            length, at = int.from_bytes(data[at : at + size], "big") & ((1 << 7 * size) - 1), at + size
            if key in (b"\x18\x53\x80\x67", b"\x1f\x43\xb6\x75", b"\xa0"):
                yield from walk(data, at, at + length)
            elif key in (b"\xa3", b"\xa1"):
                yield data[at : at + length]
            at += length

    for text in ("", "abc", "é" * 5000, "x" * 70_000):
        payload = text.encode()
        payload += b"\xff" * (-len(payload) % 576 if payload else 576)
        media = matroska.mux(payload)
        blocks = list(walk(media, 0, len(media)))
        assert {b[3] & 0x06 for b in blocks} <= {0, 4}  # no lacing, or frames of one size after a byte with their number
        assert b"".join(b[5 if b[3] & 0x06 else 4 :] for b in blocks) == payload


def test_warc_reads_payloads_of_revisits_and_notes_damage(spark, tmp_path):
    big = {g: f"<p>{g}" * 400 for g in range(3)}
    pages = [(i, f"http://h.example.com/{i % 5}", big[i % 3] if i % 4 else "small") for i in range(400)] + [(None, "http://h.example.com/0", big[0])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    captures, _ = warc.archive(spark, df, folder)
    index = warc.build_index(captures, f"{folder}/other", files=3, block_lines=16)
    got = warc.lookup(captures, index).collect()
    html = {i: h for i, _, h in pages}
    assert len(got) == 401
    for r in got:
        data = html[r["page_id"]].encode()
        assert bytes(r["payload"]) == data and r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest()
        last = max(i for i, h in html.items() if i is not None and h == html[r["page_id"]])
        assert r["record_type"] == ("response" if len(data) < 1000 or r["page_id"] == last else "revisit") and r["refers_to"] == (last if r["record_type"] == "revisit" else None)
    line = next(x for x in index.find("com,example,h)/1") if index.fetch(x)["type"] == "response")
    record = index.fetch(line)
    with pytest.raises(ValueError):
        index.payload(record | {"payload": record["payload"] + b" "})


def test_exhaustive_guess_cost(monkeypatch):
    """Least cost over all segmentations, each segment at its cheapest kind."""
    import math
    import re

    ranks, steps = secrets._tables()
    ranks = {w: ranks[w] for w in ("password", "summer", "dragon", "the", "key") if w in ranks}
    monkeypatch.setattr(secrets, "_tables", lambda: (ranks, steps))

    def cost(value):
        sizes = ((10, "[0-9]"), (26, "[a-z]"), (26, "[A-Z]"), (33, "[^0-9a-zA-Z]"))
        per = math.log10(max(10, sum(n for n, kind in sizes if re.search(kind, value))))

        def segment(part):
            low, found = part.lower(), [per] if len(part) == 1 else []
            if low in ranks:
                found.append(ranks[low] + 0.3 + (0 if part.islower() else 0.3 if part.isupper() or part[0].isupper() else 1))
            if any(form.fullmatch(part) for form in secrets.DATES):
                found.append(secrets._date_cost(part) + 0.3)
            found += [p * per + math.log10(len(part) / p) + 0.3 for p in range(1, len(part) // 2 + 1) if len(part) > 2 and low[p:] == low[:-p]]
            if len(part) > 2 and all(a + b in steps for a, b in zip(low, low[1:], strict=False)):
                found.append(math.log10(20 * len(part)) + 0.3)
            return min(found, default=math.inf)

        def best(rest):
            return min((segment(rest[:k]) + best(rest[k:]) for k in range(1, len(rest) + 1)), default=0.0)

        return best(value)

    rng = random.Random(9)
    for _ in range(60):
        value = "".join(rng.choice(["qwe", "x", "Summer", "2019", "1999-12", "aa", "zk", "the", "7"]) for _ in range(3))[:12]
        assert abs(secrets.guess_cost(value) - cost(value)) < 1e-9, value


def test_credential_spans_stand_beside_fixed_ones(spark):
    text = "password=Zx9kQ2vLm4tR7 and token: abcabcabcabcabc"
    spans = secrets.scan(text, 9.0)
    assert [(k, text[s:e]) for k, s, e, _ in spans] == [("assign", "password=Zx9kQ2vLm4tR7"), ("cred", "Zx9kQ2vLm4tR7"), ("assign", "token: abcabcabcabcabc")]


def test_rows_repeated_very_often(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    near = [*words[:110], "other", *words[111:]]
    base = frame(spark, [" ".join(words), " ".join(near)])
    docs = base.unionByName(base.where("doc_id = 0").crossJoin(spark.range(3000).toDF("n")).drop("n"))
    largest = spark.sparkContext.accumulator(0)
    plain = near_dup._by_group

    def watched(batches, keys, values, solve):
        def seen(group):
            largest.add(max(0, len(group) - 2))
            return solve(group)

        return plain(batches, keys, values, seen)

    monkeypatch.setattr(near_dup, "_by_group", watched)
    rows = near_dup.near_duplicates(docs).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(map(tuple, rows)) == [(0, 0, True, 3001), (1, 0, False, 1)]
    assert largest.value == 0
    covers = repeats._covers(docs.selectExpr("doc_id as id", "text", "xxhash64(text) as x"), 400, 20_000).collect()
    assert sorted(r["sid"] for r in covers) == [0, 1] and max(len(r["cover"]) for r in covers) < 100
    got = repeats.repeats(docs).selectExpr("doc_id", "length(kept) as n").groupBy("doc_id").agg({"n": "max", "*": "count"}).collect()
    assert {r["doc_id"]: (r["count(1)"], r["max(n)"] > 0) for r in got} == {0: (3001, False), 1: (1, True)}
