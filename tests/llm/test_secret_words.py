import random
import time

import pytest

from evigraph.llm import secrets
from tests.llm.test_llm import frame


def kinds(text):
    return [k for k, *_ in secrets.scan(text, 9.0)]


def test_plain_words_are_no_credentials():
    for text in ("password: required", "token: optional", "secret: ingredients", "compass: northern", "compass: Zx9!kQ2#vLm4"):
        assert not kinds(text), text
    for text in ("pass: Zx9!kQ2#vLm4", "db_pass=Zx9!kQ2#vLm4", "dbpassword: Zx9!kQ2#vLm4", "accessToken: Zx9!kQ2#vLm4", "pwd: xqzvkjwp"):
        assert kinds(text) == ["cred"], text


def test_words_of_the_table_are_cheap_and_its_secrets_are_not(spark):
    texts = [*["il est obligatoire"] * 3, "password: obligatoire", *["password: xqzvkjwpq"] * 4]
    found = {r["doc_id"]: r["found"] for r in secrets.find_secrets(frame(spark, texts)).collect()}
    assert [len(found[i]) for i in range(8)] == [0, 0, 0, 0, 1, 1, 1, 1]
    assert [r["text"] for r in secrets.redact(frame(spark, texts)).orderBy("doc_id").collect()] == [*texts[:4], *["password: [SECRET]"] * 4]


def test_repeats_of_any_period_and_length():
    cost = secrets.guess_cost
    for unit in ("x", "zq", "zqx", "k7v", "zqxkv", "p4zqxkv"):
        long = cost(unit * 40)
        assert long < len(unit) * 1.6 + 2.5 and abs(long - cost(unit * 20)) < 0.5, unit
    assert cost("qw" * 40) < 5
    assert sorted(secrets._repeats("xxabcabcaby")) == [(0, 2, 1), (2, 10, 3)]


def plain_cost(value):
    """Least cost over all cuts into single characters, repeats and walks; for values without words and dates."""
    import math

    _, steps = secrets._tables()
    per, best = math.log10(26), [0.0]
    for end in range(1, len(value) + 1):
        options = [best[end - 1] + per]
        for start in range(end - 2):
            part = value[start:end]
            options += [best[start] + p * per + math.log10(len(part) / p) + 0.3 for p in range(1, len(part) // 2 + 1) if part[p:] == part[:-p]]
            if all(a + b in steps for a, b in zip(part, part[1:])):
                options.append(best[start] + math.log10(20 * len(part)) + 0.3)
        best.append(min(options))
    return best[-1]


def test_cost_is_least_over_repeats_and_walks(monkeypatch):
    import random

    steps = secrets._tables()[1]
    monkeypatch.setattr(secrets, "_tables", lambda: ({}, steps))
    rng = random.Random(4)
    for _ in range(150):
        value = "".join(rng.choice(["qwe", "abx", "x", "zk", "abxabx"]) * rng.randint(1, 4) for _ in range(rng.randint(1, 4)))
        assert abs(secrets.guess_cost(value) - plain_cost(value)) < 1e-9, value


def test_repeats_equal_brute_force():
    import random

    def plain(t):
        found = set()
        for p in range(1, len(t) // 2 + 1):
            start = None
            for i in range(p, len(t) + 1):
                same = i < len(t) and t[i] == t[i - p]
                if same and start is None:
                    start = i - p
                if not same and start is not None:
                    if i - start >= 2 * p and not any(p % q == 0 and s <= start and i <= e for s, e, q in found):
                        found.add((start, i, p))
                    start = None
        return sorted(found)

    rng = random.Random(11)
    for _ in range(400):
        t = "".join(rng.choice("ab" if rng.random() < 0.7 else "abc") for _ in range(rng.randint(0, 40)))
        assert secrets._repeats(t) == plain(t), t


@pytest.mark.parametrize("letters", ["ab", "0123456789", "x", "qwertyuiop"])
def test_long_values_take_seconds(letters):
    rng = random.Random(2)
    value = "".join(rng.choice(letters) for _ in range(200_000))
    start = time.monotonic()
    assert secrets.guess_cost(value) > 0
    assert time.monotonic() - start < 60


def test_words_of_a_table_of_any_size(spark):
    # 150,000 words more frequent than the one asked for, more than were once kept
    many = [chr(97 + i // 17576 % 26) + chr(97 + i // 676 % 26) + chr(97 + i // 26 % 26) + chr(97 + i % 26) + "zzq" for i in range(150_000)]
    texts = [*[" ".join(many)] * 4, *["xqzvkjwpq"] * 3, "password: xqzvkjwpq", "long: " + "jq" * 30, *["jq" * 30] * 3]
    ranks = {r["w"]: r["rank"] for r in secrets.ranked_words(frame(spark, texts)).where("w in ('xqzvkjwpq', 'aaaazzq') or length(w) = 60").collect()}
    assert ranks["xqzvkjwpq"] > ranks["aaaazzq"] > 5 and len(ranks) == 3
    assert [r["found"] for r in secrets.find_secrets(frame(spark, texts)).where("doc_id = 7").collect()] == [[]]


def test_repeated_rows_and_null_ids_have_the_same_spans(spark):
    text = "token=Zx9kQ2vLm4tR7 secret: Zx9kQ2vLm4tR7"
    rows = frame(spark, [text, text, "plain"]).selectExpr("if(doc_id < 2, null, doc_id) as doc_id", "text").unionByName(frame(spark, [text] * 2, 9).selectExpr("9L as doc_id", "text"))
    found = secrets.find_secrets(rows).collect()
    assert len(found) == 5
    for r in found:
        assert [(s["kind"], s["start"]) for s in r["found"]] == ([] if r["doc_id"] == 2 else [("assign", 0), ("cred", 6), ("assign", 20), ("cred", 28)])
    assert sorted(r["text"] for r in secrets.redact(rows).collect()) == [*["[SECRET] [SECRET]"] * 4, "plain"]
