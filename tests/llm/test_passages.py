import random
from collections import Counter

import pytest

import corpus_pipeline
from evigraph.llm import repeats
from tests.llm.test_llm import ODD, frame


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_pipeline_takes_out_a_passage_of_51_words(spark):
    rng = random.Random(3)
    passage, short = prose(rng, 51), prose(rng, 50)
    assert len(passage) < 400
    others = [prose(rng, 120) for _ in range(8)]
    texts = [*(f"{a}\n{passage}\n{b}" for a, b in zip(others[:2], others[2:4], strict=True)), *(f"{a}\n{short}\n{b}" for a, b in zip(others[4:6], others[6:], strict=True)), None, ""]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert [got[i]["text"] for i in (0, 1)] == [f"{a}\n{b}" for a, b in zip(others[:2], others[2:4], strict=True)]
    assert [got[i]["text"] for i in range(2, 6)] == texts[2:] and got[0]["n_chars"] == len(got[0]["text"])


def test_words_across_spaces_punctuation_and_scripts():
    assert repeats.WORD.findall("«L'été», don\u2019t re-do\n(x_y) 東京ab") == ["L'été", "don\u2019t", "re-do", "x", "y", "東", "京", "ab"]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_passages_equal_brute_force(spark, hot):
    rng, n = random.Random(8), 20
    base = [prose(rng, rng.randint(5, 60)) for _ in range(25)]
    texts = [*ODD, *(rng.choice([" ", "\n", ", "]).join(" ".join(rng.choice(base).split()[rng.randint(0, 9) :]) for _ in range(rng.randint(0, 5))) for _ in range(60)), "da da " * 30]
    lists = [repeats.WORD.findall(t or "") for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in lists for i in range(len(w) - n + 1))
    want = [[w for j, w in enumerate(ws) if not any(counts[tuple(ws[i : i + n])] > 1 for i in range(max(0, j - n + 1), min(j, len(ws) - n) + 1))] for ws in lists]
    got = {r["doc_id"]: r["text"] for r in repeats.without_passages(frame(spark, texts), words=n, hot=hot).collect()}
    assert [repeats.WORD.findall(got[i] or "") for i in range(len(texts))] == want and want != lists
