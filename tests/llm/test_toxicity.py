import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kerbsight.llm import toxicity as T

BAD = ["scumbag", "wretchedly", "vermin"]
RNG = random.Random(8)
WORDS = ["".join(RNG.choice("abdeilmnorst") for _ in range(RNG.randrange(3, 9))) for _ in range(500)]
DISGUISED = ["scumb4g", "v3rmin", "s.c.u.m.b.a.g", "verrrrmin", "wr3tchedly", "v e r m i n", "$cumbag!!"]


def corpus(n=600):
    rows, labels = [], []
    for i in range(n):
        words = [RNG.choice(WORDS) for _ in range(RNG.randrange(20, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(RNG.randrange(len(words)), RNG.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def model_words():
    rows, _ = corpus()
    return [w for _, t in rows for w in t.split()]


@pytest.fixture(scope="module")
def restorer(model_words):
    words, counts = np.unique(model_words, return_counts=True)
    grams, n = T.gram_counts(words.tolist(), counts)
    return T.Restorer(list(zip(grams.tolist(), n.tolist(), strict=True)))


def test_gram_counts():
    grams, n = T.gram_counts(["ab", "a"], np.array([2, 3]))
    code = lambda s: (ord(s[0]) << 42) | (ord(s[1]) << 21) | ord(s[2])
    got = dict(zip(grams.tolist(), n.tolist(), strict=True))
    assert got == {
        code("\x02\x02a"): 5, code("\x02ab"): 2, code("ab\x03"): 2, code("\x02a\x03"): 3
    }


def test_viterbi_finds_the_cheapest_reading(restorer):
    from itertools import product

    for word in ["v3rm1n", "s.cu", "aa4", "b00"]:
        best = None
        for way in product(*T.readings(word)):
            text, cost = "".join(x for x, _ in way), sum(p for _, p in way)
            padded = "\x02\x02" + text + "\x03"
            cost += sum(
                restorer.model.cost(*map(ord, padded[k : k + 3])) for k in range(len(padded) - 2)
            )
            best = min(best or (cost, text), (cost, text))
        assert T.restore(restorer.model, word) == best[1]


@pytest.mark.parametrize("text", DISGUISED)
def test_disguises_are_restored(restorer, text):
    (words,) = restorer.words(pa.array([text])).to_pylist()
    assert any(w in ("scumbag", "vermin", "wretchedly") for w in words)


def test_long_tokens_and_runs_are_read_whole(restorer, monkeypatch):
    (words,) = restorer.words(pa.array(["s" + "c" * 50 + "umb4g " + "-".join(["v3rmin"] * 9)])).to_pylist()
    assert "scumbag" in words and "vermin" * 9 in words
    text = " ".join("".join(RNG.choices(BAD, k=1)[0]) for _ in range(30))
    (words,) = restorer.words(pa.array([" ".join(text.replace(" ", ""))])).to_pylist()
    assert "".join(w for w in words if len(w) > 1) and all(" " not in w for w in words)
    joined = T.restore(restorer.model, " ".join(text.replace(" ", "")))
    assert joined.replace(" ", "") == text.replace(" ", "")
    # what is settled early is what one search over all gives
    token = "-".join(RNG.choice(WORDS).replace("e", "3") for _ in range(700))
    assert len(token) > 3 * T.SETTLED
    whole = T.restore(restorer.model, token)
    monkeypatch.setattr(T, "SETTLED", 1 << 30)
    assert T.restore(restorer.model, token) == whole


def test_a_space_may_end_a_word(restorer):
    best = None
    run = "v e r m i n"
    for mask in range(1 << 5):
        text = "".join(c + (" " if c != "n" and mask >> i & 1 else "") for i, c in enumerate("vermin"))
        cost = 5 * T.APART
        for word in text.split(" "):
            padded = "\x02\x02" + word + "\x03"
            cost += sum(restorer.model.cost(*map(ord, padded[k : k + 3])) for k in range(len(padded) - 2))
        best = min(best or (cost, text), (cost, text))
    assert T.restore(restorer.model, run) == best[1]


def test_plain_words_stay(restorer):
    got = restorer.words(pa.array(["The, cat. (sat)", "", "x" * 60, "a b c"])).to_pylist()
    assert [sorted(x) for x in got] == [["cat", "sat", "the"], [], ["x" * 60], ["a", "b", "c"]]


def scored(ws, docs, labels):
    return {r["_id"]: r["score"] for r in T.score_toxicity(ws, docs, labels, []).collect()}


def test_held_out_accuracy(spark, ws, frame):
    rows, labels = corpus()
    rows += [(10_000 + i, f"{' '.join(RNG.choices(WORDS, k=30))} {x} {x} {' '.join(RNG.choices(WORDS, k=9))}") for i, x in enumerate(DISGUISED)]
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = scored(ws, frame(rows), table)
    assert len(got) == len(rows)
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == bool(y) for i, y in held)
    assert len(held) > 80 and right / len(held) > 0.97
    assert all(got[10_000 + i] >= 0.5 for i in range(len(DISGUISED)))
    # held-out labels have no part in a score
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    assert scored(ws, frame(rows), spark.createDataFrame(turned, "doc_id bigint, toxic int")) == got


def test_odd_rows_without_labels_and_nothing(spark, ws, odd, odd_rows, nothing):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = T.score_toxicity(ws, odd, none, []).collect()
    assert len(got) == len(odd_rows) and {r["score"] for r in got} == {0.0}
    one = spark.createDataFrame([(4, 1), (7, None), (None, 1)], "doc_id bigint, toxic int")
    assert {r["score"] for r in T.score_toxicity(ws, odd, one, []).collect()} <= {0.0, 1.0}
    assert T.score_toxicity(ws, nothing, none, []).collect() == []


def test_odd_rows_with_labels(spark, ws, frame, odd_rows):
    rows, labels = corpus(300)
    rows = [(100 + i, t) for i, t in rows] + [r[:2] for r in odd_rows]
    table = spark.createDataFrame([(100 + i, y) for i, y in labels] + [(100, 0), (1, None)], "doc_id bigint, toxic int")
    got = T.score_toxicity(ws, frame(rows), table, []).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] < 0.5 for r in got if r["_id"] in (1, 2, 3))
