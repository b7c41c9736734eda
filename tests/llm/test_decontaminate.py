import math
import random
from collections import Counter

import numpy as np
import pytest

from kerbsight.llm import decontaminate as D
from kerbsight.llm.common import rows_of

RNG = random.Random(4)
VOCABULARY = [f"w{i}x" for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


ITEMS = [(i, prose(RNG.randrange(12, 60))) for i in range(30)] + [(98, None), (99, "..."), (97, "Tiny item")]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(i, t, "c", 1.0) for i, t in ITEMS], "item_id int, text string, start string, similarity double")


def planted():
    """Documents with items: whole, changed in case and signs, with some words replaced, none."""
    rows, want = [], {}
    for i in range(120):
        before, after = prose(RNG.randrange(0, 80)), prose(RNG.randrange(0, 80))
        item, text = ITEMS[i % 30]
        if i % 4 == 0:
            rows.append((i, f"{before} {text} {after}"))
            want[i] = item
        elif i % 4 == 1:
            rows.append((i, f"{before}\n{text.upper().replace(' ', ', ')}! {after}"))
            want[i] = item
        elif i % 4 == 2:
            words = text.split()
            for _ in range(len(words) // 60 + 1):
                words[-1] = "changed"  # at the end: one shingle less
            rows.append((i, f"{before} {' '.join(words)} {after}"))
        else:
            rows.append((i, f"{before} {after}"))
    return rows, want


def brute(rows):
    """All windows of all items, by exact similarity: (doc, item) with the best similarity."""
    words = {i: [w.lower() for w in D._WORDS.findall(t or "")] for i, t in ITEMS}
    gram = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    have = Counter(s for w in words.values() for s in set(gram(w)))
    weight = lambda s: math.log(1 + n_items / have[s]) if s in have else math.log(1 + n_items)
    n_items = sum(t is not None for _, t in ITEMS)
    out = {}
    for d, text in rows:
        w = [x.lower() for x in D._WORDS.findall(text or "")]
        for i, own in words.items():
            if not own:
                continue
            a = Counter(gram(own))
            for at in range(len(w) - len(own) + 1):
                b = Counter(gram(w[at : at + len(own)]))
                if not a.keys() & b.keys():
                    continue
                both = sum(min(a[s], b[s]) * weight(s) for s in a)
                s = both / (sum(n * weight(x) for x, n in a.items()) + sum(n * weight(x) for x, n in b.items()) - both)
                if s >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), round(s, 9))
    return out


@pytest.mark.parametrize("items", [7, 1000])
def test_windows_equal_brute_force(spark, frame, benchmark, items):
    rows, want = planted()
    found = D.find_matches(rows_of(frame(rows), "doc_id", "text"), benchmark, ["_id"], items=items)
    got = {}
    for r in found.collect():
        got[r["_id"], r["item_id"]] = max(got.get((r["_id"], r["item_id"]), 0), round(r["similarity"], 9))
        assert r["distance"] <= D.RADIUS
    assert got == brute(rows)
    assert all((d, i) in got for d, i in want.items())


def test_short_items_match_their_words(spark, frame, benchmark):
    docs = rows_of(frame([(1, "one TINY, item here"), (2, "tiny items"), (3, "tiny item")]), "doc_id", "text")
    got = D.find_matches(docs, benchmark, ["_id"]).collect()
    assert sorted((r["_id"], r["item_id"], r["start"], r["end"]) for r in got) == [(1, 97, 1, 3), (3, 97, 0, 2)]


def test_block_tables_find_all_within_the_radius():
    bench = D.Benchmark([], {}, 1.0)
    rng = np.random.default_rng(2)
    bench.prints = rng.integers(0, 2**63, 60, dtype=np.uint64)
    bench.blocks = [bench.block_table(b) for b in range(D.BLOCKS)]
    fps = bench.prints.copy()
    for k in range(len(fps)):
        for b in rng.choice(64, k % 24, replace=False):
            fps[k] ^= np.uint64(1 << int(b))
    got = set(bench.near(fps, np.arange(60, dtype=np.int32)))
    far = np.bitwise_count(fps[:, None] ^ bench.prints[None, :])
    assert got == {(int(i), int(j), int(far[i, j])) for i, j in np.argwhere(far <= D.RADIUS)}


def test_repeated_passages_are_reported_once_each(spark, frame, benchmark):
    text = ITEMS[3][1]
    docs = rows_of(frame([(1, f"{text} {text} {prose(9)} {text}")]), "doc_id", "text")
    got = D.find_matches(docs, benchmark, ["_id"]).collect()
    n = len(text.split())
    assert sorted(r["start"] for r in got) == [0, n, 2 * n + 9]


def test_odd_rows_and_nothing(spark, odd, nothing, benchmark):
    assert D.find_matches(rows_of(odd, "doc_id", "text"), benchmark, ["_id"]).collect() == []
    assert D.find_matches(rows_of(nothing, "doc_id", "text"), benchmark, ["_id"]).collect() == []
    none = D.find_matches(rows_of(odd, "doc_id", "text"), benchmark.limit(0), ["_id"])
    assert none.collect() == [] and "similarity" in none.columns


def test_contaminated_rows_go(spark, frame, benchmark):
    rows = [(1, prose(30)), (None, f"x {ITEMS[5][1]}"), (None, "clean"), (4, None)]
    got = D.drop_contaminated(spark, frame(rows), benchmark)
    assert got.columns == frame(rows).columns
    assert sorted(r["text"] or "" for r in got.collect()) == sorted(["", "clean", rows[0][1]])


def test_documents_shorter_than_an_item_are_windows(spark, frame, benchmark):
    """Items cut at their end or start, or without one word: each as the whole document."""
    words = {i: [w.lower() for w in D._WORDS.findall(t or "")] for i, t in ITEMS}
    rows = []
    for i, own in list(words.items())[:30]:
        for part in (own[: len(own) * 9 // 10], own[2:], own[:-1], own[1:], own[: len(own) // 2]):
            rows.append((len(rows), " ".join(part)))
        rows.append((len(rows), " ".join(own[: len(own) // 2] + own[len(own) // 2 + 1 :])))
    gram = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    have = Counter(s for w in words.values() for s in set(gram(w)))
    n_items = sum(t is not None for _, t in ITEMS)
    total = lambda c: sum(n * math.log(1 + n_items / have[s]) if s in have else n * math.log(1 + n_items) for s, n in c.items())
    want = {}
    for d, text in rows:
        w = text.split()
        for i, own in words.items():
            if len(w) < len(own):
                a, b = Counter(gram(own)), Counter(gram(w))
                s = total(a & b) / total(a | b)
                if s >= 0.8 - 1e-9:
                    want[d, i] = (0, len(w), round(s, 9))
    found = D.find_matches(rows_of(frame(rows), "doc_id", "text"), benchmark, ["_id"]).collect()
    got = {(r["_id"], r["item_id"]): (r["start"], r["end"], round(r["similarity"], 9)) for r in found}
    assert got == want and len(want) > 60
