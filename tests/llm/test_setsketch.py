import random

import numpy as np
import pytest

from kerbsight.llm import setsketch as S
from kerbsight.llm.simhash import shingles


def test_registers_of_a_union_are_maxima():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 700)).astype(np.uint64)
    for n in (1, 6, 40, 700):
        x, y = np.unique(a[:n]), np.unique(b[: n + 3])
        first, second, both = S.sketches([x, y, np.union1d(x, y)])
        assert (both == np.maximum(first, second)).all() and first.min() > 0
    assert not S.sketches([a[:0]]).any()


@pytest.mark.parametrize("n", [8, 100, 5000])
@pytest.mark.parametrize("similarity", [0.5, 0.85, 0.95])
def test_estimates(n, similarity):
    """Of 30 pairs of sets with shared and own elements."""
    rng, sets, sizes = np.random.default_rng(n), [], []
    shared = round(n * 2 * similarity / (1 + similarity))
    for _ in range(30):
        x = rng.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
        sets += [np.unique(x[:n]), np.unique(np.concatenate([x[:shared], x[n:]]))]
        sizes.append(shared / (2 * n - shared))
    found = S.sketches(sets)
    many = np.full(30, float(n))
    best, doubt = S.estimate(found[::2], found[1::2], many, many)
    assert abs(best.mean() - sizes[0]) < 0.03
    if sizes[0] >= 0.85:
        assert (doubt[best < 0.85] < S.DOUBT).all()


def made(seed):
    """Families of texts whose edits put them around the threshold, a large one, and texts of few words."""
    rng, rows = random.Random(seed), []
    for _ in range(15):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(10, 200))]
        for _ in range(rng.randrange(1, 8)):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 40))):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(99)}"
            rows.append(" ".join(words[: len(words) - rng.randrange(0, len(words) // 8 + 1)]))
    common = [f"c{i}" for i in range(120)]
    for i in range(60):
        words = list(common)
        for _ in range(i % 4 + 1):
            words[rng.randrange(120)] = f"own{rng.randrange(9)}"
        rows.append(" ".join(words).upper() if i % 9 == 0 else " ".join(words))
    rows += ["a b", "A  b", "", None, "one two three four five six", "one two three four five", *rows[:5]]
    return list(enumerate(rows))


def brute(rows):
    sets = [(i, set(S.shingles(t or "", 5))) for i, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    smallest = {}
    for i, (k, _) in enumerate(sets):
        smallest[find(i)] = min(smallest.get(find(i), k), k)
    return sorted((k, len(s), smallest[find(i)]) for i, (k, s) in enumerate(sets))


@pytest.mark.parametrize(("seed", "bucket"), [(1, 64), (2, 1)])
def test_classes_equal_brute_force(ws, frame, seed, bucket):
    """With buckets of one, all that hold several classes are cut."""
    rows = made(seed)
    found = S.near_duplicates(ws, frame(rows), "doc_id", "text", bucket)
    want = brute(rows)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert 10 < len({c for _, _, c in want}) < 2 * len(rows) / 3


def test_odd_rows_and_nothing(ws, odd, odd_rows, nothing):
    found = sorted(map(tuple, S.near_duplicates(ws, odd, "doc_id", "text").collect()), key=str)
    classes = {4: 4, 5: 4}
    assert found == sorted(((r[0], len(set(shingles(r[1] or "", 5))), classes.get(r[0], r[0])) for r in odd_rows), key=str)
    assert S.near_duplicates(ws, nothing, "doc_id", "text").count() == 0


def test_unlike_members_of_a_family_are_no_pairs(ws, frame, monkeypatch):
    """150 texts with six edits of their own in 300 words are similar by 0.66; two come again with one more word."""
    rng, base, rows = random.Random(5), [f"w{i}" for i in range(300)], []
    for i in range(150):
        words = list(base)
        for k in rng.sample(range(300), 6):
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    rows += [(900 + i, f"{rows[i][1]} more") for i in range(2)]
    compared, own = [], S.cross_pairs

    def counted(*args):
        found = own(*args)
        compared.append(found.count())
        return found

    monkeypatch.setattr(S, "cross_pairs", counted)
    found = {r[0]: r[2] for r in S.near_duplicates(ws, frame(rows), "doc_id", "text").collect()}
    assert found == {i: i % 900 for i, _ in rows}
    assert sum(compared) < 300
