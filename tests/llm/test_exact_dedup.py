import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbsight.llm import exact_dedup as X
from kerbsight.llm.common import addressed


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 30_000])
def test_filter_holds_all_its_keys_and_few_others(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    f = X.FuseFilter.build(keys)
    assert f.might_hold(keys).all()
    others = np.random.default_rng(n + 1).integers(0, 2**63, 20_000, dtype=np.uint64)
    others = np.setdiff1d(others, keys)
    assert f.might_hold(others).mean() < 0.02
    if n >= 30_000:
        assert len(f.slots) < 1.3 * n  # bytes a key


def expected(rows):
    groups = {}
    for i, text, *_ in rows:
        norm = re.sub("[\x20\x09-\x0d]+", " ", text or "")
        groups.setdefault(norm, []).append(i)
    out = {}
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            out.setdefault((i, norm), (min(known) if known else None, len(ids)))
    return out


def result(ws, df, side=None):
    rows = addressed(ws, df)
    return X.exact_dedup(ws, rows, X.halves(df) if side is None else F.expr(side))


@pytest.mark.parametrize("side", [None, "true", "false", "doc_id % 2 = 0"])
def test_groups_equal_brute_force_whatever_the_snapshot(ws, frame, side):
    rng = np.random.default_rng(3)
    rows = [(int(i), f"text  {rng.integers(0, 40)}\n{'a' * int(rng.integers(0, 3))}") for i in rng.permutation(200)]
    rows += [(1000 + i, "one third of all") for i in range(100)]
    got = result(ws, frame(rows), side).collect()
    want = {i: v for (i, _), v in expected(rows).items()}
    assert {r["_id"]: (r["keep_id"], r["group_size"]) for r in got} == want
    assert {r["_id"] for r in got if r["kept"]} == {v[0] for v in want.values()}
    assert len(got) == len(rows)


def test_odd_rows(ws, odd, odd_rows):
    got = result(ws, odd).collect()
    assert len(got) == len(odd_rows)
    sizes = sorted((r["_id"] or -1, r["group_size"], r["kept"]) for r in got)
    assert sizes == sorted(
        [(1, 3, True), (2, 3, False), (10, 3, False), (3, 1, True), (4, 2, True), (5, 2, False),
         (-1, 2, True), (-1, 2, False), (7, 2, True), (7, 2, False), (8, 1, True), (9, 1, True)]
    )


def test_keep_first_returns_the_rows_as_they_were(spark, odd):
    got = X.keep_first(spark, odd)
    assert got.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in got.collect()) == [-1, 1, 3, 4, 7, 8, 9]


def test_nothing(ws, nothing):
    assert result(ws, nothing).collect() == []


def test_digest_collisions_are_told_apart_by_bytes(ws, frame, monkeypatch):
    """With a digest that says nothing every text is a suspect, and the bytes decide."""
    monkeypatch.setattr(X.F, "xxhash64", lambda *_: X.F.lit(5).cast("bigint"))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c")]
    got = result(ws, frame(rows)).collect()
    assert {r["_id"]: (r["keep_id"], r["group_size"]) for r in got} == {
        1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)
    }
