import random
import re
from collections import Counter, defaultdict

import pytest

from kerbsight.llm import divergence as D

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("text", ["", "  ", "A b", "a1b", "É[é]_Z`z{q}", "\x00x\x7fy", "日本 語text", "a b", "x" * 9000 + "-y"])
def test_terms(text):
    assert [t.decode() for t in D.terms(text.encode())] == [lower(t) for t in LETTERS.findall(text)]


def brute(rows, min_docs, top):
    docs = [(lang or "", source or "", [lower(t) for t in LETTERS.findall(text or "")]) for text, lang, source in rows]
    count, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        count[lang, source].update(words)
        held[lang].update(set(words))
    out = set()
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        groups = {s: c for (at, s), c in count.items() if at == lang}
        every = Counter()
        for c in groups.values():
            every.update(c)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(every)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s, c in groups.items():
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found, last in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, i) for i, (item, v) in enumerate(found[:last], 1)}
    return out


def rows_of(found):
    return {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in found.collect()}


def frame(spark, rows):
    schema = "term string, text string, lang string, source string, n int, per int, value string"
    return spark.createDataFrame([("x", t, la, s, 1, 2, "y") for t, la, s in rows], schema)


def made(seed):
    rng, rows = random.Random(seed), []
    for _ in range(150):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s", "s", "s", "t", "u", "é", None])
        words = [rng.choice("abcdefgh") * rng.choice([1, 2]) for _ in range(rng.randrange(40))]
        words += [rng.choice(["É", "日本", "ein", "THE", "q" + (source or "")])] * rng.randrange(4)
        rows.append((rng.choice([" ", "-", "\n", "9"]).join(words) or None, lang, source))
    # a language without kept terms, one with a single source, and a group without terms
    return rows + [("once", "xx", "s"), ("twice", "xx", "t"), ("a a", "yy", "s"), ("1 2 3", "de", "only digits")]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_brute_force(spark, ws, seed):
    rows = made(seed)
    found = rows_of(D.audit(ws, frame(spark, rows), min_docs=5, top=4))
    assert found == brute(rows, 5, 4)
    assert {r[2] for r in found} == {"pair", "term"} and ("xx", "s", "pair", "t", 0, 1) in found


def test_sums_are_handed_on(spark, ws, monkeypatch):
    rows = made(3)
    sums = D.Sums()
    for text, lang, source in rows:
        sums.add(lang or "", source or "", (text or "").encode())
    n = sum(b.num_rows for b in sums.batches())
    assert n == sums.held
    monkeypatch.setattr(D, "HELD", 7)
    assert rows_of(D.audit(ws, frame(spark, rows).coalesce(1), min_docs=5, top=4)) == brute(rows, 5, 4)


def test_probabilities_are_exact(spark):
    """Counts whose product with the scale is beyond 64 bits."""
    n, total, kept = 9_000_000_000_123, 70_000_000_000_777, 1_000_003
    df = spark.createDataFrame([(n, total, kept)], "n bigint, total bigint, kept bigint")
    assert df.select(D.share(df.n, df.total, df.kept)).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def test_odd_rows_and_nothing(ws, odd, odd_rows, nothing):
    assert rows_of(D.audit(ws, odd, min_docs=2)) == brute([(*r[1:2], *(r[2:] or ("en", "s"))) for r in odd_rows], 2, 10)
    assert rows_of(D.audit(ws, nothing)) == set()
