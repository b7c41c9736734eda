import math
import random
import re

import pytest
from pyspark.sql import functions as F

from kerbsight.llm import pii as P
from kerbsight.llm.common import rows_of

REGEX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return {
        k: [m.span() for m in re.finditer(r, text) if valid(k, m[0])] for k, r in REGEX.items()
    }


TEXTS = [
    "", "a@b.c", "x a.b+c%d@e-f.gh.i, y", "a@b", "a@@b.c", "a@b.c_d@e.f", "a@b.c@d.e", "@b.c", "a" * 5000 + "@b",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.0004", "999.1.2.3.4", "1.2.3.", "1..2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111x", "4111  1111 1111 1111", "41111111111111112 1",
    "4111 1111 1111 1111 0000 1", "0" * 16, "0" * 20, "1 2 3 4", "5500 0000 0000 0004 and 340000000000009",
    "+49 (30) 1234-567", "+1", "+1 2", "+123456789012345 6", "++1234567890", "+1-2-3-4-5-6-7-8 x", "+12345678901234567",
    "é😀 mail é.x@y.zz 😀 1.1.1.1 é", "7 " * 3000, "1" * 4000, "+1" + " " * 2000 + "2", "a.b." * 2000 + "@c.d",
]


def test_base_spans_equal_the_patterns(spark, frame):
    rows = list(enumerate(TEXTS))
    got = P.find_base(rows_of(frame(rows), "doc_id", "text"), ["_id"]).collect()
    for r in got:
        text = TEXTS[r["_id"]]
        for kind, want in base(text).items():
            assert [(x["start"], x["end"]) for x in r[kind]] == want, (kind, text[:60])
            assert all(x["value"] == text[x["start"] : x["end"]] for x in r[kind])


def corpus():
    """Marta's address is always beside two words that no other text has, one that one other has, and
    one that many have."""
    rows = [(i, f"the quick text number {i} common words kestrel" if i % 9 else "plain") for i in range(60)]
    rows += [(100 + i, f"call zebulon quietly (kestrel) marta@example.org or halibut, the {i}x9") for i in range(4)]
    rows += [(200, "a halibut swims"), (201, "halibut again"), (300, "lonely once@example.org singular")]
    return rows


def test_disclosure_is_what_counting_gives(spark, ws, frame):
    rows = corpus()
    got = {r["_id"]: r for r in P.find_personal_data(ws, frame(rows)).collect()}
    n, n_e = len(rows), 4
    count = lambda t: sum(t in set(re.split(r"[\W\d_]+", x.lower())) for _, x in rows)
    text = dict(rows)[100]
    want = {}
    for term in ("call", "zebulon", "quietly", "kestrel", "halibut", "the"):
        r = math.log2(n * 4 / (count(term) * n_e)) / math.log2(n / n_e)
        if r >= P.GENERALISE:
            want[term] = ("removed" if r >= P.REMOVE else "generalised", round(r, 9))
    found = {text[x["start"] : x["end"]]: (x["kind"], x["disclosure"]) for x in got[100]["terms"]}
    assert found == want
    assert found["zebulon"][0] == "removed" and found["halibut"][0] == "generalised" and "the" not in found
    assert got[300]["terms"] == [] and got[200]["terms"] == []  # one observation; no entity
    assert len(got) == n


def test_whole_documents_are_looked_at(ws, frame):
    """Far from the address, and at every place of the documents that hold it."""
    far = " ".join(["common words"] * 12)
    rows = [(i, f"zebulon {far} {far if i % 2 else ''} marta@example.org {far} zebulon {'common words'}") for i in range(4)]
    rows += [(10 + i, far) for i in range(40)] + [(60, "zebulon alone")]
    got = {r["_id"]: [(x["start"], x["end"]) for x in r["terms"]] for r in P.find_personal_data(ws, frame(rows)).collect()}
    for i, text in rows:
        want = [m.span() for m in re.finditer("zebulon", text)] if i < 4 else []
        assert got[i] == want, i


def test_pairs_equal_counting_over_whole_documents(ws, frame):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnr"]
    rows = []
    for i in range(150):
        text = rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(40))
        for e in range(6):
            if rng.random() < (0.4 if e == 0 else 0.05):
                text.insert(rng.randrange(len(text) + 1), f"e{e}@example.org")
                text += [f"own{'abcdef'[e]}"] * (rng.random() < 0.9)
        rows.append((i, " ".join(text)))
    rows.append((0, rows[0][1]))
    sets = [(set(re.findall(r"e\d@example.org", t)), set(re.findall(r"(?<!\S)[a-z]{3,}(?!\S)", t))) for _, t in rows]
    n, want = len(rows), []
    for (i, text), (held, terms) in zip(rows, sets, strict=True):
        marked = {}
        for e, t in ((e, t) for e in held for t in terms):
            n_e, n_t = sum(e in x for x, _ in sets), sum(t in y for _, y in sets)
            n_te = sum(e in x and t in y for x, y in sets)
            r = round(math.log2(n * n_te / (n_t * n_e)) / math.log2(n / n_e), 9)
            if n_te >= 2 and r >= P.GENERALISE:
                marked[t] = max(r, marked.get(t, 0))
        places = [(*m.span(), marked[m[0]]) for m in re.finditer(r"(?<!\S)[a-z]{3,}(?!\S)", text) if m[0] in marked]
        want.append((i, places))
    got = P.find_personal_data(ws, frame(rows)).collect()
    got = [(r["_id"], [(x["start"], x["end"], x["disclosure"]) for x in r["terms"]]) for r in got]
    assert sorted(got) == sorted(want) and sum(len(x) for _, x in want) > 50


def test_sanitised_text(spark, ws, frame):
    df = frame(corpus())
    found = P.find_personal_data(ws, df).join(df.select(F.col("doc_id").alias("_id"), "text"), "_id")
    got = found.where("_id = 100").select(P.sanitised(F.col("text")).alias("t")).first()["t"]
    assert got == "  (kestrel) [email] or [word], the 0x9".replace("  ", "   ", 1) or got == "   (kestrel) [email] or [word], the 0x9"


def test_odd_rows_and_nothing(ws, odd, odd_rows, nothing):
    got = P.find_personal_data(ws, odd).collect()
    assert len(got) == len(odd_rows)
    assert all(r["terms"] == [] and not any(r[k] for k in P.KINDS) for r in got)
    assert P.find_personal_data(ws, nothing).collect() == []


def test_an_entity_in_all_documents_discloses_nothing(ws, frame):
    rows = [(i, "write help@example.org whenever") for i in range(5)]
    assert all(r["terms"] == [] for r in P.find_personal_data(ws, frame(rows)).collect())


@pytest.mark.parametrize("number", ["4111111111111111", "4111111111111112", "79927398713", "0", "18"])
def test_luhn(spark, number):
    df = spark.createDataFrame([(number,)], "n string")
    assert df.select(P.luhn(F.col("n")).alias("ok")).first()["ok"] == luhn(number)
