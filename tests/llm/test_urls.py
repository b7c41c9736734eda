import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kerbsight.llm import urls as U

PAGES = "page_id bigint, url string, html string, host string, rule int, score string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, None, "clash", 1, "z") for i, u in urls], PAGES)


@pytest.mark.parametrize(
    "url, host, path",
    [
        (None, "", ""), ("no scheme", "", ""), ("", "", ""), ("http://", "", ""), ("http://HÖst.COM", "hÖst.com", ""),
        ("x://a/b?c#d", "a", "/b"), ("x://a?b/c", "a", ""), ("x://a#b", "a", ""), ("://a/B://c", "a", "/B://c"),
        ("h://a.b/p\nq?x", "a.b", "/p\nq"),
    ],
)
def test_split(spark, url, host, path):
    df = spark.createDataFrame([(url,)], "u string")
    h, p, _ = U.split_url(F.col("u"))
    assert tuple(df.select(h, p).first()) == (host, path)


@pytest.mark.parametrize(
    "host, path, name",
    [
        ("com", "/", "com/"), ("a.com", "/x", "com/"), ("acom", "/", None), ("a.com", "", None), ("example.com", "/en/1", "example.com/en/"),
        ("m.example.com", "/en/", "example.com/en/"), ("www.example.com", "/en/x", "www.example.com/en/"),
        ("a.www.example.com", "/en/x", "www.example.com/en/"), ("example.com", "/en", "com/"), ("x.net", "/es/a", "net/es/"),
        ("net", "/fr/", "net/fr/"), ("x.net", "/de/", None), ("", "", None),
    ],
)
def test_longest_rule(spark, host, path, name):
    df = spark.createDataFrame([(host, path)], "h string, p string")
    found = df.select(U.longest_rule(F.col("h"), F.col("p"), U.RULES).alias("r")).first()["r"]
    assert (found and found["name"]) == name


def test_equal_rules_block_and_no_rules(spark):
    df = spark.createDataFrame([("a.b", "/")], "h string, p string")
    rules = [U.Rule("b", "/", "allow"), U.Rule("b", "/", "block")]
    assert df.select(U.longest_rule(F.col("h"), F.col("p"), rules).alias("r")).first()["r"]["verdict"] == "block"
    assert df.select(U.longest_rule(F.col("h"), F.col("p"), []).alias("r")).first()["r"] is None


def brute_scores(samples, texts):
    """Counts, smoothed probabilities and scores by dictionaries."""
    order = U.ORDER
    pad = lambda t: U.BEFORE * order + t + U.AFTER
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for text, label in samples:
        s = pad(text)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k][s[i - k : i + 1]][label] += 1
    probability = [{} for _ in range(order + 1)]
    for k in range(order + 1):
        context = defaultdict(Counter)
        kinds = defaultdict(Counter)
        for g, c in counts[k].items():
            for y, n in c.items():
                context[g[:-1]][y] += n
                kinds[g[:-1]][y] += 1
        for g, c in counts[k].items():
            lower = probability[k - 1][g[1:]] if k else {"allow": 1 / 256, "block": 1 / 256}
            p = {}
            for y in ("allow", "block"):
                n, t = context[g[:-1]][y], kinds[g[:-1]][y]
                p[y] = (c[y] + t * lower[y]) / (n + t) if n else lower[y]
            probability[k][g] = p
    out = []
    for text in texts:
        s, score = pad(text), 0
        for i in range(order, len(s)):
            for k in range(order, -1, -1):
                if (p := probability[k].get(s[i - k : i + 1])) is not None:
                    score += round((math.log(p["allow"]) - math.log(p["block"])) * U.UNIT)
                    break
        out.append(score / U.UNIT / (len(text) + 1))
    return out


URLS = [
    (i, f"https://{h}/{p}/{i}") for i, (h, p) in enumerate(
        [(h, p) for h in ("a.com", "shop.com", "x.net", "y.net", "z.org", "example.com", "www.example.com") for p in ("en", "es", "fr", "de", "spam")]
    )
]


@pytest.mark.parametrize("share", [1 << 16, 300, 1])
def test_scores_equal_brute_force(spark, ws, monkeypatch, share):
    monkeypatch.setattr(U, "SHARE", share)
    rows = URLS + [(900, None), (901, ""), (902, "HTTP://A.COM/EN/"), (903, "x://" + "long/" * 2000)]
    got = {r["_id"]: r for r in U.judge_urls(ws, pages(spark, rows)).collect()}
    text = {i: (u.split("://", 1)[1].lower() if u and "://" in u else "") for i, u in rows}
    samples = [(text[i], "allow" if "com/" in r["rule"] and r["verdict"] == "allow" else "block") for i, r in got.items() if r["rule"]]
    want = brute_scores(samples, [text[i] for i, _ in rows])
    assert [got[i]["score"] for i, _ in rows] == pytest.approx(want, abs=1e-8)
    limit = U.threshold(spark.createDataFrame([(s, next((y for t, y in samples if t == text[i]), None) if got[i]["rule"] else None) for (i, _), s in zip(rows, want, strict=True)], "score double, label string"))
    for i, _ in rows:
        if not got[i]["rule"]:
            assert got[i]["verdict"] == ("allow" if got[i]["score"] >= limit else "block")


def test_the_model_tells_the_classes_apart(spark, ws):
    rows = [(i, f"https://s{i}.com/good/page{i}") for i in range(50)] + [(100 + i, f"https://s{i}.net/es/casino{i}") for i in range(50)]
    rows += [(200, "https://q.org/good/page7"), (201, "https://q.org/es/casino7")]
    got = {r["_id"]: r["verdict"] for r in U.judge_urls(ws, pages(spark, rows)).collect()}
    assert got[200] == "allow" and got[201] == "block"


def test_one_class_no_class_nothing(spark, ws):
    only = {r["_id"]: r["verdict"] for r in U.judge_urls(ws, pages(spark, [(1, "x://a.net/es/"), (2, "x://b.org/"), (None, None)])).collect()}
    assert only == {1: "block", 2: "block", None: "block"}
    free = U.judge_urls(ws, pages(spark, [(2, "x://b.org/"), (2, "x://b.org/")])).collect()
    assert [r["verdict"] for r in free] == ["allow", "allow"]
    assert U.judge_urls(ws, pages(spark, [])).collect() == []


def test_a_hot_host_forgets_no_rare_one(spark, ws, monkeypatch):
    """A third of the rows are of one host. What rare rejected hosts teach still counts."""
    monkeypatch.setattr(U, "SHARE", 50)
    rows = [(i, "https://hot.com/same") for i in range(400)]
    rows += [(1000 + i, f"https://h{i * 7919 % 1009}.com/p{i * 104729 % 7919}") for i in range(700)]
    rows += [(3000 + i, f"https://zqxj{i}.net/es/") for i in range(3)] + [(4000, "https://zqxj.org"), (4001, "https://hot.org")]
    got = {r["_id"]: r for r in U.judge_urls(ws, pages(spark, rows)).collect()}
    assert got[4000]["score"] < got[4001]["score"]
    text = {i: u.split("://", 1)[1] for i, u in rows}
    samples = [(text[i], r["verdict"]) for i, r in got.items() if r["rule"]]
    want = brute_scores(samples, [text[i] for i, _ in rows])
    assert [got[i]["score"] for i, _ in rows] == pytest.approx(want, abs=1e-8)
