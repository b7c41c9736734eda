import random
import time

import numpy as np
import pytest
import xxhash

from kerbsight.llm import simhash as S
from kerbsight.llm.common import rows_of


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(
    "text", ["", " \n", "a", "a b", "A b C", "É é ß x", "a b c d e", "a b c " * 3000, "x " * 9000]
)
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def components(fps):
    values = sorted(set(fps.values()))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    a = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3).tolist():
            parent[find(values[j])] = find(v)
    return {v: find(v) for v in values}


def near_values(n, seed):
    """Clusters of values a few bits apart, chains, and others."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 60])):
            out.add(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                base ^= 1 << rng.randrange(64)
    return sorted(out)[:n]


@pytest.mark.parametrize("bucket", [2, 8, 64])
def test_links_connect_what_brute_force_connects(spark, ws, bucket):
    """Small buckets make the splitting of large ones deep."""
    values = near_values(400, bucket)
    # a dense ball: all within two bits of a centre
    values += [12345 ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = {tuple(r) for r in S.links(ws, nodes, bucket).collect()}
    a = np.array(values, np.uint64)
    want = set()
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3).tolist():
            if signed[i] < signed[j]:
                want.add((signed[i], signed[j]))
    assert found == want and len(want) > 500


def result(ws, df):
    return S.near_duplicates(ws, rows_of(df, "doc_id", "text"), ["_id"]).collect()


def test_classes_equal_brute_force(ws, frame):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) for _ in range(300)) for _ in range(12)]
    rows = []
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "edit"
        rows.append((i, " ".join(words)))
    rows += [(200, ""), (201, None), (202, "  ")]
    fps = {i: brute_fingerprint(t or "") for i, t in rows}
    root = components(fps)
    smallest = {}
    for i, v in fps.items():
        smallest[root[v]] = min(smallest.get(root[v], i), i)
    got = {r["_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in result(ws, frame(rows))}
    assert got == {i: (v, smallest[root[v]]) for i, v in fps.items()}
    assert len(set(smallest.values())) < len(rows) / 2


def test_odd_rows_and_nothing(ws, odd, odd_rows, nothing):
    got = result(ws, odd)
    assert len(got) == len(odd_rows)
    by_id = {r["_id"]: r for r in got}
    assert by_id[2]["fp"] == 0 and by_id[3]["component_id"] == by_id[10]["component_id"] == 1
    assert by_id[5]["component_id"] == 4 and by_id[None]["component_id"] is None
    assert result(ws, nothing) == []


def test_one_of_each_class_stays(spark, odd):
    got = S.keep_one(spark, odd)
    assert got.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in got.collect()) == [-1, 1, 4, 7, 8, 9]


def similar_texts(seed):
    """Texts with copies that have some words replaced, dropped or added, around a similarity of 0.8."""
    rng, rows = random.Random(seed), []
    for _ in range(12):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 8)):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 40))):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(99)}"
            rows.append(" ".join(words[: len(words) - rng.randrange(0, len(words) // 6)]))
    # a large class with an edit each
    common = [f"c{i}" for i in range(120)]
    rows += [" ".join([*common[:i], f"own{i}", *common[i + 1 :]]) for i in range(100)]
    return [(i, t) for i, t in enumerate(rows)] + [(900, "a b"), (901, "A  b"), (902, ""), (903, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_one_of_each_similar_class_stays(spark, frame, seed):
    rows = similar_texts(seed)
    sets = {i: set(S.shingles(t or "", 5)) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    want = {find(i) for i in sets}
    got = [r["doc_id"] for r in S.keep_one(spark, frame(rows)).collect()]
    assert sorted(got) == sorted(want) and 10 < len(want) < len(rows) / 2


def test_similar_texts_far_apart_in_bits_are_one_class(spark, frame):
    """Of 300 words two differ, so 286 of 306 shingles are in both; three bits did not link them."""
    words = [f"w{i}" for i in range(300)]
    edited = [*words[:100], "edit", *words[101:200], "edit", *words[201:]]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:200]))]
    assert sorted(r["doc_id"] for r in S.keep_one(spark, frame(rows)).collect()) == [1, 3]


def test_unrelated_texts_with_one_id_are_two_classes(spark, frame):
    rows = [(1, "one text that is here with its own words"), (1, "another thing that nobody wrote before today")]
    assert S.keep_one(spark, frame([*rows, rows[0]])).count() == 2


def test_classes_of_fingerprints_are_found_first(spark, ws):
    """Three texts whose sets' fingerprints are in one class by chains of at most three bits, and one alone."""
    base = 0x123456789ABCDEF
    fps = {10: base, 4: base ^ 0b111, 7: base ^ 0b111111, 3: base ^ (0xFFFF << 20), 9: base}
    nodes = ws.save("given", spark.createDataFrame(list(fps.items()), "node bigint, fp bigint"))
    got = sorted(tuple(r) for r in S.fingerprint_leaders(ws, nodes).collect())
    assert got == [(7, 4), (9, 4), (10, 4)]


def test_the_stage_links_by_fingerprints(spark, frame, monkeypatch):
    """Almost identical texts are found by their fingerprints, without any prefix in common being needed."""
    words = [f"w{i}" for i in range(2000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "edit"])), (3, "something else that is written here")]
    sets = [S.shingle_set(t, 5) for _, t in rows[:2]]
    assert (S.set_fingerprint(sets[0]) ^ S.set_fingerprint(sets[1])).bit_count() <= 3
    monkeypatch.setattr(S, "prefix_of", lambda own, *_: own[:0])
    assert sorted(r["doc_id"] for r in S.keep_one(spark, frame(rows)).collect()) == [1, 3]


def test_shuffle_files_go_with_their_job(spark, ws):
    """A frame that is read twice is right both times."""
    from kerbsight.llm.common import prepare

    prepare(spark)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in (disk.getAllFiles().apply(i) for i in range(disk.getAllFiles().size())) if f.getName().startswith("shuffle_")}
    before = files()
    found = spark.range(50_000).selectExpr("id % 5000 AS k").groupBy("k").count()
    ws.save("counts", found)
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    assert sorted(found.collect()) == sorted(found.collect()) == [(k, 10) for k in range(5000)]


def test_unlike_members_of_a_family_are_not_compared(spark, ws, frame, monkeypatch):
    """100 texts with forty edits of their own in 1500 words: similarities of about 0.6, and bitmaps that say nothing. Two
    come again with one more word."""
    rng, base, rows = random.Random(3), [f"w{i}" for i in range(1500)], []
    for i in range(100):
        words = list(base)
        for k in rng.sample(range(1500), 40):
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    rows += [(900 + i, f"{rows[i][1]} more") for i in range(2)]
    compared, own = [], S.similar

    def counted(ws, pairs, sets):
        compared.append(pairs.count())
        return own(ws, pairs, sets)

    monkeypatch.setattr(S, "similar", counted)
    left = sorted(r.doc_id for r in S.keep_one(spark, frame(rows)).select("doc_id").collect())
    assert left == list(range(100))
    assert sum(compared) < 500


def test_bitmaps_admit_all_linked_sets_and_few_others():
    """Sets of all sizes, also such whose bitmaps differ in width: no linked pair is refused, and few at a similarity of 0.6."""
    rng = np.random.default_rng(4)
    draw = lambda n: np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
    for n in (1, 5, 63, 64, 65, 900, 1030, 5000):
        base = draw(n)
        few = base[: max(1, -(-4 * len(base) // 5))]  # a similarity of 0.8 or a little more
        pair = [S.parity_bitmap(x) for x in (base, few)]
        assert S.alike(pair[:1], np.array([0, 0]), [pair[1], pair[0]])[0].tolist() == [True, True]
        if n >= 900:
            other = S.parity_bitmap(np.unique(np.concatenate([base[: 3 * len(base) // 4], draw(n // 4)])))
            assert not S.alike(pair[:1], np.array([0]), [other])[0].any()
    assert S.alike([S.parity_bitmap(draw(0))], np.array([0]), [S.parity_bitmap(draw(0))])[0].tolist() == [True]


def test_whole_sets_are_not_sent_for_unlike_pairs(spark, frame, monkeypatch):
    """80 texts of 1500 words with a common passage and forty edits of their own: their sets are neither made nor compared, whatever
    the 256 bits and the places say."""
    rng, base, rows = random.Random(5), [f"w{i}" for i in range(1500)], []
    for i in range(80):
        words = list(base)
        for k in rng.sample(range(1500), 40):
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    rows.append((900, f"{rows[0][1]} more"))
    made, own = [], S.sets_of

    def counted(ws, nodes, *rest):
        found = own(ws, nodes, *rest)
        made.append(found.count())
        return found

    monkeypatch.setattr(S, "sets_of", counted)
    monkeypatch.setattr(S, "has_room", lambda room, *_: room.isNotNull() | True)
    assert sorted(r.doc_id for r in S.keep_one(spark, frame(rows)).select("doc_id").collect()) == list(range(80))
    assert sum(made) < 10
