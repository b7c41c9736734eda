import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from check import connect, differences
from kerbsight.llm import prefix_trie as P
from tests.conftest import SF_DIR

TURNS = "conv_id bigint, turn int, role string, text string, key string, path int, depth string, words string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "d", "w") for r in rows], TURNS)


def sequences(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            text = text or ""
            sha = hashlib.sha256(text.encode()).digest()
            by[conv].append((turn is not None, turn or 0, role or "", sha, text))
    return {c: [(x[2], x[4]) for x in sorted(turns)] for c, turns in by.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        out[c] = base[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [sums[x] for x in children[node]]
        sums[node] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
        ends = ",".join(str(c) for c in sorted(members[node]) if len(convs[c]) == len(node))
        out.append((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
            len(children[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def result(df):
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert df.columns == columns
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain(ws, df):
    return result(P.trie(ws, ws.save("turns", P.digests(df, "conv_id", "turn", "role", "text"))))


def rebuilt_trie(ws, df):
    return result(P.trie(ws, P.rebuild(ws.save("turns", P.digests(df, "conv_id", "turn", "role", "text")))))


def made(seed):
    """Conversations of few different turns, with ties, repeated rows and nulls everywhere."""
    rng, rows = random.Random(seed), []
    for _ in range(150):
        conv = rng.choice([None, rng.randrange(-70, 200)])
        for i in range(rng.randrange(1, 7)):
            turn = rng.choice([i, i, i, 0, None])
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d\té\n e"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, ws, seed):
    rows = made(seed)
    assert plain(ws, frame(spark, rows)) == brute(sequences(rows))
    assert rebuilt_trie(ws, frame(spark, rows)) == brute(rebuilt(sequences(rows)))


def test_long_conversations_take_few_rounds(spark, ws, monkeypatch):
    """600 turns, two that part at turn 500, one that ends at 450, copies of one, and short ones."""
    long = [(0, i, "user", f"turn {i} of it") for i in range(600)]
    rows = long + [(1, *r[1:3], r[3] if r[1] < 500 else f"{r[3]}!") for r in long] + [(2, *r[1:]) for r in long[:450]]
    rows += [(c, *r[1:]) for r in long for c in (3, 4)] + [(c, 0, "user", f"{c % 3}") for c in range(5, 60)]
    saved = []
    save = type(ws).save
    monkeypatch.setattr(type(ws), "save", lambda self, name, df: saved.append(name) or save(self, name, df))
    assert plain(ws, frame(spark, rows)) == brute(sequences(rows))
    assert saved.count("nodes") <= 6


def test_one_common_conversation(spark, ws):
    """Ids of one node in several blocks, below and above zero."""
    ids = [*range(-3, 3), *range(65_530, 65_545), *range(200_000, 200_003)]
    rows = [(c, t, "user", "same") for c in ids for t in (0, 1)]
    assert plain(ws, frame(spark, rows)) == brute(sequences(rows))


def test_turnless_conversations_belong_to_the_root(spark, ws):
    """Conversations whose own turns are all replaced by those of an absent one."""
    rows = [(c, 0, "user", "x") for c in range(21, 40)]
    convs = rebuilt(sequences(rows))
    assert [] in convs.values()
    got = rebuilt_trie(ws, frame(spark, rows))
    assert got == brute(convs) and (21, 0, None, 19, 1) in {r[:5] for r in got}


def test_long_text_and_nothing(spark, ws):
    rows = [(1, 0, "user", "word " * 300_000), (1, 1, "", ""), (41, 0, "user", "word " * 300_000)]
    assert plain(ws, frame(spark, rows)) == brute(sequences(rows))
    assert plain(ws, frame(spark, [])) == [] == plain(ws, frame(spark, [(None, 0, "user", "x")]))


def test_query_equals_its_sql(spark):
    name = "op13_prefix_trie"
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert differences(got, connect(SF_DIR).execute(entry.oracle_sql()[name]).df()) == ""
