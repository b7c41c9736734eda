import importlib.util
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from kerbsight.llm import QUERIES
from tests.conftest import SF_DIR
from tests.llm.conftest import DOCS

RNG = random.Random(12)
WORDS = ["".join(RNG.choice("abdeilmnorst") for _ in range(RNG.randrange(3, 9))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, ws):
    """Documents with a part for each stage, its labels and its benchmark."""
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        rows.append((i, prose(60) + (" scumbag vermin wretch" if bad else "")))
        labels.append((i, int(bad)))
    items = [(k, prose(40)) for k in range(5)]
    extra = {
        "toxic": [(1000, prose(50) + " scumbag vermin"), (1001, "scumb4g v3rmin wretch " + prose(20))],
        "copies": [(2000 + i, "one  text\nwith copies " + " ".join(WORDS[:30])) for i in range(8)],
        "near": [(3000, " ".join(WORDS[50:350])), (3001, " ".join(WORDS[50:349]) + " edit")],
        "leaks": [(4000, f"{prose(9)} {items[2][1]} {prose(9)}"), (4001, items[0][1].upper())],
        "odd": [(5000, None), (5001, ""), (None, "no id"), (5002, "clean"), (5003, " ")],
    }
    rows += [r for part in extra.values() for r in part]
    path = ws.path("folder")
    docs = spark.createDataFrame(
        [(i, t, "en", "s", None, "x", 7, "y", "z", 1) for i, t in rows], DOCS
    )
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(rows)


def test_each_stage_takes_effect_and_keeps_the_rest(spark, ws, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = ws.save(name.replace(" ", "-"), stage(spark, docs, path))
        assert docs.columns == columns and docs.dtypes == before.dtypes
        assert docs.exceptAll(before).isEmpty()  # rows are as they were
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    toxic, copies, near, leaks = left
    bad = {i for i in range(0, 300, 6)}
    assert toxic == set(rows) - bad - {1000, 1001}
    assert copies == toxic - set(range(2001, 2008)) - {5001}
    assert near == copies - {5003} - ({3001} if 3001 not in near else set())
    assert leaks == near - {4000, 4001}
    encoded = P.STAGES[-1][1](spark, docs, path).collect()
    assert {r["doc_id"] for r in encoded} == leaks and len(encoded) == len(leaks)
    assert all(r["ids"] for r in encoded if (rows[r["doc_id"]] or "").strip())


def test_near_copies_go(spark, folder):
    """3001 has all but one word of 3000; in 6001 every 60th word of 6000 is another."""
    path, rows = folder
    more = [" ".join(WORDS[100:400]), " ".join("edit" if i % 60 == 30 else WORDS[i] for i in range(100, 400))]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", None, "x", 7, "y", "z", 1) for i, t in [*rows.items(), *zip((6000, 6001), more)]], DOCS
    )
    left = {r["doc_id"] for r in P.drop_near_copies(spark, docs, path).collect()}
    assert {3000, 6000} <= left and not {3001, 6001} & left


def test_run_gives_what_the_stages_give(spark, folder):
    path, _ = folder
    got = P.run(spark, path)
    assert got.select("doc_id").distinct().count() == got.count() > 200


def test_nothing_and_odd_rows_pass_every_stage(spark, folder, nothing, odd):
    path, _ = folder
    for _, stage in P.STAGES:
        assert stage(spark, nothing, path).count() == 0
        assert stage(spark, odd, path).count() > 0


def test_stages_in_order():
    assert [f.__name__ for _, f in P.STAGES] == [
        "drop_toxic", "drop_copies", "drop_near_copies", "drop_benchmark", "encode",
    ]
    assert P.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_equal_their_sql(spark, name):
    from check import connect, differences
    from kerbsight.llm import ORACLES

    got = QUERIES[name](spark, SF_DIR).toPandas()
    if name in ORACLES:
        assert differences(got, connect(SF_DIR).execute(ORACLES[name]).df()) == ""
    table = {"op2": "conversations", "op6": "pages"}.get(name[:3], "documents")
    rows = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    assert 0 < len(got)
    if name[:3] not in ("op1", "op2", "op4"):
        assert len(got) == rows


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(importlib.util.find_spec("kerbsight").origin).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
    assert F is not None
