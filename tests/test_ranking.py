import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbsight.operators.ranking import global_row_number, grouped_percentile, salted_lookup


def test_row_numbers_follow_the_order_over_many_partitions(spark, ws):
    rng = random.Random(1)
    values = rng.sample(range(10**6), 5000)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    got = global_row_number(ws, df, [F.desc("v")], "n").collect()
    assert {r["v"]: r["n"] for r in got} == {
        v: i for i, v in enumerate(sorted(values, reverse=True), 1)
    }


def test_row_numbers_of_an_empty_table(spark, ws):
    df = spark.createDataFrame([], "v long")
    assert global_row_number(ws, df, [F.col("v")], "n").count() == 0


@pytest.mark.parametrize("p", [0.0, 0.25, 0.9, 1.0])
def test_percentiles_with_one_group_that_holds_most_rows(spark, ws, p):
    rng = random.Random(2)
    groups = {"hot": 4000, "small": 7, "pair": 2, "single": 1}
    rows = [(g, rng.choice([rng.random(), 0.5]), i) for g, n in groups.items() for i in range(n)]
    rows.append(("null only", None, 0))
    df = spark.createDataFrame(rows, "g string, v double, id long")
    got = {r["g"]: r["p"] for r in grouped_percentile(ws, df, "g", "v", ["id"], p, "p").collect()}
    expected = {
        g: np.percentile([v for h, v, _ in rows if h == g], 100 * p) for g in groups
    }
    assert got == pytest.approx(expected, abs=1e-12)


def test_salted_lookup_equals_a_plain_left_join(spark):
    rows = [("hot", i) for i in range(500)] + [("a", 1), ("none", 2), (None, 3)]
    left = spark.createDataFrame(rows, "k string, i long")
    right = spark.createDataFrame([("hot", 1.0), ("a", 2.0)], "k string, x double")
    got = salted_lookup(left, right, "k", ["i"]).select("k", "i", "x").collect()
    plain = left.join(right, "k", "left").select("k", "i", "x").collect()
    key = lambda r: (r["k"] or "", r["i"])
    assert sorted(got, key=key) == sorted(plain, key=key)
