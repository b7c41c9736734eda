import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbsight.functions.hexgrid import STREET
from kerbsight.operators import hotspots
from kerbsight.operators.hotspots import HotspotParams, detect_hotspots


def cell_table(spark, cells):
    """cells: {(q, r): violation_count}"""
    df = spark.createDataFrame([(q, r, n) for (q, r), n in cells.items()], "hq long, hr long, violation_count long")
    lat, lng = STREET.centroid(F.col("hq"), F.col("hr"))
    return df.withColumns({"lat": lat, "lng": lng, "cell_id": STREET.cell_id(F.col("hq"), F.col("hr"))})


def brute_force(rows, params):
    """Sequential density clustering in the documented cell order."""
    limit = np.percentile([r["violation_count"] for r in rows], params.threshold_pct)
    hot = [r for r in rows if r["violation_count"] >= limit]
    hot.sort(key=lambda r: (-r["violation_count"], r["hq"], r["hr"]))
    points = np.array([(r["lat"], r["lng"]) for r in hot]).reshape(-1, 2)
    near = [
        np.flatnonzero(((points - p) ** 2).sum(axis=1) <= params.eps_deg * params.eps_deg)
        for p in points
    ]
    label, current = [-1] * len(hot), 0
    for i in range(len(hot)):
        if label[i] != -1 or len(near[i]) < params.min_samples:
            continue
        stack, label[i] = [i], current
        while stack:
            x = stack.pop()
            if len(near[x]) < params.min_samples:
                continue
            for y in near[x]:
                if label[y] == -1:
                    label[y] = current
                    stack.append(y)
        current += 1
    return {(r["hq"], r["hr"]): c for r, c in zip(hot, label)}


def random_cells(seed, n, span):
    rng = random.Random(seed)
    return {(rng.randrange(span), rng.randrange(span)): rng.randint(1, 40) for _ in range(n)}


@pytest.mark.parametrize(
    "cells, params",
    [
        (random_cells(1, 400, 40), HotspotParams()),
        (random_cells(2, 500, 35), HotspotParams(min_samples=5)),
        (random_cells(3, 200, 30), HotspotParams(eps_deg=0.008, threshold_pct=50.0)),
    ],
    ids=["default", "five neighbours", "wide"],
)
def test_clusters_equal_a_sequential_scan(spark, ws, cells, params):
    df = cell_table(spark, cells)
    expected = brute_force(df.collect(), params)
    got = detect_hotspots(ws, df.repartition(5), params).collect()
    assert {(r["hq"], r["hr"]): r["cluster_id"] for r in got} == {
        k: expected.get(k, -1) for k in cells
    }
    totals, tops = {}, {}
    for r in got:
        c = r["cluster_id"]
        totals[c] = totals.get(c, 0) + r["violation_count"]
        tops[c] = max(tops.get(c, 0), r["violation_count"])
    ranked = sorted((c for c in totals if c >= 0), key=lambda c: (-totals[c], c))
    for r in got:
        c = r["cluster_id"]
        assert r["is_hotspot"] == (c >= 0)
        assert r["hotspot_rank"] == (ranked.index(c) + 1 if c >= 0 else 0)
        assert r["hotspot_density"] == (r["violation_count"] / tops[c] if c >= 0 else 0.0)


def test_labels_do_not_depend_on_partitioning(spark, ws):
    df = cell_table(spark, random_cells(4, 300, 25))
    labels = [
        sorted((r["hq"], r["hr"], r["cluster_id"]) for r in detect_hotspots(ws, df.repartition(n)).collect())
        for n in (1, 9)
    ]
    assert labels[0] == labels[1]


def test_too_few_cells_give_no_cluster(spark, ws):
    got = detect_hotspots(ws, cell_table(spark, {(0, 0): 5, (1, 0): 4})).collect()
    assert {(r["cluster_id"], r["is_hotspot"], r["hotspot_rank"], r["hotspot_density"]) for r in got} == {
        (-1, False, 0, 0.0)
    }


def test_border_cell_joins_the_first_cluster(spark, ws):
    # Two clumps of core cells with one cell between them that touches both.
    left = {(-2, 0): 50, (-1, 0): 49, (-2, 1): 48, (-3, 1): 47, (-3, 0): 46, (-2, -1): 45, (-1, -1): 44}
    right = {(-q, -r): n - 20 for (q, r), n in left.items()}
    cells = {**left, **right, (0, 0): 1}
    params = replace(HotspotParams(), min_samples=4, threshold_pct=0.0)
    df = cell_table(spark, cells)
    got = {(r["hq"], r["hr"]): r["cluster_id"] for r in detect_hotspots(ws, df, params).collect()}
    assert got == brute_force(df.collect(), params)


@pytest.mark.parametrize("pct", [0.0, 25.0, 60.0, 100.0])
def test_threshold_is_an_interpolated_percentile(spark, pct):
    counts = [1, 2, 4, 8, 16, 32, 32, 5]
    df = spark.createDataFrame([(n,) for n in counts], "violation_count long")
    got = hotspots.count_threshold(df, pct).first()["threshold"]
    assert got == pytest.approx(np.percentile(counts, pct))


def test_summary_of_no_hotspots_is_empty(spark, ws):
    df = detect_hotspots(ws, cell_table(spark, {(0, 0): 5}))
    df = df.withColumns(
        {"severity_mean": F.lit(0.5), "top_violation": F.lit("X"), "police_station": F.lit("S")}
    )
    assert hotspots.summarize_hotspots(df).count() == 0


def points(spark, cells):
    df = cell_table(spark, cells)
    return df.select(F.concat_ws("/", "hq", "hr").alias("id"), "hq", "hr", "lat", "lng")


@pytest.mark.parametrize("eps", [0.0005, 0.001, 0.004, 0.01, 0.04, 0.05])
def test_neighbours_equal_brute_force_for_any_eps(spark, eps):
    cells = random_cells(7, 400, 60) | {(-q, -r - 30): 1 for q, r in random_cells(8, 100, 40)}
    found = points(spark, cells)
    rows = found.collect()
    at = np.array([(r["lat"], r["lng"]) for r in rows])
    near = ((at[:, None] - at[None]) ** 2).sum(axis=2) <= eps * eps
    want = sorted((rows[i]["id"], rows[j]["id"]) for i, j in zip(*np.nonzero(near)))
    got = sorted((r["a"], r["b"]) for r in hotspots.eps_neighbours(found, STREET, eps).collect())
    assert got == want


def test_the_plan_does_not_grow_with_eps(spark):
    found = points(spark, random_cells(7, 50, 20))
    size = lambda eps: len(hotspots.eps_neighbours(found, STREET, eps)._jdf.queryExecution().optimizedPlan().toString())
    assert size(0.04) < size(0.004) * 1.3


def test_a_full_block_of_cells_is_one_cluster(spark, ws):
    cells = {(q, r): 5 for q in range(40) for r in range(40)}
    found = detect_hotspots(ws, cell_table(spark, cells).withColumn("police_station", F.lit("A")), HotspotParams(threshold_pct=0.0))
    assert found.agg(F.count("*"), F.min("cluster_id"), F.max("cluster_id")).first() == (1600, 0, 0)
