import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kerbsight.operators import daily, features
from kerbsight.sources import files


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def facts(spark, city, ws):
    """The facts as a table partitioned by date."""
    path = ws.path("by-date")
    files.sink_parquet(city.facts, path, ["date_ist"])
    return spark.read.parquet(path)


def test_a_new_day_reads_that_day_only(spark, facts, city, ws):
    dates = sorted({r[0] for r in facts.select("date_ist").distinct().collect()}, key=str)
    last = max(d for d in dates if d is not None)
    states = daily.DailyStates(spark, ws.path("states"))
    states.update(facts, [d for d in dates if d != last])
    of_last = states.of_dates(facts, [last])
    plan = of_last._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(date_ist" in plan and last.isoformat() in plan
    before = {p: p.read_bytes() for p in _files(states.path) if last.isoformat() not in str(p)}
    states.update(facts, [last])
    assert {p: p.read_bytes() for p in _files(states.path) if last.isoformat() not in str(p)} == before
    # the merged states are those of a full build
    assert rows(states.rollup()) == rows(features.rollup(facts))
    assert rows(states.visits()) == rows(features.visits(facts))
    assert rows(features.cell_features(states.visits(), states.rollup())) == rows(city.cells)
    # a day with fewer rows, and one that has lost all
    less = facts.where((F.col("date_ist") != F.lit(last)) | (F.pmod(F.col("id"), F.lit(2)) == 0) | F.col("date_ist").isNull())
    states.update(less, [last])
    assert rows(states.rollup()) == rows(features.rollup(less))
    none = facts.where("date_ist IS NOT NULL").where(F.col("date_ist") != F.lit(last))
    states.update(none, [last, None])
    assert rows(states.visits()) == rows(features.visits(none))


def _files(path):
    from pathlib import Path

    return [p for p in Path(path.removeprefix("file:")).rglob("*.parquet")]


def test_sketches_merge_over_dates(spark, ws):
    """20,000 vehicles over ten days, each seen on two; and minutes of a known distribution."""
    start = dt.datetime(2024, 1, 1)
    base = spark.range(40_000).select(
        F.lit(1).alias("street_q"), F.lit(2).alias("street_r"), F.lit("s").alias("police_station"),
        (F.lit(start) + F.make_interval(days=F.col("id") % 10)).cast("timestamp_ntz").alias("created_datetime"),
        (F.col("id") % 20_000).cast("string").alias("vehicle_number"), F.col("id"),
    )
    facts = base.withColumns({
        "date_ist": F.to_date("created_datetime"),
        "closed_datetime": F.when(F.col("id") % 4 > 0, F.col("created_datetime") + F.make_interval(mins=F.col("id") % 1000)),
    })
    states = ws.save("sketches", daily.sketches(facts))
    assert states.count() == 10
    found = daily.unique_vehicles(states, ["police_station"]).first().unique_vehicles
    assert abs(found - 20_000) <= daily.HLL_BOUND * 20_000
    for p in (0.1, 0.5, 0.9):
        cut = daily.minutes_quantile(states, ["police_station"], p).first().minutes
        assert abs(cut / 1000 - p) <= daily.RANK_BOUND
    nothing = daily.sketches(facts.withColumns({"vehicle_number": F.lit(None).cast("string"), "closed_datetime": F.lit(None).cast("timestamp_ntz")}))
    assert daily.unique_vehicles(nothing, ["street_q"]).count() == 0 == daily.minutes_quantile(nothing, ["street_q"], 0.5).count()


def test_drift_per_day_by_hand(spark):
    reference = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)], "score double")
    days = [("a", float(i)) for i in range(1, 11)] + [("b", 100.0)] * 4 + [("b", None)]
    got = {r.date: (r.n, r.psi) for r in daily.daily_drift(reference, spark.createDataFrame(days, "date string, score double")).collect()}
    assert got["a"] == (10, pytest.approx(0))
    empty = 9 * (1e-4 - 0.1) * math.log(1e-4 / 0.1)
    assert got["b"] == (4, pytest.approx(empty + 0.9 * math.log(10)))


def test_drift_with_equal_scores_and_new_bins(spark):
    """All reference scores equal: one edge, so two bins, one of them without reference."""
    reference = spark.createDataFrame([(5,)] * 3, "score bigint")
    days = spark.createDataFrame([("a", 5), ("a", 9)], "date string, score bigint")
    row = daily.daily_drift(reference, days).first()
    want = (0.5 - 1) * math.log(0.5) + (0.5 - 1e-4) * math.log(0.5 / 1e-4)
    assert row.n == 2 and row.psi == pytest.approx(want)
