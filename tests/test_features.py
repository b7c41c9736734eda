import datetime as dt
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kerbsight.functions.hexgrid import CITY
from kerbsight.operators import features, heatmap
from kerbsight.operators.cleaning import enrich

DDL = (
    "id string, latitude double, longitude double, violation_type string, created_datetime string, "
    "police_station string, vehicle_type string, vehicle_number string"
)


def facts_of(spark, rows):
    return enrich(spark.createDataFrame(rows, DDL))


def at(hour):
    """Text of a UTC time whose local hour is the given one."""
    return (dt.datetime(2024, 1, 1, hour) - dt.timedelta(minutes=330)).isoformat(" ")


def smallest_mode(values, default):
    counts = Counter(v for v in values if v is not None)
    return min(counts, key=lambda v: (-counts[v], v)) if counts else default


def test_cells_equal_a_row_by_row_computation(city):
    groups = {}
    for row in city.facts.collect():
        if row["cell_street"] is not None:
            groups.setdefault(row["cell_street"], []).append(row)
    got = {r["cell_id"]: r for r in city.cells.collect()}
    assert set(got) == set(groups)
    for cell, rows in groups.items():
        r = got[cell]
        hours = [x["hour_ist"] for x in rows if x["hour_ist"] is not None]
        visits = Counter(x["vehicle_number"] for x in rows if x["vehicle_number"] is not None)
        assert r["violation_count"] == len(rows)
        assert r["severity_sum"] == float(sum(x["severity"] for x in rows))
        assert r["severity_mean"] == pytest.approx(r["severity_sum"] / len(rows))
        assert r["hour_peak"] == smallest_mode(hours, 12)
        assert r["hour_std"] == pytest.approx(statistics.stdev(hours) if len(hours) > 1 else 0.0)
        on_weekday = sum(1 for x in rows if x["day_of_week"] is not None and x["day_of_week"] < 5)
        assert r["weekday_pct"] == pytest.approx(on_weekday / len(rows))
        assert r["vehicle_diversity"] == len({x["vehicle_type"] for x in rows} - {None})
        assert r["top_violation"] == smallest_mode([x["primary_violation"] for x in rows], "UNKNOWN")
        assert r["top_vehicle"] == smallest_mode([x["vehicle_type"] for x in rows], "UNKNOWN")
        assert r["police_station"] == smallest_mode([x["police_station"] for x in rows], "UNKNOWN")
        assert r["unique_vehicles"] == len(visits)
        repeat = sum(1 for n in visits.values() if n > 1)
        assert r["recurrence_score"] == pytest.approx(repeat / len(visits) if visits else 0.0)


def test_cell_with_nothing_but_coordinates(spark):
    facts = facts_of(spark, [("1", 12.9, 77.6, None, None, None, None, None)])
    r = features.cell_features(facts, features.rollup(facts)).first()
    assert (r["hour_peak"], r["hour_std"], r["weekday_pct"], r["vehicle_diversity"]) == (12, 0.0, 0.0, 0)
    assert (r["top_violation"], r["top_vehicle"], r["police_station"]) == ("UNKNOWN",) * 3
    assert (r["unique_vehicles"], r["recurrence_score"]) == (0, 0.0)


def test_equal_counts_take_the_smallest_hour_not_the_smallest_text(spark):
    rows = [(str(i), 12.9, 77.6, None, at(h), "S", None, None) for i, h in enumerate((10, 9, 10, 9, 11))]
    facts = facts_of(spark, rows)
    assert features.cell_features(facts, features.rollup(facts)).first()["hour_peak"] == 9


def test_null_ids_are_rows_but_not_violations(spark):
    rows = [(None, 12.9, 77.6, '["NO PARKING"]', at(9), "S", None, None), ("1", 12.9, 77.6, None, at(9), "S", None, None)]
    facts = facts_of(spark, rows)
    r = features.cell_features(facts, features.rollup(facts)).first()
    assert r["violation_count"] == 1 and r["severity_mean"] == pytest.approx(0.7)
    range_count = heatmap.heatmap_between(facts, None, None).first()["violation_count"]
    assert range_count == 2


def test_recurrence_of_repeated_vehicles(spark):
    rows = [(str(i), 12.9, 77.6, None, None, "S", None, v) for i, v in enumerate(("a", "a", "b", None))]
    got = features.recurrence(facts_of(spark, rows), ["cell_street"]).first()
    assert (got["unique_vehicles"], got["repeat_vehicles"], got["recurrence_score"]) == (2, 1, 0.5)


def test_rows_without_a_station_are_no_station(spark):
    rows = [("1", 12.9, 77.6, None, None, None, None, "a"), ("2", 12.9, 77.6, None, None, "S", None, "a")]
    facts = facts_of(spark, rows)
    got = features.station_features(facts, features.rollup(facts)).collect()
    assert [(r["police_station"], r["violation_count"]) for r in got] == [("S", 1)]


def test_profile_of_a_cell_with_one_hour(spark):
    facts = facts_of(spark, [("1", 12.9, 77.6, None, at(9), "S", None, None), ("2", 12.9, 77.6, None, None, "S", None, None)])
    r = features.temporal_profile(features.rollup(facts)).first().asDict()
    assert r.pop("hour_9") == 1.0 and r.pop("cell_id").startswith("s:")
    assert len(r) == 23 and set(r.values()) == {0.0}


def test_profiles_sum_to_one(city):
    total = sum((F.col(f"hour_{h}") for h in range(24)), F.lit(0.0))
    assert city.temporal_profile.where(F.abs(total - 1) > 1e-9).count() == 0


def test_counts_add_up(city):
    rows = city.facts.where("cell_street IS NOT NULL").count()
    for df in (city.cells, city.heatmap(7), city.heatmap(9)):
        assert df.agg(F.sum("violation_count")).first()[0] == rows


def test_open_and_closed_date_ranges(city):
    everything = city.heatmap(7).agg(F.sum("violation_count")).first()[0]
    dated = city.facts.where("date_ist IS NOT NULL AND cell_city IS NOT NULL").count()
    half = lambda a, b: city.heatmap(7, a, b).agg(F.sum("violation_count")).first()[0]
    assert half(None, "2024-01-10") + half("2024-01-11", None) == dated <= everything
    assert city.heatmap(9, "2030-01-01", None).count() == 0


def test_bad_dates_and_resolutions_raise(city):
    with pytest.raises(ValueError):
        city.heatmap(9, "soon")
    with pytest.raises(ValueError):
        city.heatmap(8)


def test_cells_without_id_have_no_feature(spark):
    ddl = "cell_id string, violation_count long, top_violation string, police_station string, lat double, lng double, hq long, hr long"
    df = spark.createDataFrame([(None, 1, "A", "S", None, None, None, None), ("c:0:0", 2, "A", "S", 12.95, 77.6, 0, 0)], ddl)
    got = heatmap.geojson_features(df, CITY).collect()
    assert [r["feature"]["properties"]["cell_id"] for r in got] == ["c:0:0"]
    assert got[0]["feature"]["type"] == "Feature"


def test_metadata_of_a_date_range(city):
    found = heatmap.geojson_features(city.heatmap(7, "2024-01-10", None), CITY)
    row = heatmap.collection_metadata(found, 7, "2024-01-10", None).first()
    assert row.asDict() == {"resolution": 7, "start": "2024-01-10", "end": None, "feature_count": found.count()}


def test_feature_plans_stay_in_the_jvm(city):
    for df in (city.cells, city.stations, features.cell_features(city.facts, city.rollup)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Window" not in plan and "CartesianProduct" not in plan


def test_recurrence_from_visits_equals_that_from_facts(city):
    visits = features.visits(city.facts)
    for keys in (["street_q", "street_r"], ["police_station"]):
        rows = lambda df: sorted(map(tuple, features.recurrence(df, keys).collect()))  # noqa: B023, E731
        assert rows(visits) == rows(city.facts)


def test_cells_and_stations_scan_no_facts(city):
    for df in (features.cell_features(city.visits, city.rollup), features.station_features(city.visits, city.rollup)):
        assert not any("-facts" in f for f in df.inputFiles())
        assert any("-visits" in f for f in df.inputFiles())
