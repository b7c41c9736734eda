import datetime as dt

import pytest

from kerbsight.operators import quality

DDL = (
    "id string, latitude double, longitude double, violation_type string, created_datetime timestamp_ntz, "
    "police_station string, closed_datetime timestamp_ntz, junction_name string"
)
T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def good(i, **changes):
    row = {
        "id": str(i), "latitude": 12.9, "longitude": 77.6, "violation_type": None, "created_datetime": T0,
        "police_station": "S", "closed_datetime": T1, "junction_name": "J",
    }
    return {**row, **changes}


def report(spark, rows, drop=()):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], DDL).drop(*drop)
    return {r["check"]: r for r in quality.report(df).collect()}


def test_clean_data_passes_everything(spark):
    got = report(spark, [good(i) for i in range(5)])
    assert {r["status"] for r in got.values()} == {"ok"}
    assert got["summary"]["value"] == 5


def test_null_ids_count_as_copies_of_each_other(spark):
    got = report(spark, [good(1), good(1), good(1, id=None), good(1, id=None)])
    assert got["duplicate_ids"]["value"] == 2
    assert got["duplicate_ids"]["message"] == "Duplicate IDs: 2"
    assert got["summary"]["value"] == 4


@pytest.mark.parametrize("bad, status", [(0, "ok"), (5, "warning"), (6, "error")])
def test_outlier_share_decides_between_warning_and_error(spark, bad, status):
    rows = [good(i, latitude=20.0 if i < bad else 12.7) for i in range(100)]
    got = report(spark, rows)
    assert got["geo_outliers"]["status"] == status
    assert got["geo_outliers"]["value"] == bad


def test_missing_coordinates_are_outside(spark):
    got = report(spark, [good(1, latitude=None), good(2, longitude=77.9)])
    assert got["geo_outliers"]["value"] == 1
    assert got["geo_outliers"]["message"] == "Too many geo outliers: 1 (50.0%)"


def test_order_of_dates_is_checked_where_both_exist(spark):
    rows = [
        good(1, closed_datetime=T0, created_datetime=T1),
        good(2, closed_datetime=None),
        good(3, created_datetime=None),
    ]
    got = report(spark, rows)
    assert got["closed_before_created"]["value"] == 1
    assert got["closed_datetime_null"]["value"] == 1 and got["closed_datetime_null"]["pct"] == 33.3
    assert got["created_datetime_null"]["value"] == 1


def test_sparse_junctions_warn(spark):
    rows = [good(1, junction_name=None), good(2, junction_name=" no JUNCTION "), good(3)]
    got = report(spark, rows)["no_junction"]
    assert (got["status"], got["value"], got["pct"]) == ("warning", 2, 66.7)


def test_checks_on_absent_columns_are_left_out(spark):
    got = report(spark, [good(1)], drop=["closed_datetime", "junction_name"])
    assert set(got) == {"duplicate_ids", "geo_outliers", "created_datetime_null", "summary"}
    assert got["summary"]["value"] == 3


def test_missing_required_column_stops_the_report(spark):
    got = report(spark, [good(1)], drop=["police_station"])
    assert got["required_columns"]["status"] == "error"
    assert "police_station" in got["required_columns"]["message"]


def test_gate_raises_on_errors_and_returns_warnings(spark):
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], DDL)
    with pytest.raises(quality.ValidationError, match="geo outliers"):
        quality.gate(frame([good(1, latitude=0.0)]))
    assert quality.gate(frame([good(1), good(1)])) == ["Duplicate IDs: 1"]


def test_empty_table_gives_zeros(spark):
    got = report(spark, [])
    assert got["duplicate_ids"]["value"] == 0 and got["no_junction"]["pct"] == 0.0


def test_out_of_order_rows_of_one_hot_parent(spark):
    rows = [(1, dt.date(2024, 1, 1 + i % 5)) for i in range(500)] + [(2, dt.date(2024, 1, 1)), (9, dt.date(2023, 1, 1))]
    lines = spark.createDataFrame(rows, "k long, shipped date")
    parents = spark.createDataFrame([(1, dt.date(2024, 1, 3)), (2, dt.date(2024, 1, 1))], "p long, ordered date")
    got = quality.count_out_of_order(lines, "k", "shipped", parents, "p", "ordered").first()
    assert got["bad_rows"] == 200
