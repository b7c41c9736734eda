import datetime as dt

import pytest

from kerbsight.operators.cleaning import clean, enrich

COLUMNS = "id string, latitude double, longitude double, violation_type string, created_datetime string, police_station string"


def raw(spark, *rows, ddl=COLUMNS):
    return spark.createDataFrame(rows, ddl)


def test_clean_fills_in_what_is_absent(spark):
    row = clean(raw(spark, ("1", 12.9, 77.6, '["NO PARKING"]', "2024-01-01 20:00:00", "S"))).first()
    assert row["primary_violation"] == "NO PARKING"
    assert (row["hour_ist"], row["day_of_week"], row["month"]) == (1, 1, 1)
    assert row["date_ist"] == dt.date(2024, 1, 2)
    assert row["junction_name"] == "No Junction"
    assert row["offence_code_list"] == [] and row["closed_datetime"] is None


def test_bad_dates_become_null(spark):
    row = clean(raw(spark, ("1", 12.9, 77.6, None, "not a date", "S"))).first()
    assert row["created_datetime"] is None and row["hour_ist"] is None and row["date_ist"] is None
    assert row["violation_type_list"] == [] and row["primary_violation"] == "UNKNOWN"


def test_junctions_are_trimmed(spark):
    ddl = COLUMNS + ", junction_name string"
    rows = [("1", 12.9, 77.6, None, None, "S", "  X "), ("2", 12.9, 77.6, None, None, "S", None)]
    got = {r["id"]: r["junction_name"] for r in clean(raw(spark, *rows, ddl=ddl)).collect()}
    assert got == {"1": "X", "2": "No Junction"}


def test_arrays_pass_through(spark):
    ddl = COLUMNS.replace("violation_type string", "violation_type array<string>")
    rows = [("1", 12.9, 77.6, ["A", "B"], None, "S"), ("2", 12.9, 77.6, None, None, "S")]
    got = {r["id"]: r["violation_type_list"] for r in clean(raw(spark, *rows, ddl=ddl)).collect()}
    assert got == {"1": ["A", "B"], "2": []}


def test_missing_required_column_is_named(spark):
    df = raw(spark, ("1", 12.9, 77.6, None, None, "S")).drop("longitude")
    with pytest.raises(ValueError, match="longitude"):
        clean(df)


def test_rows_without_coordinates_have_no_cell(spark):
    row = enrich(raw(spark, ("1", None, 77.6, None, None, "S"))).first()
    assert row["cell_street"] is None and row["cell_city"] is None
    assert float(row["severity"]) == 0.5


def test_enrich_neither_shuffles_nor_leaves_the_jvm(spark, violations):
    plan = enrich(violations)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
