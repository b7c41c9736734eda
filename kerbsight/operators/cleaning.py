"""Raw violation records → typed, cleaned, geo-enriched facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbsight.functions import columns as C, fixed
from kerbsight.functions.hexgrid import add_hex_cells
from kerbsight.schema import TIMESTAMP_COLUMNS, missing_required, with_optional_columns


def parse_json_columns(df: DataFrame) -> DataFrame:
    types = dict(df.dtypes)

    def listed(name, parse, element):
        # An array column passes through; only text needs parsing.
        if types[name].startswith("array"):
            return F.coalesce(F.col(name), F.array().cast(f"array<{element}>"))
        return parse(F.col(name).cast("string"))

    return df.withColumns(
        {
            "violation_type_list": listed("violation_type", C.violation_list, "string"),
            "offence_code_list": listed("offence_code", C.offence_list, "bigint"),
        }
    ).withColumn("primary_violation", C.first_or_unknown(F.col("violation_type_list")))


def coerce_timestamps(df: DataFrame) -> DataFrame:
    """UTC wall-clock timestamps; bad text becomes null, absent columns are skipped."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: C.utc_wall_clock(F.col(c), types[c]) for c in TIMESTAMP_COLUMNS if c in types}
    )


def add_time_features(df: DataFrame, zone: str = fixed.LOCAL_TIME_ZONE) -> DataFrame:
    """Local hour, weekday (Monday = 0), month and date of `created_datetime`."""
    local = C.local_time(F.col("created_datetime"), zone)
    return df.withColumns(
        {
            "hour_ist": F.hour(local),
            "day_of_week": F.weekday(local),
            "month": F.month(local),
            "date_ist": F.to_date(local),
        }
    )


def clean_junctions(df: DataFrame) -> DataFrame:
    name = F.coalesce(F.col("junction_name"), F.lit(fixed.NO_JUNCTION))
    return df.withColumn("junction_name", F.trim(name))


def clean(df: DataFrame) -> DataFrame:
    missing = missing_required(df)
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    df = with_optional_columns(df)
    return clean_junctions(add_time_features(coerce_timestamps(parse_json_columns(df))))


def add_severity(df: DataFrame, weights: dict[str, str] | None = None) -> DataFrame:
    return df.withColumn("severity", C.severity_weight(F.col("primary_violation"), weights))


def enrich(df: DataFrame) -> DataFrame:
    """Cleaned rows plus cell ids and severity: the fact table of all later steps.

    Row-local expressions only: no shuffle, and unused columns are pruned from the scan.
    """
    return add_severity(add_hex_cells(clean(df)))
