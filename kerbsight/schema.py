"""Column contracts of the tables that flow between operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Raw violation records. Date columns stay text at the scan so that one bad value
# becomes a null in `clean` instead of a malformed row.
VIOLATIONS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("violation_type", T.StringType()),
        T.StructField("offence_code", T.StringType()),
        T.StructField("created_datetime", T.StringType()),
        T.StructField("closed_datetime", T.StringType()),
        T.StructField("modified_datetime", T.StringType()),
        T.StructField("action_taken_timestamp", T.StringType()),
        T.StructField("data_sent_to_scita_timestamp", T.StringType()),
        T.StructField("validation_timestamp", T.StringType()),
        T.StructField("police_station", T.StringType()),
        T.StructField("junction_name", T.StringType()),
        T.StructField("vehicle_type", T.StringType()),
        T.StructField("vehicle_number", T.StringType()),
    ]
)

REQUIRED_COLUMNS = [
    "id",
    "latitude",
    "longitude",
    "violation_type",
    "created_datetime",
    "police_station",
]

TIMESTAMP_COLUMNS = [
    "created_datetime",
    "closed_datetime",
    "modified_datetime",
    "action_taken_timestamp",
    "data_sent_to_scita_timestamp",
    "validation_timestamp",
]

FEATURE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "geometry",
            T.StructType(
                [
                    T.StructField("type", T.StringType()),
                    T.StructField(
                        "coordinates",
                        T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))),
                    ),
                ]
            ),
        ),
        T.StructField(
            "properties",
            T.StructType(
                [
                    T.StructField("cell_id", T.StringType()),
                    T.StructField("violation_count", T.LongType()),
                    T.StructField("top_violation", T.StringType()),
                    T.StructField("police_station", T.StringType()),
                    T.StructField("lat", T.DoubleType()),
                    T.StructField("lng", T.DoubleType()),
                ]
            ),
        ),
    ]
)


def missing_required(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in df.columns]


def with_optional_columns(df: DataFrame) -> DataFrame:
    """Add absent non-required columns as typed nulls, so that operators need no probing."""
    missing = {
        f.name: F.lit(None).cast(f.dataType)
        for f in VIOLATIONS
        if f.name not in df.columns and f.name not in REQUIRED_COLUMNS
    }
    return df.withColumns(missing) if missing else df
