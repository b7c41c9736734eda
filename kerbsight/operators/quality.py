"""Data-quality checks: one row of counts, turned into a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbsight.functions import columns as C, fixed
from kerbsight.schema import missing_required

GEO_ERROR_SHARE = 0.05
JUNCTION_WARNING_SHARE = 0.5
#: The column in which a scan keeps the text of rows that it couldn't read, if it does
MALFORMED = "_malformed"


class ValidationError(RuntimeError):
    pass


def count_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows minus distinct keys, null being one value.

    `groupBy` on the key combines copies map-side, so a key that holds a large share of all
    rows reaches its reducer as one partial count per task.
    """
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def geo_outliers(lat: Column, lng: Column) -> Column:
    return F.count_if(~C.inside_box(lat, lng))


def closed_before_created(created: Column, closed: Column) -> Column:
    """Comparison with a null is null and not counted."""
    return F.count_if(closed < created)


def count_out_of_order(
    rows: DataFrame, key: str, value: str, parents: DataFrame, parent_key: str, parent_value: str
) -> DataFrame:
    """Rows whose value is less than that of their parent.

    Rows are counted per (key, value) before the join, so that a parent with a large share of all
    rows sends only its distinct values through it.
    """
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    joined = counted.join(
        parents.select(parent_key, parent_value), F.col(key) == F.col(parent_key)
    )
    bad = F.sum(F.when(F.col(value) < F.col(parent_value), F.col("n")).otherwise(0))
    return joined.agg(F.coalesce(bad, F.lit(0)).alias("bad_rows"))


def _share(count: Column, rows: Column) -> Column:
    return F.when(rows > 0, count / rows).otherwise(F.lit(0.0))


def measures(df: DataFrame) -> DataFrame:
    """One row with every count the report needs.

    The plain counts need no shuffle beyond one partial row per task. Only the duplicate count
    does, and its plan reads and shuffles the id column alone.
    """
    lat, lng = F.col("latitude"), F.col("longitude")
    created = F.col("created_datetime")
    has_closed = "closed_datetime" in df.columns
    has_junction = "junction_name" in df.columns
    closed = F.col("closed_datetime") if has_closed else F.lit(None).cast("timestamp_ntz")
    junction = F.col("junction_name") if has_junction else F.lit("")
    no_junction = F.coalesce(
        F.lower(F.trim(junction)) == fixed.NO_JUNCTION.lower(), F.lit(True)
    )
    return df.agg(
        F.count("*").alias("total_rows"),
        geo_outliers(lat, lng).alias("geo_outliers"),
        F.count_if(created.isNull()).alias("created_datetime_null"),
        closed_before_created(created, closed).alias("closed_before_created"),
        F.count_if(closed.isNull()).alias("closed_datetime_null"),
        F.count_if(no_junction).alias("no_junction"),
        F.count_if(
            F.col(MALFORMED).isNotNull() if MALFORMED in df.columns else F.lit(False)
        ).alias("malformed_rows"),
    ).withColumns(
        {
            "duplicate_ids": count_duplicates(df, ["id"]).scalar(),
            "has_closed": F.lit(has_closed),
            "has_junction": F.lit(has_junction),
            "has_malformed": F.lit(MALFORMED in df.columns),
        }
    )


def report(df: DataFrame) -> DataFrame:
    """Long table `check, status, value, pct, message`, one row per check that applies.

    Rows that the scan couldn't read are counted where it has kept them (`MALFORMED`).

    The last row, `summary`, carries the number of passed checks in `value`; as in the
    published reports only duplicate ids withhold a pass, while `status` tells the truth
    about every single check.
    """
    missing = missing_required(df)
    if missing:
        return df.sparkSession.sql(
            "SELECT 'required_columns' AS check, 'error' AS status, CAST(? AS BIGINT) AS value,"
            " CAST(NULL AS DOUBLE) AS pct, ? AS message",
            args=[len(missing), f"Missing required columns: {missing}"],
        )
    m = measures(df)
    rows, n = F.col("total_rows"), F.col
    geo_share = _share(n("geo_outliers"), rows)
    junction_share = _share(n("no_junction"), rows)
    pct1 = lambda share: F.rint(share * 100 * 10) / 10
    warn = lambda count: F.when(count > 0, "warning").otherwise("ok")

    def line(check, status, value, pct, message):
        return F.struct(
            F.lit(check).alias("check"),
            status.alias("status"),
            value.cast("bigint").alias("value"),
            (F.lit(None).cast("double") if pct is None else pct).alias("pct"),
            F.when(status != "ok", message).alias("message"),
        )

    geo_status = (
        F.when(geo_share > GEO_ERROR_SHARE, "error")
        .when(n("geo_outliers") > 0, "warning")
        .otherwise("ok")
    )
    geo_text = F.when(
        geo_status == "error",
        F.format_string(fixed.TOO_MANY_OUTLIERS, n("geo_outliers"), C.round_printf(geo_share * 100, 1)),
    ).otherwise(
        F.format_string(
            fixed.SOME_OUTLIERS,
            n("geo_outliers"),
            C.round_printf(geo_share * 100, 1),
        )
    )
    junction_status = F.when(junction_share > JUNCTION_WARNING_SHARE, "warning").otherwise("ok")
    passed = (
        F.lit(2)
        + F.when(n("duplicate_ids") == 0, 1).otherwise(0)
        + n("has_closed").cast("int")
        + n("has_junction").cast("int")
    )
    failed = F.when(geo_status == "error", 1).otherwise(0)
    lines = [
        line(
            "duplicate_ids",
            warn(n("duplicate_ids")),
            n("duplicate_ids"),
            None,
            F.format_string(fixed.DUPLICATE_IDS, n("duplicate_ids")),
        ),
        line("geo_outliers", geo_status, n("geo_outliers"), pct1(geo_share), geo_text),
        line(
            "created_datetime_null",
            warn(n("created_datetime_null")),
            n("created_datetime_null"),
            None,
            F.format_string(fixed.CREATED_NULL, n("created_datetime_null")),
        ),
        line(
            "closed_before_created",
            warn(n("closed_before_created")),
            n("closed_before_created"),
            None,
            F.format_string(
                fixed.CLOSED_BEFORE_CREATED, n("closed_before_created")
            ),
        ),
        line(
            "closed_datetime_null",
            F.lit("ok"),
            n("closed_datetime_null"),
            pct1(_share(n("closed_datetime_null"), rows)),
            F.lit(None).cast("string"),
        ),
        line(
            "no_junction",
            junction_status,
            n("no_junction"),
            pct1(junction_share),
            F.format_string(
                fixed.MANY_WITHOUT_JUNCTION,
                n("no_junction"),
                pct1(junction_share),
            ),
        ),
        line(
            "malformed_rows",
            warn(n("malformed_rows")),
            n("malformed_rows"),
            None,
            F.format_string("Malformed input rows: %,d", n("malformed_rows")),
        ),
        line(
            "summary",
            F.when(failed > 0, "error").otherwise("ok"),
            passed,
            None,
            F.format_string("%d errors", failed),
        ),
    ]
    absent = F.when(~n("has_closed"), F.array(F.lit("closed_before_created"), F.lit("closed_datetime_null"))).otherwise(
        F.array().cast("array<string>")
    )
    skip = F.concat(
        absent,
        F.when(~n("has_malformed"), F.array(F.lit("malformed_rows"))).otherwise(
            F.array().cast("array<string>")
        ),
        F.when(~n("has_junction"), F.array(F.lit("no_junction"))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return (
        m.select(F.explode(F.array(*lines)).alias("l"), skip.alias("skip"))
        .where(~F.array_contains("skip", F.col("l.check")))
        .select("l.*")
    )


def gate(df: DataFrame) -> list[str]:
    """Raise on errors, return the warnings. Reads the report, at most eight rows."""
    found = report(df).where("status != 'ok' AND check != 'summary'").collect()
    errors = [r["message"] for r in found if r["status"] == "error"]
    if errors:
        raise ValidationError(f"Validation failed: {errors}")
    return [r["message"] for r in found]
