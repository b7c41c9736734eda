"""Enforcement queues: weighted composite score, tier and recommended action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbsight.functions import columns as C, fixed
from kerbsight.operators.ranking import global_row_number
from kerbsight.session import Workspace

QUEUE_COLUMNS = [
    "cell_id",
    "priority_score",
    "priority_tier",
    "recommended_action",
    "violation_count",
    "severity_mean",
    "recurrence_score",
    "is_hotspot",
    "hotspot_rank",
    "congestion_score",
    "police_station",
    "top_violation",
    "top_vehicle",
    "lat",
    "lng",
    "contributing_factors",
]


def best_first(key: str) -> list[Column]:
    """Queue order. Scores that differ by less than 1e-9 are equal: their last bits are rounding
    noise of the logarithms and must not decide the order; the key does."""
    return [F.desc(F.round("priority_score", 9)), F.col(key)]


def _extremes(df: DataFrame, **columns: Column) -> Column:
    """Minimum and maximum of several columns as one scalar struct (a one-row subquery)."""
    bounds = [
        F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(name)
        for name, c in columns.items()
    ]
    return df.agg(F.struct(*bounds).alias("e")).scalar()


def _scaled(value: Column, name: str) -> Column:
    return C.unit_range(value, F.col(f"_e.{name}.low"), F.col(f"_e.{name}.high"))


def _scored(df: DataFrame, first: Column | None, first_name: str) -> DataFrame:
    """`priority_score`, tier, action and the four factors of the score."""
    log_count = F.log1p("violation_count")
    severity = F.coalesce(F.col("severity_mean"), F.lit(0.0))
    ranged = df.withColumn("_e", _extremes(df, count=log_count, severity=severity))
    volume = _scaled(log_count, "count")
    factors = ranged.withColumns(
        {
            "_first": volume if first is None else F.coalesce(first, F.lit(0.0)),
            "_volume": volume,
            "_recurrence": C.clip01(F.coalesce(F.col("recurrence_score"), F.lit(0.0))),
            "_severity": _scaled(severity, "severity"),
        }
    ).withColumn(
        "_blend",
        fixed.W_HOTSPOT * F.col("_first")
        + fixed.W_VIOLATION * F.col("_volume")
        + fixed.W_RECURRENCE * F.col("_recurrence")
        + fixed.W_SEVERITY * F.col("_severity"),
    )
    final = factors.withColumn("_e", _extremes(factors, blend=F.col("_blend")))
    named = {
        first_name: "_first",
        "violation_intensity": "_volume",
        "recurrence": "_recurrence",
        "severity": "_severity",
    }
    return final.withColumn("priority_score", _scaled(F.col("_blend"), "blend")).select(
        *df.columns,
        "priority_score",
        C.tier(F.col("priority_score")).alias("priority_tier"),
        C.action(F.col("priority_score")).alias("recommended_action"),
        F.create_map(
            *[c for name, col in named.items() for c in (F.lit(name), C.round_printf(F.col(col), 3))]
        ).alias("contributing_factors"),
    )


def priority_queue(cells: DataFrame, top_n: int | None = None) -> DataFrame:
    """Cell queue, highest score first; `top_n` is a bounded top-k, not a full sort."""
    scored = _scored(cells, F.col("hotspot_density"), "hotspot_density")
    present = [c for c in QUEUE_COLUMNS if c in scored.columns]
    queue = scored.select(*present).orderBy(*best_first("cell_id"))
    return queue if top_n is None else queue.limit(top_n)


def station_priority(stations: DataFrame) -> DataFrame:
    """Station queue; without a congestion score the scaled log-count takes its place."""
    first = F.col("congestion_score") if "congestion_score" in stations.columns else None
    scored = _scored(stations, first, "congestion").drop("contributing_factors")
    return scored.orderBy(*best_first("police_station"))


def queue_positions(ws: Workspace, queue: DataFrame) -> DataFrame:
    """Queue with each row's place in it, from 1."""
    return global_row_number(ws, queue, best_first("cell_id"), "position")


def tier_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("priority_tier").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "priority_tier")
