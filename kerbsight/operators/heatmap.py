"""Heatmaps: cells with counts, majority attributes and geometry."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from kerbsight.functions import columns as C, fixed
from kerbsight.functions.hexgrid import STREET, HexGrid, grid_for
from kerbsight.operators import features


def _keys(grid: HexGrid) -> list[str]:
    return features.STREET_KEY if grid.prefix == STREET.prefix else features.CITY_KEY


def _named(cells: DataFrame, grid: HexGrid, *columns: str) -> DataFrame:
    q, r = (F.col(k) for k in _keys(grid))
    lat, lng = grid.centroid(q, r)
    return cells.select(
        grid.cell_id(q, r).alias("cell_id"),
        *columns,
        lat.alias("lat"),
        lng.alias("lng"),
        q.alias("hq"),
        r.alias("hr"),
    )


def heatmap(counts: DataFrame, grid: HexGrid = STREET) -> DataFrame:
    """Cells with id count, majority violation and station, and mean local hour."""
    keys = _keys(grid)
    located = counts.where(F.col(keys[0]).isNotNull())
    values = features.value_counts(located, keys, station=F.col("police_station"))
    timed, hours, _ = features._hour_moments()
    cells = values.groupBy(*keys).agg(
        F.sum(F.when(features._is("violation"), F.col("n_ids"))).alias("violation_count"),
        features._mode("violation", fixed.UNKNOWN).alias("top_violation"),
        features._mode("station", fixed.UNKNOWN).alias("police_station"),
        (hours / timed).alias("avg_hour"),
    )
    return _named(cells, grid, "violation_count", "top_violation", "police_station", "avg_hour")


def _parsed(date: str | dt.date | None) -> dt.date | None:
    """Bad text raises, before any job runs."""
    return dt.date.fromisoformat(date) if isinstance(date, str) else date


def between_dates(
    facts: DataFrame, start: str | dt.date | None, end: str | dt.date | None
) -> DataFrame:
    """Rows whose local date lies within the bounds, both included, either may be open.

    On the stored facts the condition on the partition column `date_ist` prunes folders.
    """
    if start:
        facts = facts.where(F.col("date_ist") >= F.lit(_parsed(start)))
    if end:
        facts = facts.where(F.col("date_ist") <= F.lit(_parsed(end)))
    return facts


def heatmap_between(
    facts: DataFrame,
    start: str | dt.date | None,
    end: str | dt.date | None,
    resolution: int = 9,
) -> DataFrame:
    """Heatmap of a date range; `violation_count` counts rows here.

    Only four columns of the facts are read. No matching row gives an empty table.
    """
    grid = grid_for(resolution)
    keys = _keys(grid)
    found = between_dates(facts, start, end).where(F.col(keys[0]).isNotNull())
    counts = features.rollup(found, ["violation"], [*keys, "police_station"])
    values = features.value_counts(counts, keys, station=F.col("police_station"))
    cells = values.groupBy(*keys).agg(
        features._rows("violation").alias("violation_count"),
        features._mode("violation", fixed.UNKNOWN).alias("top_violation"),
        features._mode("station", fixed.UNKNOWN).alias("police_station"),
    )
    return _named(cells, grid, "violation_count", "top_violation", "police_station")


def geojson_features(cells: DataFrame, grid: HexGrid = STREET) -> DataFrame:
    """One GeoJSON Feature struct per cell; cells without an id are skipped."""
    ring = grid.boundary(F.col("hq"), F.col("hr"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias(
            "geometry"
        ),
        F.struct(
            "cell_id", "violation_count", "top_violation", "police_station", "lat", "lng"
        ).alias("properties"),
    )
    return cells.where(F.col("cell_id").isNotNull()).select(feature.alias("feature"))


def collection_metadata(
    features_df: DataFrame, resolution: int, start: str | None, end: str | None
) -> DataFrame:
    """The metadata row that accompanies a date-range heatmap."""
    return features_df.agg(F.count("*").alias("feature_count")).select(
        F.lit(resolution).alias("resolution"),
        F.lit(start).cast("string").alias("start"),
        F.lit(end).cast("string").alias("end"),
        "feature_count",
    )


def density_bands(cells: DataFrame) -> DataFrame:
    """Each cell's share of the largest count, its band, and the band's limits."""
    top = F.col("_max")
    share = F.least(F.col("violation_count") / top, F.lit(1.0))
    band = (
        F.when(share < 0.2, 0).when(share < 0.4, 1).when(share < 0.6, 2).when(share < 0.8, 3).otherwise(4)
    )
    limit = lambda i: F.floor(top * (i * 0.2) + 0.5)
    tick = lambda share: F.floor(top * share + 0.5)
    peak = cells.agg(F.max("violation_count")).scalar()
    return cells.withColumn("_max", peak).select(
        "cell_id",
        "violation_count",
        share.alias("density"),
        band.alias("band"),
        C.ladder(share, fixed.DENSITY_BANDS).alias("band_label"),
        limit(band).alias("band_low"),
        F.when(band < 4, limit(band + 1)).alias("band_high"),
        *[tick(p / 100).alias(f"tick_{p}") for p in (25, 50, 75)],
        top.alias("tick_100"),
    )
