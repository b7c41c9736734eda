"""Feature tables per cell and per station, and hour-of-day profiles.

The facts are first reduced to a rollup: counts per cell, station and value of one attribute at a
time (one shuffle with map-side combine). Cells, stations, heatmaps and profiles are all
aggregated from the rollup; only the vehicle counts go back to the facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kerbsight.functions import columns as C, fixed
from kerbsight.functions.hexgrid import STREET, HexGrid

STREET_KEY = ["street_q", "street_r"]
CITY_KEY = ["city_q", "city_r"]
PLACE_KEYS = [*STREET_KEY, *CITY_KEY, "police_station"]

# Attributes of the rollup, as text. Hours have two digits, so that text order is hour order.
ATTRIBUTES = {
    "violation": "primary_violation",
    "vehicle": "vehicle_type",
    "hour": "lpad(string(hour_ist), 2, '0')",
    "weekday": "string(day_of_week)",
}


def rollup(
    facts: DataFrame,
    attributes: Sequence[str] = tuple(ATTRIBUTES),
    keys: Sequence[str] = tuple(PLACE_KEYS),
) -> DataFrame:
    """(keys, attr, value, n_rows, n_ids): rows and non-null ids per attribute value.

    A row counts once for every attribute, with a null value if it has none. Crossing the
    attributes with each other would give a table that hardly shrinks; one at a time, its size is
    bounded by places x values, whatever the number of facts. A place that holds a large share
    of all rows is combined map-side and spread over its values. Severity is a function
    of the violation and not stored.
    """
    pairs = [F.struct(F.lit(a).alias("attr"), F.expr(ATTRIBUTES[a]).alias("value")) for a in attributes]
    return (
        facts.select(*keys, "id", F.inline(F.array(*pairs)))
        .groupBy(*keys, "attr", "value")
        .agg(F.count("*").alias("n_rows"), F.count("id").alias("n_ids"))
    )


def value_counts(counts: DataFrame, keys: list[str], **places: Column) -> DataFrame:
    """Rollup per (keys, attr, value); `places` adds attributes made from the place columns.

    Every row has one entry under `violation`, so those entries also count the places.
    """
    entry = F.struct("attr", "value")
    extra = [
        F.struct(F.lit(name).alias("attr"), place.alias("value")) for name, place in places.items()
    ]
    entries = F.when(_is("violation"), F.array(entry, *extra)).otherwise(F.array(entry))
    return (
        counts.select(*keys, "n_rows", "n_ids", F.inline(entries))
        .groupBy(*keys, "attr", "value")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_ids").alias("n_ids"))
    )


def _is(attr: str) -> Column:
    return F.col("attr") == attr


def _rows(attr: str) -> Column:
    """Number of rows, counted on an attribute that every row has (possibly as null)."""
    return F.sum(F.when(_is(attr), F.col("n_rows")))


def _mode(attr: str, default: str) -> Column:
    """Most frequent non-null value, the smallest among equals."""
    best = F.min(
        F.when(
            _is(attr) & F.col("value").isNotNull(),
            F.struct((-F.col("n_rows")).alias("k"), F.col("value").alias("v")),
        )
    )
    return F.coalesce(best.getField("v"), F.lit(default))


def _distinct(attr: str) -> Column:
    return F.count_if(_is(attr) & F.col("value").isNotNull())


def _severity_sum(attr: str = "violation") -> Column:
    weight = C.severity_weight(F.col("value"))
    return F.sum(F.when(_is(attr), weight * F.col("n_rows")))


def _hour_moments() -> tuple[Column, Column, Column]:
    """Exact Σn, Σn·h and Σn·h² of the hours, so mean and deviation have no rounding order."""
    hour = F.when(_is("hour"), F.col("value").cast("bigint"))
    n = F.when(hour.isNotNull(), F.col("n_rows"))
    return F.sum(n), F.sum(n * hour), F.sum(n * hour * hour)


def _hour_std() -> Column:
    """Sample standard deviation; 0 for fewer than two rows."""
    n, s1, s2 = (c.cast("decimal(18,0)") for c in _hour_moments())
    spread = (n * s2 - s1 * s1).cast("double")
    d = n.cast("double")
    return F.when(n > 1, F.sqrt(spread / (d * (d - 1)))).otherwise(F.lit(0.0))


def _hour_mode() -> Column:
    return _mode("hour", str(fixed.DEFAULT_HOUR)).cast("int")


def visits(facts: DataFrame) -> DataFrame:
    """Rows per vehicle, cell and station: `(street_q, street_r, police_station, vehicle_number, n)`.

    The one table at vehicle cardinality. A hot cell is spread over its vehicles, a hot vehicle over its
    cells, and both are combined map-side. All recurrences are sums over it.
    """
    known = facts.where(F.col("vehicle_number").isNotNull())
    keys = [*STREET_KEY, "police_station", "vehicle_number"]
    return known.groupBy(*keys).agg(F.count("*").alias("n"))


def recurrence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct vehicles per group and the share of them seen more than once, from facts or from
    `visits`.

    Grouping by (group, vehicle) first spreads a hot group over all tasks and replaces a
    distinct count; rows without a vehicle are left out.
    """
    present = F.col("vehicle_number").isNotNull()
    for key in keys:
        present = present & F.col(key).isNotNull()
    count = F.sum("n") if "n" in rows.columns else F.count("*")
    seen = rows.where(present).groupBy(*keys, "vehicle_number").agg(count.alias("visits"))
    return (
        seen.groupBy(*keys)
        .agg(
            F.count("*").alias("unique_vehicles"),
            F.count_if(F.col("visits") > 1).alias("repeat_vehicles"),
        )
        .withColumn("recurrence_score", F.col("repeat_vehicles") / F.col("unique_vehicles"))
    )


def _with_recurrence(groups: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    stats = recurrence(rows, keys).drop("repeat_vehicles")
    return groups.join(stats, keys, "left").fillna(
        {"unique_vehicles": 0, "recurrence_score": 0.0}
    )


def cell_features(rows: DataFrame, counts: DataFrame, grid: HexGrid = STREET) -> DataFrame:
    """One row per cell, from facts or `visits` and the rollup. `hq`, `hr` are the cell's axial coordinates."""
    keys = STREET_KEY if grid.prefix == STREET.prefix else CITY_KEY
    located = counts.where(F.col(keys[0]).isNotNull())
    values = value_counts(located, keys, station=F.col("police_station"))
    on_weekday = F.sum(F.when(_is("weekday") & (F.col("value") < "5"), F.col("n_rows")))
    n_rows = _rows("violation")
    cells = values.groupBy(*keys).agg(
        F.sum(F.when(_is("violation"), F.col("n_ids"))).alias("violation_count"),
        (_severity_sum().cast("double") / n_rows).alias("severity_mean"),
        _severity_sum().cast("double").alias("severity_sum"),
        _hour_mode().alias("hour_peak"),
        _hour_std().alias("hour_std"),
        (F.coalesce(on_weekday, F.lit(0)) / n_rows).alias("weekday_pct"),
        _distinct("vehicle").alias("vehicle_diversity"),
        _mode("violation", fixed.UNKNOWN).alias("top_violation"),
        _mode("vehicle", fixed.UNKNOWN).alias("top_vehicle"),
        _mode("station", fixed.UNKNOWN).alias("police_station"),
    )
    q, r = F.col(keys[0]), F.col(keys[1])
    lat, lng = grid.centroid(q, r)
    return _with_recurrence(cells, rows, keys).select(
        grid.cell_id(q, r).alias("cell_id"),
        "violation_count",
        "severity_mean",
        "severity_sum",
        "hour_peak",
        "hour_std",
        "weekday_pct",
        "vehicle_diversity",
        "top_violation",
        "top_vehicle",
        "police_station",
        "unique_vehicles",
        "recurrence_score",
        lat.alias("lat"),
        lng.alias("lng"),
        q.alias("hq"),
        r.alias("hr"),
    )


def station_features(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per station, from facts or `visits` and the rollup; rows without a station are left out.

    `unique_cells_*` count every cell with a row of the station, also cells where another
    station has the majority.
    """
    pair = lambda q, r: F.concat_ws(":", q, r)
    values = value_counts(
        counts.where(F.col("police_station").isNotNull()),
        ["police_station"],
        street=F.when(F.col("street_q").isNotNull(), pair("street_q", "street_r")),
        city=F.when(F.col("city_q").isNotNull(), pair("city_q", "city_r")),
    )
    stations = values.groupBy("police_station").agg(
        F.sum(F.when(_is("violation"), F.col("n_ids"))).alias("violation_count"),
        (_severity_sum().cast("double") / _rows("violation")).alias("severity_mean"),
        _severity_sum().cast("double").alias("severity_sum"),
        _hour_mode().alias("hour_peak"),
        _distinct("street").alias("unique_cells_street"),
        _distinct("city").alias("unique_cells_city"),
        _mode("violation", fixed.UNKNOWN).alias("top_violation"),
        _mode("vehicle", fixed.UNKNOWN).alias("top_vehicle"),
    )
    return _with_recurrence(stations, rows, ["police_station"])


def temporal_profile(counts: DataFrame, grid: HexGrid = STREET) -> DataFrame:
    """Share of a cell's rows per local hour, 24 columns, absent hours 0.

    Conditional sums in one aggregation instead of a pivot over a window.
    """
    keys = STREET_KEY if grid.prefix == STREET.prefix else CITY_KEY
    timed = counts.where(F.col(keys[0]).isNotNull() & _is("hour") & F.col("value").isNotNull())
    n = F.col("n_rows")
    sums = timed.groupBy(*keys).agg(
        F.sum(n).alias("_total"),
        *[
            F.sum(F.when(F.col("value") == f"{h:02d}", n).otherwise(0)).alias(f"hour_{h}")
            for h in range(24)
        ],
    )
    return sums.select(
        grid.cell_id(F.col(keys[0]), F.col(keys[1])).alias("cell_id"),
        *[(F.col(f"hour_{h}") / F.col("_total")).alias(f"hour_{h}") for h in range(24)],
    )


def most_violations_first(df: DataFrame, key: str = "cell_id") -> DataFrame:
    return df.orderBy(F.desc("violation_count"), key)
