"""Score cards, filtered queues and alert rules as bulk tables, one row per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbsight.functions import columns as C, fixed
from kerbsight.operators.priority import best_first
from kerbsight.operators.ranking import global_row_number, salted_lookup
from kerbsight.session import Workspace


def _same_text(column: str, value: str) -> Column:
    return F.lower(F.col(column)) == F.lower(F.lit(value))


# -- stations -----------------------------------------------------------------------------


def _confidence(rows: Column, steps: tuple[float, float, int]) -> Column:
    base, share, full = steps
    return F.lit(base) + F.lit(share) * (F.least(rows, F.lit(full)) / full)


def station_scorecard(stations: DataFrame, name: str | None = None) -> DataFrame:
    """Score card of every station, or of the one with the given name in any case."""
    if name is not None:
        stations = stations.where(_same_text("police_station", name))
    n = F.col("violation_count")
    return stations.select(
        F.lit("station").alias("query_type"),
        F.col("police_station").alias("name"),
        F.col("congestion_score").alias("score"),
        "violation_count",
        "hotspot_cells",
        "total_cells",
        F.col("recurrence_score").alias("recurrence_rate"),
        F.col("severity_mean").alias("severity_index"),
        F.col("hour_peak").alias("peak_hour"),
        _confidence(n, fixed.STATION_CONFIDENCE).alias("confidence_score"),
    )


def station_factors(cards: DataFrame) -> DataFrame:
    """Score cards with their four explanatory sentences."""
    hotspots = F.when(
        F.col("hotspot_cells") > 0,
        F.format_string(fixed.STATION_HOTSPOTS, "hotspot_cells", "total_cells"),
    ).otherwise(F.format_string(fixed.STATION_NO_HOTSPOTS, "total_cells"))
    percent = C.round_printf(F.col("recurrence_rate") * 100, 1)
    return cards.withColumn(
        "contributing_factors",
        F.array(
            hotspots,
            F.format_string(fixed.STATION_RECURRENCE, percent),
            F.format_string(fixed.STATION_SEVERITY, C.round_printf(F.col("severity_index"), 2)),
            F.format_string(fixed.STATION_PEAK, "peak_hour"),
        ),
    )


# -- junctions ----------------------------------------------------------------------------


def junction_rows(facts: DataFrame) -> DataFrame:
    """Rows per (junction, street cell), all that junction look-ups need of the facts."""
    return (
        facts.where(F.col("junction_name").isNotNull())
        .groupBy("junction_name", "street_q", "street_r")
        .agg(F.count("*").alias("n_rows"))
    )


def matching_junctions(pairs: DataFrame, text: str) -> DataFrame:
    """Names that contain the text, in any case and without wildcards, with their row counts."""
    found = F.contains(F.lower(F.col("junction_name")), F.lower(F.lit(text)))
    return (
        pairs.where(found)
        .groupBy("junction_name")
        .agg(F.sum("n_rows").alias("violation_count"))
    )


def best_junction(pairs: DataFrame, text: str) -> DataFrame:
    """The most frequent matching name, the smallest among equals."""
    names = matching_junctions(pairs, text)
    return names.orderBy(F.desc("violation_count"), "junction_name").limit(1)


def junction_scorecard(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Score card of every junction from the cells it has rows in.

    Scores are averages weighted by the cells' own violation counts. The join key is the cell;
    a junction with very many cells is combined map-side after the join.
    """
    w = F.col("violation_count")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * w), F.sum(w))
    order = F.struct(w, (-F.col("hq")).alias("q"), (-F.col("hr")).alias("r"))
    top = F.max_by(F.struct("police_station", "top_violation", "hour_peak"), order)
    joined = pairs.join(
        cells, (pairs["street_q"] == cells["hq"]) & (pairs["street_r"] == cells["hr"]), "left"
    )
    grouped = joined.groupBy("junction_name").agg(
        F.sum("n_rows").alias("rows"),
        mean("congestion_score").alias("score"),
        mean("recurrence_score").alias("recurrence"),
        mean("severity_mean").alias("severity"),
        top.alias("top"),
        F.count_if("is_hotspot").alias("hotspots"),
        F.count("street_q").alias("cells"),
    )
    return grouped.select(
        F.lit("junction").alias("query_type"),
        F.col("junction_name").alias("name"),
        F.coalesce("score", F.lit(0.5)).alias("score"),
        F.col("rows").alias("violation_count"),
        F.col("hotspots").alias("hotspot_cells"),
        F.col("cells").alias("total_cells"),
        F.coalesce("recurrence", F.lit(0.0)).alias("recurrence_rate"),
        F.coalesce("severity", F.lit(0.5)).alias("severity_index"),
        F.coalesce("top.hour_peak", F.lit(fixed.DEFAULT_HOUR)).alias("peak_hour"),
        _confidence(F.col("rows"), fixed.JUNCTION_CONFIDENCE).alias("confidence_score"),
        F.coalesce("top.police_station", F.lit("Unknown")).alias("police_station"),
        F.coalesce("top.top_violation", F.lit("Unknown")).alias("top_violation"),
    )


def junction_lookup(pairs: DataFrame, cells: DataFrame, text: str) -> DataFrame:
    """Score card of the most frequent junction whose name contains the text."""
    name = best_junction(pairs, text).select("junction_name").scalar()
    return junction_scorecard(pairs.where(F.col("junction_name") == name), cells)


def junction_factors(cards: DataFrame) -> DataFrame:
    """Score cards with their five explanatory sentences."""
    percent = C.round_printf(F.col("recurrence_rate") * 100, 1)
    return cards.withColumn(
        "contributing_factors",
        F.array(
            F.format_string(fixed.JUNCTION_CONTEXT, "total_cells", "police_station"),
            F.format_string(fixed.JUNCTION_OFFENCE, "top_violation"),
            F.format_string(fixed.JUNCTION_RECURRENCE, percent),
            F.format_string(fixed.JUNCTION_SEVERITY, C.round_printf(F.col("severity_index"), 2)),
            F.format_string(fixed.JUNCTION_PROXY, C.round_printf(F.col("score"), 3)),
        ),
    )


def junction_cells(pairs: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    """Cells with at least one row of the junction."""
    wanted = pairs.where(F.col("junction_name") == name).select(
        F.col("street_q").alias("hq"), F.col("street_r").alias("hr")
    )
    return cells.join(wanted, ["hq", "hr"], "left_semi")


# -- queue, alerts, dashboard -------------------------------------------------------------


def enforcement_queue(
    queue: DataFrame, limit: int = 20, tier: str | None = None, station: str | None = None
) -> DataFrame:
    """Best `limit` (1 to 500) queue rows of a station and tier; rank is null off hotspots."""
    if not 1 <= limit <= 500:
        raise ValueError(f"limit must be between 1 and 500, got {limit}")
    if station is not None:
        queue = queue.where(_same_text("police_station", station))
    if tier is not None:
        queue = queue.where(_same_text("priority_tier", tier))
    return (
        queue.withColumn("hotspot_rank", F.when(F.col("is_hotspot"), F.col("hotspot_rank")))
        .orderBy(*best_first("cell_id"))
        .limit(limit)
    )


def threshold_alerts(rules: DataFrame, cells: DataFrame) -> DataFrame:
    """`rules(cell_id, threshold)` against the cells' counts. Unknown cells are reported.

    Many rules may watch one cell: the look-up spreads them over several tasks.
    """
    count = F.col("violation_count")
    fired = count > F.col("threshold")
    joined = salted_lookup(
        rules, cells.select("cell_id", "violation_count"), "cell_id", rules.columns
    )
    return joined.select(
        "cell_id",
        "threshold",
        F.when(count.isNull(), "not found").otherwise("success").alias("status"),
        fired.alias("alert_triggered"),
        count.alias("current_count"),
        F.when(count.isNull(), F.format_string(fixed.ALERT_NOT_FOUND, "cell_id"))
        .when(fired, F.format_string(fixed.ALERT_FIRED, count, "threshold"))
        .otherwise(F.format_string(fixed.ALERT_QUIET, count, "threshold"))
        .alias("message"),
    )


def dashboard_stats(queue: DataFrame) -> DataFrame:
    """Cells, violations, cells in the two top tiers, mean congestion (0 if empty)."""
    return queue.agg(
        F.count("*").alias("total_cells"),
        F.coalesce(F.sum("violation_count"), F.lit(0)).alias("total_violations"),
        F.count_if(F.col("priority_tier") == "IMMEDIATE").alias("immediate_cells"),
        F.count_if(F.col("priority_tier") == "HIGH").alias("high_cells"),
        F.coalesce(F.avg("congestion_score"), F.lit(0.0)).alias("avg_congestion"),
    )


def _half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def score_ranks(ws: Workspace, cards: DataFrame) -> DataFrame:
    """`name, score_rank`: 1 + the number of better scores, so equal scores share a rank."""
    numbered = global_row_number(
        ws, cards.select("name", "score"), [F.desc("score"), F.col("name")], "_pos"
    )
    first = numbered.groupBy("score").agg(F.min("_pos").alias("score_rank"))
    return salted_lookup(numbered, first, "score", ["name"]).select("name", "score_rank")


def risk_panel(cards: DataFrame) -> DataFrame:
    """Texts of the risk panel for score cards. `rank_band` is a band of the score, not a rank."""
    score = F.col("score")
    pct = _half_up(score * 100)
    coverage = F.when(
        F.col("total_cells") > 0, _half_up(F.col("hotspot_cells") / F.col("total_cells") * 100)
    ).otherwise(0)
    clock = lambda h: F.format_string("%02d:00", F.pmod(h, F.lit(24)))
    hour = F.col("peak_hour")
    return cards.select(
        "name",
        "score",
        pct.alias("score_pct"),
        C.ladder(score, fixed.RISK_LABELS).alias("risk_label"),
        C.tier(score).alias("priority_tier"),
        coverage.alias("hotspot_pct"),
        F.when(coverage == 100, fixed.COVERAGE_FULL)
        .when(coverage >= 50, fixed.COVERAGE_HALF)
        .when(coverage > 0, fixed.COVERAGE_SOME)
        .otherwise(fixed.COVERAGE_NONE)
        .alias("hotspot_text"),
        C.ladder(F.col("recurrence_rate"), fixed.RECURRENCE_TEXTS).alias("recurrence_text"),
        C.ladder(F.col("severity_index"), fixed.SEVERITY_TEXTS).alias("severity_text"),
        F.concat(clock(hour - 1), F.lit("-"), clock(hour + 1)).alias("peak_window"),
        C.ladder(pct, fixed.RANK_BANDS).alias("rank_band"),
    )
