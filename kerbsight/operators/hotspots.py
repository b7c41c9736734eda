"""Hotspots: density clusters of busy street cells (DBSCAN on cell centroids)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from kerbsight.functions import fixed
from kerbsight.functions.hexgrid import STREET, HexGrid
from kerbsight.operators.components import connected_components
from kerbsight.operators.ranking import global_row_number, salted_lookup
from kerbsight.session import Workspace


@dataclass(frozen=True)
class HotspotParams:
    eps_deg: float = 0.004
    min_samples: int = 3  # neighbours within eps, the cell itself included
    threshold_pct: float = 25.0
    grid: HexGrid = STREET


def count_threshold(cells: DataFrame, pct: float) -> DataFrame:
    """Exact percentile of `violation_count`, one row.

    The percentile's buffer holds one entry per distinct count. d distinct counts need at
    least d(d-1)/2 violations, so d stays below 1.5 * sqrt(violations): under a million for 3e11.
    """
    histogram = cells.groupBy("violation_count").agg(F.count("*").alias("n"))
    return histogram.agg(
        F.percentile("violation_count", F.lit(pct / 100), F.col("n")).alias("threshold")
    )


def hot_cells(cells: DataFrame, pct: float = 25.0) -> DataFrame:
    return cells.where(F.col("violation_count") >= count_threshold(cells, pct).scalar())


def eps_neighbours(points: DataFrame, grid: HexGrid, eps: float) -> DataFrame:
    """Pairs of cells (a, b) whose centroids lie within eps, both directions and a = b.

    `points(id, hq, hr, lat, lng)`. In each grid row the cells in range of a cell are a run, at most `span` long. Rows
    are cut into blocks of `span` cells; each cell asks for the one or two blocks that its run touches. So
    the plan is the same for any eps, a cell asks for at most two blocks per grid row in range, and
    no block has more than `span` cells.
    """
    d_lat, d_lng = grid.steps
    limit = eps * (1 + 1e-9)
    rows = math.ceil(limit / d_lat)
    span = 2 * math.ceil(limit / d_lng) + 1
    block = lambda q: F.floor(q / span)
    across = F.sqrt(F.greatest(F.lit(limit * limit) - F.pow(F.col("dr") * d_lat, 2), F.lit(0.0))) / d_lng
    middle = F.col("hq") - F.col("dr") / 2
    asked = points.select(
        F.col("id").alias("a"),
        F.col("lat").alias("a_lat"),
        F.col("lng").alias("a_lng"),
        "hq",
        "hr",
        F.explode(F.sequence(F.lit(-rows), F.lit(rows))).alias("dr"),
    ).select(
        "a",
        "a_lat",
        "a_lng",
        (F.col("hr") + F.col("dr")).alias("hr"),
        # one cell more at each end: the exact test decides
        F.explode(F.sequence(block(F.floor(middle - across)), block(F.ceil(middle + across)))).alias("block"),
    )
    placed = points.withColumnRenamed("id", "b").withColumn("block", block(F.col("hq")))
    d_lat, d_lng = F.col("a_lat") - F.col("lat"), F.col("a_lng") - F.col("lng")
    return (
        asked.join(placed, ["hr", "block"])
        .where(d_lat * d_lat + d_lng * d_lng <= F.lit(eps) * F.lit(eps))
        .select("a", "b")
    )


def dbscan(ws: Workspace, hot: DataFrame, params: HotspotParams = HotspotParams()) -> DataFrame:
    """`(hq, hr, cluster_id)` of every hot cell; -1 is noise.

    Cells are numbered by count (descending) and coordinates. A cluster is named after its first
    core cell in that order, and a border cell joins the smallest adjacent cluster, which is what
    a sequential scan in that order does. Fewer hot cells than `min_samples` give no core cell
    and hence no cluster.
    """
    numbered = global_row_number(
        ws,
        hot.select("hq", "hr", "lat", "lng", "violation_count"),
        [F.desc("violation_count"), F.col("hq"), F.col("hr")],
        "id",
    )
    pairs = ws.save(
        "pairs",
        eps_neighbours(numbered.select("id", "hq", "hr", "lat", "lng"), params.grid, params.eps_deg),
    )
    core = (
        pairs.groupBy(F.col("a").alias("node"))
        .agg(F.count("*").alias("degree"))
        .where(F.col("degree") >= params.min_samples)
        .select("node")
    )
    # A cell occurs in at most as many pairs as cells fit within eps: these joins cannot be skewed.
    to_core = pairs.join(core.withColumnRenamed("node", "b"), "b", "left_semi")
    core_edges = ws.save(
        "core_edges",
        to_core.where("a != b").join(core.withColumnRenamed("node", "a"), "a", "left_semi"),
    )
    labels = connected_components(ws, core, core_edges)

    roots = labels.where("node = root").select("root")
    clusters = global_row_number(ws, roots, [F.col("root")], "cluster_id", start=0)
    # All core cells next to a core cell share its label, so the minimum leaves it unchanged.
    member_of = (
        to_core.join(labels.withColumnRenamed("node", "b"), "b")
        .groupBy(F.col("a").alias("id"))
        .agg(F.min("root").alias("root"))
    )
    named = salted_lookup(member_of, clusters, "root", ["id"])
    return (
        numbered.join(named, "id", "left")
        .select("hq", "hr", F.coalesce("cluster_id", F.lit(-1)).cast("bigint").alias("cluster_id"))
    )


def detect_hotspots(
    ws: Workspace, cells: DataFrame, params: HotspotParams = HotspotParams()
) -> DataFrame:
    """Cells with `cluster_id`, `is_hotspot`, `hotspot_rank` and `hotspot_density`.

    Rank 1 is the cluster with the most violations. Density is the cell's share of the largest
    count in its cluster. Cells outside a cluster get -1, false, 0 and 0.0.
    """
    labels = dbscan(ws, hot_cells(cells, params.threshold_pct), params)
    labelled = ws.save(
        "labelled",
        cells.join(labels, ["hq", "hr"], "left").withColumn(
            "cluster_id", F.coalesce("cluster_id", F.lit(-1).cast("bigint"))
        ),
    )
    totals = (
        labelled.where("cluster_id >= 0")
        .groupBy("cluster_id")
        .agg(F.sum("violation_count").alias("_total"), F.max("violation_count").alias("_top"))
    )
    ranked = global_row_number(
        ws, totals, [F.desc("_total"), F.col("cluster_id")], "hotspot_rank"
    ).drop("_total")
    return salted_lookup(labelled, ranked, "cluster_id", ["hq", "hr"]).select(
        *cells.columns,
        "cluster_id",
        (F.col("cluster_id") >= 0).alias("is_hotspot"),
        F.coalesce("hotspot_rank", F.lit(0)).cast("int").alias("hotspot_rank"),
        F.coalesce(
            F.try_divide(F.col("violation_count").cast("double"), F.col("_top").cast("double")),
            F.lit(0.0),
        ).alias("hotspot_density"),
    )


def _majority(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Most frequent value per key, smallest among equals, from pre-aggregated counts."""
    counts = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col(column).alias("v")))
    return counts.groupBy(key).agg(best.getField("v").alias(name))


def summarize_hotspots(cells: DataFrame) -> DataFrame:
    """One row per cluster, worst first."""
    members = cells.where("is_hotspot")
    summary = members.groupBy("cluster_id").agg(
        F.min("hotspot_rank").alias("rank"),
        F.sum("violation_count").alias("total_violations"),
        F.count("cell_id").alias("cell_count"),
        F.avg("lat").alias("center_lat"),
        F.avg("lng").alias("center_lng"),
        F.avg("severity_mean").alias("avg_severity"),
    )
    for column, name in (("top_violation", "top_violation"), ("police_station", "top_station")):
        summary = summary.join(_majority(members, "cluster_id", column, name), "cluster_id", "left")
    return summary.fillna(fixed.UNKNOWN, ["top_violation", "top_station"])
