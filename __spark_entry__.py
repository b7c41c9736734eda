
from __future__ import annotations

import datetime as dt
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbsight.functions import columns as C
from kerbsight.functions.hexgrid import CITY, STREET, add_hex_cells
from kerbsight.operators import (
    cleaning,
    congestion,
    daily,
    features,
    heatmap,
    hotspots,
    lookups,
    priority,
    quality,
)
from kerbsight.plans.batch import CityTables, write_tables
from kerbsight.session import Workspace
from kerbsight.sources import files
from kerbsight.sources.events import read_violations
from kerbsight.streaming import rates
from oracles.sql import DATE_FROM, DATE_TO, DRIFT_DATE, ORACLES

GBT_ROUNDS = 200
MIN_R2 = 0.95
FEED_FILES = 6
FEED_ROW_GROUP = 2 << 20  # bytes
FEED_LATENESS = "400 days"  # the feed's files may come in any order
JUNCTION_TEXT = "junction 3"
JUNCTION_NAME = "Junction 2"

_tables: dict[tuple[str, str, str], CityTables] = {}


def tables(spark: SparkSession, sf_dir: str, method: str = "ols") -> CityTables:
    """Tables of one input folder; queries of one application share the written ones."""
    key = (spark.sparkContext.applicationId, sf_dir, method)
    if key not in _tables or (_tables[key].ws.used() and not _tables[key].ws.exists()):
        if method == "ols":
            # The records are row-local expressions over the events, computed where they are scanned.
            found = CityTables(spark, read_violations(spark, sf_dir), method=method, ws=Workspace(spark))
        else:
            # Everything before the model is the same for both methods.
            base = tables(spark, sf_dir)
            found = CityTables(spark, base.violations, method=method, rounds=GBT_ROUNDS, ws=base.ws)
            found.rollup, found.cells, found.hotspots = base.rollup, base.cells, base.hotspots
        _tables[key] = found
    return _tables[key]


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).violations


def or_default(df: DataFrame, **defaults) -> DataFrame:
    """Replace nulls of integer and boolean columns, which engines hand over in different types."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def tidy(df: DataFrame) -> DataFrame:
    """Integers as bigint, fractions as double with 6 digits, dates as text: one form for every
    engine."""
    out = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if dtype in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif dtype in ("double", "float") or dtype.startswith("decimal"):
            c = F.round(c.cast("double"), 6)
        elif dtype == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(name))
    return df.select(*out)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- sources and sinks --------------------------------------------------------------------


def scan_csv(spark, sf):
    t = tables(spark, sf)
    path = t.ws.path("violations-csv")
    files.sink_csv(t.violations, path)
    df = cleaning.coerce_timestamps(files.scan_csv(spark, path))
    return df.select(
        "id", "latitude", "longitude", "violation_type", "offence_code", "created_datetime",
        "closed_datetime", "police_station", "junction_name", "vehicle_type", "vehicle_number",
    )


_SCANNED = [
    "id", "latitude", "longitude", "violation_type", "offence_code", "created_datetime",
    "closed_datetime", "police_station", "junction_name", "vehicle_type", "vehicle_number",
]


def scan_csv_mixed_headers(spark, sf):
    """All records in two sets of files whose headers name the columns in opposite orders."""
    t = tables(spark, sf)
    path = t.ws.path("mixed-csv")
    rows = t.violations.select(*_SCANNED)
    odd = F.col("id").cast("bigint") % 2 == 1
    files.sink_csv(rows.where(odd), f"{path}/odd")
    files.sink_csv(rows.where(~odd).select(*reversed(_SCANNED)), f"{path}/even")
    return cleaning.coerce_timestamps(files.scan_csv(spark, f"{path}/*")).select(*_SCANNED)


def scan_csv_multiline(spark, sf):
    """Line feeds, quotes and commas within fields of every event."""
    ws = tables(spark, sf).ws
    path = ws.path("multiline-csv")
    text = F.concat(F.lit('a "'), F.col("event_type"), F.lit('",\n'), F.col("user_id").cast("string"), F.lit("\n"))
    rows = _table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), text.alias("junction_name")
    )
    files.sink_csv(rows, path)
    return files.scan_csv(spark, path).select("id", "junction_name")


def parse_dirty_json(spark, sf):
    """Every event with one of eight texts, as violation list and as offence list."""
    kinds = ['["A"] x', '["A","B"]', "[99999999999]", '[112,"x"]', '["112"]', "99999999999", "1.5", '"A" "B"']
    text = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 8 + 1).cast("int"))
    rows = _table(spark, sf, "events").select(F.col("event_id").alias("id"), text.alias("t"))
    codes = C.offence_list(F.col("t"))
    total = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return rows.select(
        "id", F.array_join(C.violation_list(F.col("t")), "|").alias("names"),
        F.size(codes).alias("n"), total.alias("code_sum"),
    )


def coerce_zoned_timestamps(spark, sf):
    """Every event's time with one of six zones; the fourth is ambiguous."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    zones = [" Asia/Kolkata", "Z", "-03:00", " IST", " GMT", ""]
    zone = F.element_at(F.array(*map(F.lit, zones)), (F.col("event_id") % 6 + 1).cast("int"))
    raw = _table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.concat(text, zone).alias("created_datetime")
    )
    return cleaning.coerce_timestamps(raw)


def sink_parquet_roundtrip(spark, sf):
    t = tables(spark, sf)
    path = t.ws.path("cleaned")
    columns = ["id", "primary_violation", "cell_street", "cell_city", "hour_ist", "date_ist"]
    files.sink_parquet(t.facts.select(*columns), path, ["date_ist"])
    return or_default(files.scan_parquet(spark, path).select(*columns), hour_ist=-1)


def sink_csv_roundtrip(spark, sf):
    t = tables(spark, sf)
    path = t.ws.path("queue-csv")
    files.sink_csv(t.queue, path)
    schema = t.queue.drop("contributing_factors").schema
    return files.scan_csv(spark, path, schema).select(
        "cell_id", "priority_score", "priority_tier", "recommended_action", "violation_count",
        "is_hotspot", "hotspot_rank", "police_station", "top_violation", "lat", "lng",
    )


def scan_geojson(spark, sf):
    t = tables(spark, sf)
    path = t.ws.path("geojson")
    files.sink_geojson(heatmap.geojson_features(t.heatmap(7), CITY), path)
    return files.scan_geojson(spark, path).select("feature.properties.*")


# -- cleaning -----------------------------------------------------------------------------


def parse_violation_types(spark, sf):
    df = cleaning.parse_json_columns(violations(spark, sf))
    values = F.col("violation_type_list")
    return df.select("id", F.size(values).alias("n"), F.array_join(values, "|").alias("names"))


def primary_violation(spark, sf):
    return cleaning.parse_json_columns(violations(spark, sf)).select("id", "primary_violation")


def parse_offence_codes(spark, sf):
    df = cleaning.parse_json_columns(violations(spark, sf))
    codes = F.col("offence_code_list")
    total = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return df.select("id", F.size(codes).alias("n"), total.alias("code_sum"))


def coerce_timestamps(spark, sf):
    """Texts with and without a zone, and garbage, made from the event times."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    kind = F.col("event_id") % 4
    dirty = (
        F.when(kind == 0, text)
        .when(kind == 1, F.concat(text, F.lit("+05:30")))
        .when(kind == 2, F.lit("garbage"))
        .otherwise(F.concat(text, F.lit("Z")))
    )
    raw = _table(spark, sf, "events").select(
        F.col("event_id").alias("id"), dirty.alias("created_datetime")
    )
    return cleaning.coerce_timestamps(raw)


def time_features(spark, sf):
    df = cleaning.add_time_features(cleaning.coerce_timestamps(violations(spark, sf)))
    df = df.select("id", "hour_ist", "day_of_week", "month", "date_ist")
    return or_default(df, hour_ist=-1, day_of_week=-1, month=-1)


def clean_junction(spark, sf):
    return cleaning.clean_junctions(violations(spark, sf)).select("id", "junction_name")


def severity(spark, sf):
    df = cleaning.add_severity(cleaning.parse_json_columns(violations(spark, sf)))
    return df.select("id", "primary_violation", "severity")


def minmax_normalize(spark, sf):
    cells = tables(spark, sf).cells
    extremes = cells.agg(
        F.struct(F.min("violation_count").alias("low"), F.max("violation_count").alias("high")).alias("e")
    ).scalar()
    scaled = C.unit_range(F.col("violation_count"), F.col("e.low"), F.col("e.high"))
    return cells.withColumn("e", extremes).select("cell_id", scaled.alias("scaled"))


def tier_case(spark, sf):
    scored = tables(spark, sf).scored
    score = F.col("congestion_score")
    return scored.select("cell_id", C.tier(score).alias("tier"), C.action(score).alias("action"))


# -- quality ------------------------------------------------------------------------------


def dq_duplicate_ids(spark, sf):
    return quality.count_duplicates(violations(spark, sf), ["id"])


def dq_duplicate_lineitem_keys(spark, sf):
    return quality.count_duplicates(_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def dq_geo_outliers(spark, sf):
    found = quality.geo_outliers(F.col("latitude"), F.col("longitude"))
    return violations(spark, sf).agg(found.alias("geo_outliers"))


def dq_closed_before_created(spark, sf):
    found = quality.closed_before_created(F.col("created_datetime"), F.col("closed_datetime"))
    return violations(spark, sf).agg(found.alias("bad_rows"))


def dq_shipped_before_ordered(spark, sf):
    lines, orders = _table(spark, sf, "lineitem"), _table(spark, sf, "orders")
    return quality.count_out_of_order(
        lines, "l_orderkey", "l_shipdate", orders, "o_orderkey", "o_orderdate"
    )


def dq_report(spark, sf):
    return quality.report(violations(spark, sf))


# -- cells and heatmaps -------------------------------------------------------------------


def hex_bin(spark, sf):
    return add_hex_cells(violations(spark, sf)).select("id", "cell_street", "cell_city")


def _street_cells(spark, sf):
    located = add_hex_cells(violations(spark, sf)).where("street_q IS NOT NULL")
    return located.groupBy("cell_street", "street_q", "street_r").agg(F.count("*").alias("n"))


def hex_centroid(spark, sf):
    lat, lng = STREET.centroid(F.col("street_q"), F.col("street_r"))
    return _street_cells(spark, sf).select(
        F.col("cell_street").alias("cell_id"), lat.alias("lat"), lng.alias("lng")
    )


def hex_boundary(spark, sf):
    ring = STREET.boundary(F.col("street_q"), F.col("street_r"))
    corners = _street_cells(spark, sf).select(
        F.col("cell_street").alias("cell_id"), F.posexplode(ring).alias("corner", "point")
    )
    return corners.select(
        "cell_id", "corner", F.get("point", F.lit(0)).alias("lng"), F.get("point", F.lit(1)).alias("lat")
    )


def _heatmap(resolution, start=None, end=None):
    def query(spark, sf):
        return tables(spark, sf).heatmap(resolution, start, end).drop("hq", "hr")

    return query


def heatmap_metadata(spark, sf):
    found = tables(spark, sf).heatmap(9, DATE_FROM, DATE_TO)
    return heatmap.collection_metadata(
        heatmap.geojson_features(found, STREET), 9, DATE_FROM, DATE_TO
    )


def geojson_features(spark, sf):
    street = tables(spark, sf).heatmap(9)
    found = heatmap.geojson_features(street, STREET)
    ring = F.col("feature.geometry.coordinates").getItem(0)
    return found.select(
        F.col("feature.type").alias("type"),
        F.col("feature.geometry.type").alias("geometry_type"),
        F.size(ring).alias("corners"),
        (F.get(ring, F.lit(0)) == F.get(ring, F.lit(6))).alias("closed"),
        "feature.properties.*",
    )


def density_bands(spark, sf):
    return or_default(heatmap.density_bands(tables(spark, sf).heatmap(9)), band_high=-1)


# -- features -----------------------------------------------------------------------------


def cell_features(spark, sf):
    return tables(spark, sf).cells.drop("hq", "hr")


def station_features(spark, sf):
    return tables(spark, sf).stations


def temporal_profile(spark, sf):
    return tables(spark, sf).temporal_profile


def recurrence_cell(spark, sf):
    found = features.recurrence(tables(spark, sf).facts, ["cell_street"])
    return found.withColumnRenamed("cell_street", "cell_id")


def recurrence_station(spark, sf):
    return features.recurrence(tables(spark, sf).facts, ["police_station"])


def _states(spark, sf) -> daily.DailyStates:
    """The daily states of all facts, made in two updates: the days before the drift date, then the rest."""
    t = tables(spark, sf)
    if not hasattr(t, "states"):
        t.states = daily.DailyStates(spark, t.ws.path("states"))
        dates = [r[0] for r in t.facts.select("date_ist").distinct().collect()]
        early = [d for d in dates if d is not None and d.isoformat() < DRIFT_DATE]
        t.states.update(t.facts, early)
        t.states.update(t.facts, [d for d in dates if d not in early])
    return t.states


def cell_features_by_day(spark, sf):
    states = _states(spark, sf)
    return features.cell_features(states.visits(), states.rollup()).drop("hq", "hr")


def station_features_by_day(spark, sf):
    states = _states(spark, sf)
    return features.station_features(states.visits(), states.rollup())


def heatmap_date_range_by_day(spark, sf):
    """The states of the range's dates only."""
    start, end = (dt.date.fromisoformat(x) for x in (DATE_FROM, DATE_TO))
    return heatmap.heatmap(_states(spark, sf).rollup(start, end), STREET).drop("hq", "hr", "avg_hour")


def station_vehicles_sketch(spark, sf):
    """Exact distinct vehicles per station, and whether the sketches' estimate lies within its bound."""
    found = daily.unique_vehicles(_states(spark, sf).table("sketches"), ["police_station"])
    exact = features.recurrence(tables(spark, sf).facts, ["police_station"])
    error = F.abs(F.col("unique_vehicles") - F.col("estimate"))
    joined = exact.join(found.withColumnRenamed("unique_vehicles", "estimate"), "police_station")
    within = error <= F.greatest(F.lit(1), daily.HLL_BOUND * F.col("unique_vehicles"))
    return joined.select("police_station", "unique_vehicles", within.alias("within_bound"))


def closing_minutes_sketch(spark, sf):
    """Closed violations per station, and whether the share of them up to the estimated 90th percentile is 0.9 within the bound."""
    states, p = _states(spark, sf).table("sketches"), 0.9
    found = daily.minutes_quantile(states, ["police_station"], p).withColumnRenamed("minutes", "cut")
    rows = tables(spark, sf).facts.select("police_station", daily.closing_minutes().alias("m"))
    ranks = rows.where("m IS NOT NULL AND police_station IS NOT NULL").join(found, "police_station").groupBy("police_station").agg(
        F.count("*").alias("n"), F.avg((F.col("m") < F.col("cut")).cast("int")).alias("low"),
        F.avg((F.col("m") <= F.col("cut")).cast("int")).alias("high"),
    )
    within = (F.col("low") <= p + daily.RANK_BOUND) & (F.col("high") >= p - daily.RANK_BOUND)
    return ranks.select("police_station", "n", within.alias("within_bound"))


def vehicle_drift_daily(spark, sf):
    """Distinct vehicles per cell and day, each day from the drift date on against the days before it."""
    seen = _states(spark, sf).table("visits").where("street_q IS NOT NULL AND date_ist IS NOT NULL")
    each = seen.groupBy("street_q", "street_r", "date_ist").agg(F.count_distinct("vehicle_number").alias("score"))
    late = F.col("date_ist") >= F.lit(DRIFT_DATE).cast("date")
    return daily.daily_drift(each.where(~late), each.where(late).withColumnRenamed("date_ist", "date"))


# -- hotspots and congestion --------------------------------------------------------------


def hot_cells(spark, sf):
    return hotspots.hot_cells(tables(spark, sf).cells).select("cell_id", "violation_count")


def eps_neighbours(spark, sf):
    hot = hotspots.hot_cells(tables(spark, sf).cells)
    points = hot.select(F.col("cell_id").alias("id"), "hq", "hr", "lat", "lng")
    return hotspots.eps_neighbours(points, STREET, hotspots.HotspotParams().eps_deg)


def dbscan_clusters(spark, sf):
    return tables(spark, sf).hotspots.select("cell_id", "cluster_id", "is_hotspot")


def hotspot_rank(spark, sf):
    return tables(spark, sf).hotspots.select("cell_id", "cluster_id", "hotspot_rank")


def hotspot_density(spark, sf):
    return tables(spark, sf).hotspots.select("cell_id", "cluster_id", "hotspot_density")


def hotspot_summary(spark, sf):
    return tables(spark, sf).hotspot_summary


def train_test_split(spark, sf):
    return congestion.train_test_split(tables(spark, sf).cells).select("cell_id", "is_test")


def congestion_gbt(spark, sf):
    scored = tables(spark, sf, "gbt").scored
    return scored.select("cell_id", "congestion_raw", "congestion_score")


def feature_importance(spark, sf):
    """Importance per feature, one row each (the model has seven features)."""
    model = tables(spark, sf, "gbt").model
    pairs = [F.struct(F.lit(k).alias("feature"), F.lit(v).alias("pct")) for k, v in model.importance.items()]
    return model.metrics.select(F.inline(F.array(*pairs)), "mae", "r2")


def congestion_gbt_cells(spark, sf):
    """Every cell has one score of the boosted model, between 0 and 1."""
    scored = tables(spark, sf, "gbt").scored
    return scored.select("cell_id", F.col("congestion_score").between(0, 1).alias("in_range"))


def congestion_gbt_model(spark, sf):
    """What must hold for the boosted model on any input: one row."""
    t = tables(spark, sf, "gbt")
    shares = list(t.model.importance.values())
    score = F.col("congestion_score")
    fit = t.model.metrics.agg(F.max("r2")).scalar()
    return t.scored.agg(F.min(score).alias("low"), F.max(score).alias("high")).select(
        "low",
        "high",
        (fit > MIN_R2).alias("fits_held_out_cells"),
        F.lit(len(shares)).alias("features"),
        F.lit(all(0 <= x <= 100 for x in shares) and abs(sum(shares) - 100) <= 0.5).alias("shares_sum_to_100"),
    )


def congestion_gbt_nodes(spark, sf):
    """Descent in the table of the model's nodes gives every cell the model's own prediction."""
    t = tables(spark, sf, "gbt")
    nodes = congestion.node_table(t.ws, t.model)
    own = t.scored.withColumnRenamed("congestion_raw", "_own")
    same = F.abs(F.col("congestion_raw") - F.col("_own")) <= 1e-9
    return congestion.score_nodes(own, nodes).select("cell_id", same.alias("as_the_model"))


def priority_queue_gbt(spark, sf):
    """The queue of the product path, without the model's own figures."""
    return _flat_queue(tables(spark, sf, "gbt").queue).drop("congestion_score")


def regression_metrics(spark, sf):
    return tables(spark, sf).model.metrics


def congestion_score(spark, sf):
    return tables(spark, sf).scored.select("cell_id", "congestion_raw", "congestion_score")


def station_congestion(spark, sf):
    return tables(spark, sf).scored_stations.select(
        "police_station", "congestion_score_mean", "congestion_score_max", "congestion_score_p90",
        "hotspot_cells", "total_cells", "congestion_score",
    )


# -- queues -------------------------------------------------------------------------------


def _flat_queue(queue):
    factors = ["hotspot_density", "violation_intensity", "recurrence", "severity"]
    return queue.select(
        "cell_id", "priority_score", "priority_tier", "recommended_action", "violation_count",
        "severity_mean", "recurrence_score", "is_hotspot", "hotspot_rank", "congestion_score",
        "police_station", "top_violation", "top_vehicle", "lat", "lng",
        *[F.col("contributing_factors")[f].alias(f"factor_{f}") for f in factors],
    )


def priority_queue(spark, sf):
    return _flat_queue(tables(spark, sf).queue)


def priority_top50(spark, sf):
    return _flat_queue(priority.priority_queue(tables(spark, sf).scored, 50))


def station_priority(spark, sf):
    return tables(spark, sf).station_queue.select(
        "police_station", "violation_count", "congestion_score", "priority_score",
        "priority_tier", "recommended_action",
    )


def station_priority_by_count(spark, sf):
    """The fallback without congestion scores."""
    return priority.station_priority(tables(spark, sf).stations).select(
        "police_station", "priority_score", "priority_tier"
    )


def tier_counts(spark, sf):
    return priority.tier_counts(tables(spark, sf).queue)


def queue_positions(spark, sf):
    t = tables(spark, sf)
    queue = t.queue.select("cell_id", "priority_score")
    return priority.queue_positions(t.ws, queue)


def queue_filtered(spark, sf):
    found = lookups.enforcement_queue(tables(spark, sf).queue, 100, "moderate", "STATION 0")
    found = found.select("cell_id", "priority_score", "priority_tier", "police_station", "hotspot_rank")
    return or_default(found, hotspot_rank=0)


# -- look-ups -----------------------------------------------------------------------------


def station_scorecard(spark, sf):
    return lookups.station_scorecard(tables(spark, sf).scored_stations)


def station_lookup(spark, sf):
    return lookups.station_scorecard(tables(spark, sf).scored_stations, "sTaTiOn 3")


def _sentences(cards):
    return cards.select(
        "name", F.posexplode("contributing_factors").alias("position", "sentence")
    )


def station_factors(spark, sf):
    return _sentences(lookups.station_factors(station_scorecard(spark, sf)))


def junction_scorecard(spark, sf):
    t = tables(spark, sf)
    return lookups.junction_scorecard(t.junction_rows, t.scored)


def junction_lookup(spark, sf):
    t = tables(spark, sf)
    return lookups.junction_lookup(t.junction_rows, t.scored, JUNCTION_TEXT)


def junction_search(spark, sf):
    return lookups.matching_junctions(tables(spark, sf).junction_rows, "JUNCTION")


def junction_factors(spark, sf):
    return _sentences(lookups.junction_factors(junction_scorecard(spark, sf)))


def junction_cells_semi(spark, sf):
    t = tables(spark, sf)
    found = lookups.junction_cells(t.junction_rows, t.scored, JUNCTION_NAME)
    return found.select("cell_id", "violation_count")


def _rules(t: CityTables) -> DataFrame:
    """One rule per cell: the count before the drift date, doubled; city cells are unknown ids."""
    early = t.facts.where(F.col("date_ist") < F.lit(DRIFT_DATE).cast("date"))
    known = early.groupBy(F.col("cell_street").alias("cell_id")).agg(
        (F.count("*") * 2).alias("threshold")
    )
    unknown = early.groupBy(F.col("cell_city").alias("cell_id")).agg(
        F.count("*").alias("threshold")
    )
    return known.unionByName(unknown).where("cell_id IS NOT NULL")


def threshold_alerts(spark, sf):
    t = tables(spark, sf)
    alerts = lookups.threshold_alerts(_rules(t), t.cells)
    return or_default(alerts, alert_triggered=False, current_count=-1)


def dashboard_stats(spark, sf):
    return lookups.dashboard_stats(tables(spark, sf).queue)


def station_risk_panel(spark, sf):
    t = tables(spark, sf)
    cards = station_scorecard(spark, sf)
    return lookups.risk_panel(cards).join(lookups.score_ranks(t.ws, cards), "name", "left")


def stored(spark: SparkSession, sf_dir: str) -> CityTables:
    """The tables of one input folder as a run has written them, written once per application."""
    t = tables(spark, sf_dir)
    if not hasattr(t, "published"):
        t.published = t.ws.path("published")
        files.sink_parquet(t.facts, f"{t.published}/cleaned_violations", ["date_ist"])
        write_tables(t, t.published)
    return CityTables.open(spark, t.published, method="ols", ws=t.ws)


def station_scorecard_stored(spark, sf):
    return lookups.station_scorecard(stored(spark, sf).scored_stations)


def heatmap_stored(spark, sf):
    return stored(spark, sf).heatmap(9)


def heatmap_date_range_stored(spark, sf):
    return stored(spark, sf).heatmap(9, DATE_FROM, DATE_TO).drop("hq", "hr")


def city_totals(spark, sf):
    return tables(spark, sf).totals()


# -- streaming ----------------------------------------------------------------------------


def sliding_rate(spark, sf):
    return rates.sliding_rate(tables(spark, sf).facts)


def running_peak_hour(spark, sf):
    return rates.running_peak_hour(rates.hourly_counts(tables(spark, sf).facts))


def cell_count_24h(spark, sf):
    return rates.cell_count_24h(tables(spark, sf).facts)


def _alert_rules(t: CityTables) -> DataFrame:
    """Alert when an hour has more than twice the cell's mean of the 30 days."""
    return t.cells.select(
        "cell_id", F.floor(F.col("violation_count") * 2 / 720).alias("threshold")
    )


def hourly_alerts(spark, sf):
    t = tables(spark, sf)
    return rates.hourly_alerts(t.facts, _alert_rules(t))


def _event_stream(spark, sf) -> DataFrame:
    """The events table as a stream of enriched facts."""
    from kerbsight.sources.events import violations_from_events

    schema = _table(spark, sf, "events").schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", rates.FILES_PER_BATCH)
        .parquet(sf)
    )
    return cleaning.enrich(violations_from_events(spark, stream))


def stream_sliding_rate(spark, sf):
    run = rates.run_buckets(tables(spark, sf).ws, _event_stream(spark, sf), "police_station", 5)
    return rates.stream_sliding_rate(run)


def stream_cell_count_24h(spark, sf):
    run = rates.run_buckets(tables(spark, sf).ws, _event_stream(spark, sf), "cell_street", 60)
    return rates.stream_cell_count_24h(run)


def stream_alerts(spark, sf):
    t = tables(spark, sf)
    run = rates.run_buckets(t.ws, _event_stream(spark, sf), "cell_street", 60)
    return rates.stream_alerts(run, _alert_rules(t))


def _timed_feed(spark, sf) -> DataFrame:
    """All events in files of an id range each, as a stream of one file per micro-batch. The files may come in any order."""
    from kerbsight.sources.events import violations_from_events

    t = tables(spark, sf)
    if not hasattr(t, "feed"):
        t.feed = t.ws.path("feed")
        ranges = _table(spark, sf, "events").repartitionByRange(FEED_FILES, "event_id")
        # a file is a micro-batch: row groups of a few megabytes let many tasks read it
        ranges.write.option("parquet.block.size", FEED_ROW_GROUP).parquet(t.feed)
    events = spark.readStream.schema(_table(spark, sf, "events").schema).option("maxFilesPerTrigger", 1).parquet(t.feed)
    return cleaning.enrich(violations_from_events(spark, events))


def stream_alerts_live(spark, sf):
    """Alerts logged in the micro-batches that crossed the thresholds, with the counts of the stream's end."""
    t = tables(spark, sf)
    rules = t.ws.save("alert-rules", _alert_rules(t))
    return rates.crossed_windows(rates.run_alerts(t.ws, _timed_feed(spark, sf), rules, FEED_LATENESS))


def stream_rate_without_copies(spark, sf):
    """Every event comes twice."""
    feed = _timed_feed(spark, sf)
    run = rates.run_buckets(
        tables(spark, sf).ws, feed.unionByName(feed), "police_station", 5, FEED_LATENESS, ids=["id"]
    )
    return rates.stream_sliding_rate(run)


def stream_peak_hour(spark, sf):
    t = tables(spark, sf)
    path = t.ws.path("peaks")
    query = rates.write_peaks(_event_stream(spark, sf), path, t.ws.path("peaks-checkpoint"))
    query.awaitTermination()
    return rates.read_peaks(spark, path)


def score_drift(spark, sf):
    """Scores of the cells before the drift date against those after it, same model."""
    t = tables(spark, sf)
    line = t.model.model.scalar()
    bounds = t.scored.agg(
        F.struct(F.min("congestion_raw").alias("low"), F.max("congestion_raw").alias("high"))
    ).scalar()

    def scores(condition):
        seen = features.recurrence(t.facts.where(condition), ["cell_street"])
        raw = F.col("_l.intercept") + F.col("_l.slope") * F.log1p("unique_vehicles")
        scaled = C.clip01(C.unit_range(F.round(raw, 9), F.col("_b.low"), F.col("_b.high")))
        return seen.withColumns({"_l": line, "_b": bounds}).select(F.round(scaled, 6).alias("score"))

    day = F.lit(DRIFT_DATE).cast("date")
    return rates.score_drift(scores(F.col("date_ist") < day), scores(F.col("date_ist") >= day))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_csv, scan_csv_mixed_headers, scan_csv_multiline, parse_dirty_json,
        coerce_zoned_timestamps, sink_parquet_roundtrip, sink_csv_roundtrip, scan_geojson,
        parse_violation_types, primary_violation, parse_offence_codes, coerce_timestamps,
        time_features, clean_junction, severity, minmax_normalize, tier_case,
        dq_duplicate_ids, dq_duplicate_lineitem_keys, dq_geo_outliers, dq_closed_before_created,
        dq_shipped_before_ordered, dq_report,
        hex_bin, hex_centroid, hex_boundary, heatmap_metadata, geojson_features, density_bands,
        cell_features, station_features, temporal_profile, recurrence_cell, recurrence_station,
        cell_features_by_day, station_features_by_day, heatmap_date_range_by_day, station_vehicles_sketch,
        closing_minutes_sketch, vehicle_drift_daily,
        hot_cells, eps_neighbours, dbscan_clusters, hotspot_rank, hotspot_density,
        hotspot_summary, train_test_split, congestion_gbt, feature_importance,
        congestion_gbt_cells, congestion_gbt_model, congestion_gbt_nodes, priority_queue_gbt,
        regression_metrics, congestion_score, station_congestion,
        priority_queue, priority_top50, station_priority, station_priority_by_count,
        tier_counts, queue_positions, queue_filtered,
        station_scorecard, station_lookup, station_factors, junction_scorecard, junction_lookup,
        junction_search, junction_factors, junction_cells_semi, threshold_alerts,
        dashboard_stats, station_risk_panel, city_totals,
        station_scorecard_stored, heatmap_stored, heatmap_date_range_stored,
        sliding_rate, running_peak_hour, cell_count_24h, hourly_alerts,
        stream_sliding_rate, stream_cell_count_24h, stream_alerts, stream_peak_hour, score_drift,
        stream_alerts_live, stream_rate_without_copies,
    )
}
_QUERIES |= {
    "heatmap_street": _heatmap(9),
    "heatmap_city": _heatmap(7),
    "heatmap_date_range": _heatmap(9, DATE_FROM, DATE_TO),
    "heatmap_date_range_city": _heatmap(7, DATE_FROM, None),
}


def entry(spark: SparkSession) -> DataFrame:
    """The 50 street cells that most need enforcement."""
    return queries()["priority_top50"](spark, "/root/testdata/sf0.001")


def _has(module: str) -> bool:
    """Whether a module or a package (with its __init__) is there; errors within it are not hidden."""
    spec = importlib.util.find_spec(module)
    return spec is not None and spec.origin is not None


_LLM: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_LLM_SQL: dict[str, str] = {}
if _has("kerbsight.llm"):
    from kerbsight import llm

    _LLM |= llm.QUERIES
    _LLM_SQL |= llm.ORACLES
    if _has("corpus_pipeline"):
        import corpus_pipeline

        _LLM["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            _LLM_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: (lambda spark, sf_dir, f=f: tidy(f(spark, sf_dir))) for name, f in _QUERIES.items()
    } | _LLM


def oracle_sql() -> dict[str, str]:
    return ORACLES | _LLM_SQL
