"""The batch run: violation records in, feature, hotspot, score and queue tables out."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbsight.functions.hexgrid import CITY, STREET, grid_for
from kerbsight.operators import congestion, features, heatmap, hotspots, lookups, priority, quality
from kerbsight.operators.cleaning import enrich
from kerbsight.operators.hotspots import HotspotParams
from kerbsight.session import Workspace
from kerbsight.sources import files
from kerbsight.sources.published import Published


_RAW = ["violation_type", "violation_type_list", "offence_code", "offence_code_list"]


class CityTables:
    """All tables derived from one set of violation records, each built at most once.

    Tables that several others read are written to the workspace when first used; the
    rest are lazy plans over them.
    """

    def __init__(
        self,
        spark: SparkSession,
        violations: DataFrame,
        *,
        method: str = "gbt",
        rounds: int = 200,
        hotspot_params: HotspotParams = HotspotParams(),
        ws: Workspace | None = None,
    ):
        if method not in ("gbt", "ols"):
            raise ValueError(f"unknown method {method!r}")
        self.spark = spark
        self.violations = violations
        self.method = method
        self.rounds = rounds
        self.hotspot_params = hotspot_params
        self.ws = ws or Workspace(spark)
        self._facts: DataFrame | None = None
        self._fact_readers = 0

    @property
    def facts(self) -> DataFrame:
        """Cleaned and located rows without raw texts and lists, which no table is built from.

        The first reader gets the plan over the records, so that it parses only what it reads; with the second one
        the rows are written, and all later scans read the columns they use.
        """
        if self._facts is None:
            self._fact_readers += 1
            plan = enrich(self.violations).drop(*_RAW)
            if self._fact_readers < 2:
                return plan
            self._facts = self.ws.save("facts", plan)
        return self._facts

    @facts.setter
    def facts(self, written: DataFrame) -> None:
        self._facts = written

    @cached_property
    def visits(self) -> DataFrame:
        return self.ws.save("visits", features.visits(self.facts))

    @cached_property
    def rollup(self) -> DataFrame:
        return self.ws.save("rollup", features.rollup(self.facts))

    @cached_property
    def cells(self) -> DataFrame:
        return self.ws.save("cells", features.cell_features(self.visits, self.rollup))

    @cached_property
    def stations(self) -> DataFrame:
        return self.ws.save("stations", features.station_features(self.visits, self.rollup))

    @cached_property
    def temporal_profile(self) -> DataFrame:
        return features.temporal_profile(self.rollup)

    def heatmap(
        self,
        resolution: int = 9,
        start: str | dt.date | None = None,
        end: str | dt.date | None = None,
    ) -> DataFrame:
        """Heatmap at resolution 7 (city) or 9 (street), optionally for a date range."""
        grid = grid_for(resolution)
        if start or end:
            return heatmap.heatmap_between(self.facts, start, end, resolution)
        return heatmap.heatmap(self.rollup, grid)

    @cached_property
    def hotspots(self) -> DataFrame:
        found = hotspots.detect_hotspots(self.ws, self.cells, self.hotspot_params)
        return self.ws.save("hotspots", found)

    @cached_property
    def hotspot_summary(self) -> DataFrame:
        return hotspots.summarize_hotspots(self.hotspots)

    @cached_property
    def model(self) -> congestion.CongestionModel:
        if self.method == "ols":
            return congestion.train_line(self.hotspots)
        return congestion.train_gbt(self.hotspots, self.rounds)

    @cached_property
    def scored(self) -> DataFrame:
        """Cells with hotspot columns, raw prediction and congestion score."""
        predicted = self.ws.save("predicted", self.model.predict(self.hotspots))
        return self.ws.save("scored", congestion.congestion_scores(predicted))

    @cached_property
    def scored_stations(self) -> DataFrame:
        joined = congestion.station_congestion(self.ws, self.scored, self.stations)
        return self.ws.save("scored_stations", joined)

    @cached_property
    def queue(self) -> DataFrame:
        return priority.priority_queue(self.scored)

    @cached_property
    def station_queue(self) -> DataFrame:
        return priority.station_priority(self.scored_stations)

    @cached_property
    def junction_rows(self) -> DataFrame:
        return self.ws.save("junction_rows", lookups.junction_rows(self.facts))

    def totals(self) -> DataFrame:
        """One row of table-level totals."""
        cells, queue = self.scored, self.queue
        city = self.rollup.where("city_q IS NOT NULL").select("city_q", "city_r").distinct()
        tier = lambda name: F.count_if(F.col("priority_tier") == name)
        by_tier = queue.agg(
            F.struct(
                tier("IMMEDIATE").alias("immediate"),
                tier("HIGH").alias("high"),
                tier("MODERATE").alias("moderate"),
            ).alias("t")
        ).scalar()
        return cells.agg(
            F.count("*").alias("street_cells"),
            (F.coalesce(F.max("cluster_id"), F.lit(-1)) + 1).alias("hotspot_clusters"),
            F.count_if("is_hotspot").alias("hotspot_cells"),
        ).select(
            "*",
            self.rollup.where("attr = 'violation'").agg(F.sum("n_rows")).scalar().alias("total_rows"),
            city.agg(F.count("*")).scalar().alias("city_cells"),
            self.stations.agg(F.count("*")).scalar().alias("stations"),
            by_tier.getField("immediate").alias("immediate"),
            by_tier.getField("high").alias("high"),
            by_tier.getField("moderate").alias("moderate"),
        )

    def close(self) -> None:
        self.ws.close()

    @classmethod
    def open(cls, spark: SparkSession, out: str, **options) -> CityTables:
        """The tables that `run` has written below `out`, read instead of built: those of the version that is
        published now, also when another one is published later. A folder without a manifest holds the tables itself.

        A table is read when it is first used, and built from those before it if no job has
        committed it. The cleaned facts must be there.
        """
        out = Published(spark, out).current() or out
        facts = files.scan_parquet(spark, f"{out}/cleaned_violations").drop(quality.MALFORMED)
        tables = _Stored(spark, facts, **options)
        tables.out = out
        tables.facts = facts  # already enriched
        return tables


class _Stored(CityTables):
    """`CityTables` whose main tables live below `out`."""

    out: str

    def _stored(self, name: str, build) -> DataFrame:
        return files.build_if_missing(self.spark, f"{self.out}/{name}", build)

    @cached_property
    def scored(self) -> DataFrame:
        return self._stored("cell_features", lambda: CityTables.scored.func(self))

    @cached_property
    def hotspots(self) -> DataFrame:
        if files.is_written(self.spark, f"{self.out}/cell_features"):
            return self.scored.drop("congestion_raw", "congestion_score")
        return CityTables.hotspots.func(self)

    @cached_property
    def scored_stations(self) -> DataFrame:
        return self._stored("station_features", lambda: CityTables.scored_stations.func(self))

    @cached_property
    def temporal_profile(self) -> DataFrame:
        return self._stored("temporal_profiles", lambda: CityTables.temporal_profile.func(self))

    def heatmap(
        self,
        resolution: int = 9,
        start: str | dt.date | None = None,
        end: str | dt.date | None = None,
    ) -> DataFrame:
        """The stored features of the whole period; a date range is computed from the facts, of
        which it reads the folders of its dates."""
        name = f"{self.out}/heatmap_{'street' if resolution == 9 else 'city'}"
        if start or end or not files.is_written(self.spark, name):
            return super().heatmap(resolution, start, end)
        return files.scan_geojson(self.spark, name).select("feature.properties.*")


def run(
    spark: SparkSession,
    csv_path: str,
    out: str,
    *,
    method: str = "gbt",
    rounds: int = 200,
    ordered_by_date: bool = False,
    multiline: bool = True,
) -> CityTables:
    """Clean, validate and score a violations CSV and publish every output table below `out`.

    All tables are written to a folder of this run, the cleaned facts first, partitioned by local date. When the quality
    gate finds no error in them and the last table is written, the set is published in one step
    (`sources/published.py`). A run that is rejected (`ValidationError`) or dies changes nothing that readers see.

    Bringing the rows of a date together shuffles all facts once. Say `ordered_by_date` for
    input that already arrives by date: each task then writes its few dates without a shuffle.
    Quoted line feeds keep a CSV file in one task; say `multiline=False` for files that have none, which are split.
    """
    raw = files.scan_csv(spark, csv_path, multiline=multiline, malformed=quality.MALFORMED)
    published = Published(spark, out)
    place, tables = published.new(), None
    try:
        path = f"{place}/cleaned_violations"
        files.sink_parquet(enrich(raw), path, ["date_ist"], rebalance=not ordered_by_date)
        quality.gate(files.scan_parquet(spark, path))
        facts = files.scan_parquet(spark, path).drop(quality.MALFORMED)
        tables = CityTables(spark, facts, method=method, rounds=rounds)
        tables.facts = facts  # already enriched
        written = write_tables(tables, place)
        published.commit(place, ["cleaned_violations", *written])
    except BaseException:
        files.remove(spark, place)
        if tables:
            tables.close()
        raise
    published.prune()
    return tables


def write_tables(tables: CityTables, out: str) -> list[str]:
    """Write every table but the facts below `out`; their names, without the model's own folder."""
    spark = tables.spark
    files.sink_parquet(tables.temporal_profile, f"{out}/temporal_profiles")
    for name, grid in (("city", CITY), ("street", STREET)):
        cells = heatmap.heatmap(tables.rollup, grid)
        files.sink_geojson(heatmap.geojson_features(cells, grid), f"{out}/heatmap_{name}")

    files.sink_parquet(tables.scored, f"{out}/cell_features")
    files.sink_parquet(tables.scored_stations, f"{out}/station_features")
    files.sink_csv(tables.queue, f"{out}/priority_queue_csv")
    files.sink_csv(priority.priority_queue(tables.scored, 50), f"{out}/top50_priority_csv")
    files.sink_csv(tables.station_queue, f"{out}/station_priority_csv")
    files.sink_csv(tables.hotspot_summary.orderBy("rank"), f"{out}/hotspot_summary_csv")
    files.sink_csv(tables.scored_stations, f"{out}/station_features_csv")
    model = tables.model
    found = model.metrics.first()
    files.sink_model_metadata(
        spark,
        f"{out}/model_metadata",
        model.importance,
        {"mae": found["mae"], "r2": found["r2"]},
        model.feature_columns,
    )
    if tables.method == "gbt":
        model.model.write().overwrite().save(f"{out}/model")
        files.sink_parquet(congestion.node_table(tables.ws, model).coalesce(1), f"{out}/model_nodes")
    trees = ["model_nodes"] if tables.method == "gbt" else []
    return trees + [
        "temporal_profiles", "heatmap_city", "heatmap_street", "cell_features", "station_features", "priority_queue_csv",
        "top50_priority_csv", "station_priority_csv", "hotspot_summary_csv", "station_features_csv", "model_metadata",
    ]
