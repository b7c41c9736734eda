"""States per local date that are added up when they are read, so that a new day costs only that day.

`DailyStates` keeps three tables, one folder per date: the rollup and the visits, which are sums, and sketches per cell and
station: of the vehicles (HyperLogLog) and of the minutes until a violation was closed (KLL). All four merge exactly like the
rows they stand for, over any dates, cells or stations; the sketches' estimates have the errors named below. The exact
paths stay the default everywhere.

`daily_drift` compares the scores of each day with a reference, one row per day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbsight.operators import features
from kerbsight.sources import files

DATE = "date_ist"
#: Registers of the vehicle sketch as a power of two: its standard error is 1.04 / sqrt(2^12), 1.6 %.
HLL_BITS = 12
#: Three standard errors, and one vehicle where there are few.
HLL_BOUND = 0.05
#: Of the quantile sketch with its default size: rank error 1.33 % at 99 % confidence, more than doubled.
RANK_BOUND = 0.03
_EMPTY = "__HIVE_DEFAULT_PARTITION__"


def closing_minutes() -> Column:
    return F.timestamp_diff("MINUTE", F.col("created_datetime"), F.col("closed_datetime"))


def sketches(facts: DataFrame) -> DataFrame:
    """Per cell, station and date: `vehicles` and `minutes`, null where there are no values."""
    return facts.groupBy(*features.STREET_KEY, "police_station", DATE).agg(
        F.when(F.count("vehicle_number") > 0, F.hll_sketch_agg("vehicle_number", HLL_BITS)).alias("vehicles"),
        F.when(F.count(closing_minutes()) > 0, F.kll_sketch_agg_bigint(closing_minutes())).alias("minutes"),
    )


def unique_vehicles(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Estimated distinct vehicles per group of `sketches`."""
    known = states.where(F.col("vehicles").isNotNull())
    return known.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("vehicles")).alias("unique_vehicles"))


def minutes_quantile(states: DataFrame, keys: Sequence[str], p: float) -> DataFrame:
    """Estimated quantile of the minutes until closing per group of `sketches`."""
    known = states.where(F.col("minutes").isNotNull())
    merged = known.groupBy(*keys).agg(F.kll_merge_agg_bigint("minutes").alias("s"))
    return merged.select(*keys, F.kll_sketch_get_quantile_bigint("s", F.lit(float(p))).alias("minutes"))


class DailyStates:
    """The states below `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def of_dates(facts: DataFrame, dates: Sequence[dt.date | None]) -> DataFrame:
        """The facts of some dates; None stands for rows without one. Facts partitioned by date are read by folder."""
        known = [d for d in dates if d is not None]
        wanted = F.col(DATE).isin(known) if known else F.lit(False)
        return facts.where(wanted | F.col(DATE).isNull() if None in dates else wanted)

    def update(self, facts: DataFrame, dates: Sequence[dt.date | None]) -> None:
        """Make the states of `dates` anew from their facts; those of other dates aren't touched. A date that has no rows
        any more loses its states."""
        rows = self.of_dates(facts, dates)
        built = {
            "rollup": features.rollup(rows, keys=[*features.PLACE_KEYS, DATE]),
            "visits": rows.where(F.col("vehicle_number").isNotNull())
            .groupBy(*features.STREET_KEY, "police_station", "vehicle_number", DATE)
            .agg(F.count("*").alias("n")),
            "sketches": sketches(rows),
        }
        for name, table in built.items():
            # one file per date and, for large dates, per split
            table.hint("rebalance", F.col(DATE)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                DATE
            ).parquet(f"{self.path}/{name}")
        there = {r[0] for r in rows.select(DATE).distinct().collect()}  # at most as many as `dates`
        for gone in set(dates) - there:
            for name in built:
                files.remove(self.spark, f"{self.path}/{name}/{DATE}={_EMPTY if gone is None else gone.isoformat()}")

    def table(self, name: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """The states of all dates, or from `start` to `end`."""
        found = self.spark.read.parquet(f"{self.path}/{name}")
        if start is not None:
            found = found.where(F.col(DATE) >= F.lit(start))
        return found if end is None else found.where(F.col(DATE) <= F.lit(end))

    def rollup(self, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        keys = [*features.PLACE_KEYS, "attr", "value"]
        states = self.table("rollup", start, end)
        return states.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_ids").alias("n_ids"))

    def visits(self, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        keys = [*features.STREET_KEY, "police_station", "vehicle_number"]
        return self.table("visits", start, end).groupBy(*keys).agg(F.sum("n").alias("n"))


# -- drift --------------------------------------------------------------------------------


def quantile_edges(scores: DataFrame, bins: int) -> Column:
    """Upper edges of `bins` bins that hold equal shares of the scores, without repetitions, as a scalar. Scores
    should take a bounded number of values (counts, or rounded): a task holds them with their counts."""
    cuts = [F.expr(f"percentile_disc({i / bins}) WITHIN GROUP (ORDER BY score)") for i in range(1, bins)]
    return scores.agg(F.array_distinct(F.array(*cuts)).alias("edges")).scalar()


def daily_drift(reference: DataFrame, days: DataFrame, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population-stability index of each day's scores: `reference(score)`, `days(date, score)` → `(date, n, psi)`.

    Bins are quantiles of the reference, so each holds a like share of it whatever the scores' scale. The histograms
    are additive: those of several parts of a day, or of several days, can be summed before they are compared.
    Shares below `floor` are raised to it.
    """
    edges = quantile_edges(reference.where("score IS NOT NULL"), bins)
    place = F.size(F.filter("edges", lambda x: x < F.col("score"))).alias("bin")

    def histogram(scores: DataFrame, *keys: str) -> DataFrame:
        placed = scores.where("score IS NOT NULL").withColumn("edges", edges).select(*keys, place)
        return placed.groupBy(*keys, "bin").agg(F.count("*").alias("n"))

    base = histogram(reference)
    expected = base.withColumn("q", F.greatest(F.col("n") / base.agg(F.sum("n")).scalar(), F.lit(floor))).select("bin", "q")
    counts = histogram(days, "date")
    dates = counts.groupBy("date").agg(F.sum("n").alias("total"))
    # a bin may be empty on either side; both tables have at most `bins` rows a day
    all_bins = expected.select("bin").union(counts.select("bin")).distinct()
    bins_there = all_bins.agg(F.collect_set("bin").alias("bins")).scalar()
    grid = dates.withColumn("bins", bins_there).select("date", "total", F.explode("bins").alias("bin"))
    shares = grid.join(counts, ["date", "bin"], "left").join(expected, "bin", "left")
    p = F.greatest(F.coalesce("n", F.lit(0)) / F.col("total"), F.lit(floor))
    q = F.coalesce("q", F.lit(floor))
    return shares.groupBy("date", F.col("total").alias("n")).agg(F.sum((p - q) * F.log(p / q)).alias("psi"))
