"""Sliding violation rates, running peaks, online counts, live alerts and drift.

Every streaming job has a batch twin over the same rows; the twins are what SQL checks.

A stream keeps one count per key and tumbling bucket. Each micro-batch writes the counts it changed to a log
(`streaming/log.py`), and a reader takes each bucket's newest count, so no window waits for a watermark. Longer
windows are sums of buckets, made when the counts are read: a row is one state update, not one per window.
Rows that arrive later than `lateness` behind the newest event time find their state gone and are dropped;
`run_buckets` reports how many. With `ids` a row whose ids have been seen within that time isn't counted again.

`run_alerts` also compares the counts that each micro-batch has changed with rules, and logs a cell's window
once, in the batch in which it crosses its threshold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from kerbsight.functions import columns as C
from kerbsight.session import Workspace
from kerbsight.streaming.log import BatchLog

LATENESS = "1 hour"
FILES_PER_BATCH = 64  # rate limit of file sources
_MINUTE_MICROS = 60_000_000


def event_time(facts: DataFrame) -> DataFrame:
    """Adds `event_time` as `timestamp`: watermarks refuse `timestamp_ntz`."""
    return facts.withColumn("event_time", C.utc_instant(F.col("created_datetime")))


def _bucket(minutes: int) -> Column:
    """Start of the tumbling bucket of `created_datetime`, aligned to midnight UTC."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col("created_datetime"))
    width = minutes * _MINUTE_MICROS
    return F.timestamp_add("MICROSECOND", micros - F.pmod(micros, F.lit(width)), epoch)


def sliding_counts(facts: DataFrame, keys: list[str], width: int, slide: int) -> DataFrame:
    """Rows per key and sliding window, in minutes; `slide` divides `width`.

    Rows are first counted per slide-sized bucket. Only these counts are copied into the windows
    that contain them, not the rows, so a 24-hour window sliding by the hour does not
    multiply the facts by 24.
    """
    buckets = (
        facts.where(F.col("created_datetime").isNotNull())
        .groupBy(*keys, _bucket(slide).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    return window_sums(buckets, keys, width, slide)


def window_sums(buckets: DataFrame, keys: list[str], width: int, slide: int) -> DataFrame:
    """Sums over sliding windows of counts `(keys, bucket, n)` per bucket of `slide` minutes."""
    if width % slide:
        raise ValueError("slide must divide width")
    starts = F.array(
        *[F.timestamp_add("MINUTE", F.lit(-slide * i), F.col("bucket")) for i in range(width // slide)]
    )
    return (
        buckets.select(*keys, "n", F.explode(starts).alias("window_start"))
        .groupBy(*keys, "window_start")
        .agg(F.sum("n").alias("violations"))
    )


def sliding_rate(facts: DataFrame) -> DataFrame:
    """Violations per station in 10-minute windows that start every 5 minutes."""
    known = facts.where(F.col("police_station").isNotNull())
    return sliding_counts(known, ["police_station"], 10, 5).withColumn(
        "per_minute", F.col("violations") / 10
    )


def cell_count_24h(facts: DataFrame) -> DataFrame:
    """Violations per street cell in 24-hour windows that start every hour."""
    known = facts.where(F.col("cell_street").isNotNull())
    return sliding_counts(known, ["cell_street"], 24 * 60, 60).withColumnRenamed(
        "cell_street", "cell_id"
    )


def hourly_counts(facts: DataFrame) -> DataFrame:
    known = facts.where(F.col("police_station").isNotNull() & F.col("hour_ist").isNotNull())
    return known.groupBy("police_station", "hour_ist").agg(F.count("*").alias("violations"))


def running_peak_hour(counts: DataFrame) -> DataFrame:
    """Busiest local hour per station, the earliest among equals, from additive counts."""
    totals = counts.groupBy("police_station", "hour_ist").agg(
        F.sum("violations").alias("violations")
    )
    best = F.max(F.struct("violations", (-F.col("hour_ist")).alias("h")))
    return (
        totals.groupBy("police_station")
        .agg(best.alias("b"))
        .select(
            "police_station",
            (-F.col("b.h")).alias("peak_hour"),
            F.col("b.violations").alias("peak_violations"),
        )
    )


# -- streams ------------------------------------------------------------------------------


def bucket_stream(
    facts: DataFrame, key: str, minutes: int, lateness: str = LATENESS, ids: Sequence[str] = ()
) -> DataFrame:
    """Counts of a stream per key and tumbling bucket: `(key, bucket, n)`. State older than
    `lateness` behind the newest event is given up."""
    timed = event_time(facts.where(F.col(key).isNotNull() & F.col("created_datetime").isNotNull()))
    timed = timed.withWatermark("event_time", lateness)
    if ids:
        timed = timed.dropDuplicatesWithinWatermark(list(ids))
    return (
        timed.groupBy(F.window("event_time", f"{minutes} minutes").alias("w"), key)
        .agg(F.count("*").alias("n"))
        .select(key, C.utc_wall_clock(F.col("w.start"), "timestamp").alias("bucket"), "n")
    )


@dataclass
class StreamRun:
    """What a stream has written, the rows it has read, and those that it has not counted: later copies of
    rows (`n_duplicates`), and rows that came too late to count (`n_dropped`), copies among them."""

    buckets: DataFrame
    n_read: int
    n_dropped: int
    n_duplicates: int
    log: BatchLog
    alerts: BatchLog | None = None


class _Tally(StreamingQueryListener):
    """Running totals of the streams of a session while it is attached, by run."""

    def __init__(self):
        self.totals: dict[str, Counter] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = self.totals.setdefault(str(p.runId), Counter())
        if p.observedMetrics:
            own["read"] += p.observedMetrics["read"].n
        for operator in p.stateOperators:
            own["duplicates"] += operator.customMetrics.get("numDroppedDuplicateRows", 0)

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass


def run_buckets(
    ws: Workspace,
    facts: DataFrame,
    key: str,
    minutes: int,
    lateness: str = LATENESS,
    path: str | None = None,
    *,
    ids: Sequence[str] = (),
    after_batch: Callable[[BatchLog, int], None] | None = None,
) -> StreamRun:
    """Drive a stream of facts through all available input.

    `path` names a place of its own for a stream that goes on later with new input: counts and
    checkpoint stay there. The rows read are observed in the stream itself; those that are in no
    count and are no copies were dropped as late. A row with the same `ids` as one before, by at most `lateness`, is a
    copy; what is kept to know them is given up with the watermark. `after_batch` is called with the
    log and the batch's number when its counts are written; a repeated batch calls it again.
    """
    path, spark = path or ws.path(f"buckets-{key}-{minutes}"), ws.spark
    log = BatchLog(spark, f"{path}/counts", key, "n bigint", minutes=minutes, lateness=lateness)
    # a batch that died after writing its counts is read again, and counts as new
    before = log.total(through=_last_batch(spark, f"{path}/checkpoint"))
    # observed before they are filtered: a filter on the key would be pushed down to the scan, with the key's whole expression
    # written out in it, too long to be compiled
    known = F.col(key).isNotNull() & F.col("created_datetime").isNotNull()
    counted = facts.observe("read", F.count_if(known).alias("n"))

    def write(counts: DataFrame, batch_id: int) -> None:
        log.write(counts, batch_id)
        if after_batch:
            after_batch(log, batch_id)

    tally = _Tally()
    spark.streams.addListener(tally)
    try:
        query = (
            bucket_stream(counted, key, minutes, lateness, ids)
            .writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(tally)
    own = tally.totals.get(str(query.runId), Counter())
    late = own["read"] - own["duplicates"] - (log.total() - before)
    return StreamRun(log.read(), own["read"], late, own["duplicates"], log)


def _last_batch(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that a stream has finished, -1 for none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/[0-9]*")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return max([-1, *(int(x.getPath().getName()) for x in found)])


def stream_sliding_rate(run: StreamRun) -> DataFrame:
    """`sliding_rate` from the 5-minute buckets of a stream."""
    return window_sums(run.buckets, ["police_station"], 10, 5).withColumn(
        "per_minute", F.col("violations") / 10
    )


def stream_cell_count_24h(run: StreamRun) -> DataFrame:
    """`cell_count_24h` from the hourly buckets of a stream."""
    found = window_sums(run.buckets, ["cell_street"], 24 * 60, 60)
    return found.withColumnRenamed("cell_street", "cell_id")


def write_peaks(facts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of each station's busiest hour up to date.

    The state is one count per station and hour. Each micro-batch writes the peaks of all counts
    so far to a folder of its own; `read_peaks` reads the newest that is complete, so a reader
    always has a table.
    """

    def replace(counts: DataFrame, batch_id: int) -> None:
        running_peak_hour(counts).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        hourly_counts(facts)
        .writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """The peaks of the newest micro-batch that was written completely."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")) or []
    newest = max(int(x.getPath().getParent().getName().removeprefix("batch=")) for x in done)
    return spark.read.parquet(f"{path}/batch={newest}")


def _exceeded(hourly: DataFrame, rules: DataFrame) -> DataFrame:
    named = {"cell_street": "cell_id", "violations": "current_count"}
    return (
        hourly.withColumnsRenamed(named)
        .join(rules, "cell_id")
        .where(F.col("current_count") > F.col("threshold"))
        .select("cell_id", "window_start", "current_count", "threshold")
    )


def stream_alerts(run: StreamRun, rules: DataFrame) -> DataFrame:
    """Hourly counts per cell that exceed the cell's threshold, as far as the stream has come.
    `rules(cell_id, threshold)`."""
    return _exceeded(window_sums(run.buckets, ["cell_street"], 60, 60), rules)


def run_alerts(
    ws: Workspace, facts: DataFrame, rules: DataFrame, lateness: str = LATENESS, path: str | None = None
) -> StreamRun:
    """Alerts while the stream runs: `rules(cell_id, threshold)`, read anew by every micro-batch.

    A batch joins the counts it has changed to the rules and logs the windows that are above their
    threshold and not in the log yet, so each window is logged once, with the count that crossed.
    Of the log only windows from the batch's oldest one on are read. A batch that is repeated overwrites its own alerts and finds the
    same ones.
    """
    path = path or ws.path("alerts")
    log = BatchLog(
        ws.spark, f"{path}/alerts", "cell_id", "current_count bigint, threshold bigint",
        minutes=60, lateness=lateness, bucket="window_start",
    )

    def judge(counts: BatchLog, batch_id: int) -> None:
        changed = ws.spark.read.parquet(f"{counts.path}/batches/batch={batch_id}")
        found = _exceeded(changed.withColumnsRenamed({"bucket": "window_start", "n": "violations"}), rules)
        oldest = changed.agg(F.min("bucket").alias("b")).first().b
        if oldest is not None:
            logged = log.read(since=oldest, through=batch_id - 1).select("cell_id", "window_start")
            log.write(found.join(logged, ["cell_id", "window_start"], "left_anti"), batch_id)

    run = run_buckets(ws, facts, "cell_street", 60, lateness, path, after_batch=judge)
    run.alerts = log
    return run


def crossed_windows(run: StreamRun) -> DataFrame:
    """The logged windows with the counts they have by now: `(cell_id, window_start, current_count, threshold)`."""
    now = run.log.read().select(F.col("cell_street").alias("cell_id"), F.col("bucket").alias("window_start"), F.col("n").alias("current_count"))
    return run.alerts.read().drop("current_count").join(now, ["cell_id", "window_start"])


def hourly_alerts(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Batch twin of `stream_alerts`."""
    known = facts.where(F.col("cell_street").isNotNull())
    return _exceeded(sliding_counts(known, ["cell_street"], 60, 60), rules)


# -- drift --------------------------------------------------------------------------------


def score_histogram(scores: DataFrame, column: str = "score", bins: int = 10) -> DataFrame:
    """Share of rows per equal-width bin of [0, 1]; 1.0 belongs to the last bin."""
    index = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1))
    return (
        scores.where(F.col(column).isNotNull())
        .groupBy(index.cast("bigint").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def score_drift(expected: DataFrame, actual: DataFrame, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population-stability index between two score columns: one row per bin, with its term.

    Shares below `floor` are raised to it, so an empty bin has a finite term. The sum of `psi`
    is the index.
    """
    e = score_histogram(expected, bins=bins).withColumnRenamed("n", "n_expected")
    a = score_histogram(actual, bins=bins).withColumnRenamed("n", "n_actual")
    joined = e.join(a, "bin", "full").fillna(0, ["n_expected", "n_actual"])
    share = lambda c, total: F.greatest(F.col(c) / total, F.lit(floor))
    n_expected = e.agg(F.sum("n_expected")).scalar()
    n_actual = a.agg(F.sum("n_actual")).scalar()
    p, q = share("n_actual", n_actual), share("n_expected", n_expected)
    return joined.withColumn("psi", (p - q) * F.log(p / q))
