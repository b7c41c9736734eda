import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kerbsight.streaming import rates
from kerbsight.streaming.log import BatchLog

START = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def batch(spark, i, rng):
    """Counts of the hour `i` and of the two before, which grow with the batch."""
    found = [(f"c{rng.randrange(3)}", START + dt.timedelta(hours=max(0, i - back)), 10 * i + back) for back in range(3)]
    return list({(k, b): (k, b, n) for k, b, n in found}.values())


def log_at(spark, path, every=25):
    return BatchLog(spark, path, "key", "n bigint", minutes=60, lateness="3 hours", every=every)


def test_two_hundred_batches(spark, ws, monkeypatch):
    rng, want = random.Random(1), {}
    path = ws.path("log")
    log = log_at(spark, path)
    commit = BatchLog._commit
    crashes = []

    def dying(self, through, total):
        if len(self.commits()) == 3 and not crashes:
            crashes.append(through)
            raise RuntimeError("killed between merge and commit")
        commit(self, through, total)

    monkeypatch.setattr(BatchLog, "_commit", dying)
    for i in range(200):
        found = batch(spark, i, rng)
        df = spark.createDataFrame(found, "key string, bucket timestamp_ntz, n bigint").coalesce(1)
        try:
            log.write(df, i)
        except RuntimeError:
            # everything written so far is still read, and the batch is repeated
            assert rows(log.read()) == sorted((b, k, n) for (k, b), n in want.items())
            log = log_at(spark, path)
            log.write(df, i)
        want |= {(k, b): n for k, b, n in found}
        if i % 60 == 59:
            log.write(df, i)  # a repeated batch
            assert rows(log.read()) == sorted((b, k, n) for (k, b), n in want.items())
            assert log.total() == sum(want.values())
    assert crashes and len(log.commits()) >= 6
    # what is read for recent hours: the open part, the batches since, and the closed folders of two days
    since = START + dt.timedelta(hours=180)
    recent = log.read(since=since)
    assert rows(recent) == sorted((b, k, n) for (k, b), n in want.items() if b >= since)
    assert len(log.batches()) <= 51
    assert "PartitionFilters: [isnotnull(day" in recent._jdf.queryExecution().executedPlan().toString()
    n_open = spark.read.parquet(f"{path}/open/through={log.commits()[-1]}").count()
    assert n_open < 20 < len(want)


@pytest.fixture(scope="module")
def feed(spark, city, ws):
    """The facts in eight files, by time, as stream of one file per micro-batch; and as a table."""
    columns = ["id", "police_station", "cell_street", "created_datetime"]
    table = ws.save("feed", city.facts.select(*columns))
    path = ws.path("feed-files")
    bounds = table.where("created_datetime IS NOT NULL").approxQuantile("id", [i / 8 for i in range(9)], 0)
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = table.where((F.col("id") > low) & (F.col("id") <= high) | (F.col("id") == low) & (low == bounds[0]))
        part.coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return source, spark.read.parquet(path)


def test_alerts_while_the_stream_runs(spark, feed, ws):
    source, table = feed
    rules = ws.save("rules", table.where("cell_street IS NOT NULL").select(F.col("cell_street").alias("cell_id")).distinct().withColumn("threshold", F.lit(0).cast("bigint")))
    run = rates.run_alerts(ws, source, rules, "400 days")
    logged = run.alerts.read()
    assert len(run.alerts.batches()) > 1
    assert logged.groupBy("cell_id", "window_start").count().where("count > 1").count() == 0
    want = rates.hourly_alerts(table, rules)
    assert logged.count() > 50 and rows(rates.crossed_windows(run)) == rows(want)
    # the count that crossed is above the threshold and at most the last one
    assert logged.where("current_count <= threshold").count() == 0


def test_a_repeated_batch_adds_no_alert(spark, feed, ws, monkeypatch):
    """The stream dies in its fifth batch, after the alerts, and goes on."""
    source, table = feed
    rules = ws.save("rules", table.where("cell_street IS NOT NULL").select(F.col("cell_street").alias("cell_id")).distinct().withColumn("threshold", F.lit(0).cast("bigint")))
    path, write, died = ws.path("alerts"), BatchLog.write, []

    def dying(self, df, batch_id):
        write(self, df, batch_id)
        if batch_id == 4 and "current_count" in self.values and not died:
            died.append(batch_id)
            raise RuntimeError("killed after the alerts")

    monkeypatch.setattr(BatchLog, "write", dying)
    with pytest.raises(Exception, match="killed after the alerts"):
        rates.run_alerts(ws, source, rules, "400 days", path)
    run = rates.run_alerts(ws, source, rules, "400 days", path)
    assert died and run.n_dropped == 0 and 0 < run.n_read < table.count()
    assert run.alerts.read().groupBy("cell_id", "window_start").count().where("count > 1").count() == 0
    assert rows(rates.crossed_windows(run)) == rows(rates.hourly_alerts(table, rules))


def test_copies_are_counted_once(spark, ws):
    """Ten rows, then five of them again with new ones, then one that is again and too late."""
    path, place = ws.path("copies"), ws.path("copies-state")
    schema = "id bigint, police_station string, created_datetime timestamp_ntz"
    at = lambda m: START + dt.timedelta(minutes=m)
    first = [(i, "s", at(i)) for i in range(10)]
    parts = [first, first[:5] + [(i, "s", at(i)) for i in range(20, 24)], [(30, "s", at(600))], [first[0], (31, "s", at(601))]]
    read = late = copies = 0
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        run = rates.run_buckets(ws, source, "police_station", 5, "1 hour", place, ids=["id"])
        read, late, copies = read + run.n_read, late + run.n_dropped, copies + run.n_duplicates
    assert (read, copies, late) == (22, 5, 1) and run.log.total() == 16
