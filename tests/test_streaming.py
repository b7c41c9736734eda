import contextlib
import datetime as dt
import io
import math

import pytest
from pyspark.sql import functions as F

from kerbsight.streaming import rates


@pytest.fixture(scope="module")
def stream(spark, city, ws):
    """The enriched facts as a file stream, and the same rows as a table."""
    table = ws.save("stream-input", city.facts.select("police_station", "cell_street", "created_datetime", "hour_ist"))
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(table.schema).parquet(path), table


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_sliding_rate_stream_equals_its_twin(stream, ws):
    source, table = stream
    run = rates.run_buckets(ws, source, "police_station", 5)
    assert rows(rates.stream_sliding_rate(run)) == rows(rates.sliding_rate(table))
    assert run.n_dropped == 0


def test_cell_count_stream_equals_its_twin(stream, ws):
    source, table = stream
    run = rates.run_buckets(ws, source, "cell_street", 60)
    assert rows(rates.stream_cell_count_24h(run)) == rows(rates.cell_count_24h(table))


def test_alert_stream_equals_its_twin(stream, ws, city):
    source, table = stream
    rules = city.cells.select("cell_id", F.lit(0).cast("long").alias("threshold"))
    got = rates.stream_alerts(rates.run_buckets(ws, source, "cell_street", 60), rules)
    assert got.count() > 0
    assert rows(got) == rows(rates.hourly_alerts(table, rules))


def test_a_key_is_computed_once_a_row(spark, stream, ws):
    """No filter on the key below the observation, where the whole expression of the key would stand in it."""
    source, _ = stream
    plans = []

    def explain(log, batch_id):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            spark.streams.active[0].explain()
        plans.append(out.getvalue())

    facts = source.withColumn("cell_street", F.concat(F.lit("x"), "cell_street"))
    run = rates.run_buckets(ws, facts, "cell_street", 60, after_batch=explain)
    assert run.n_read > 0 and run.n_dropped == 0
    below = plans[0].split("CollectMetrics")[1]
    assert "Project [" in below and "Filter " not in below


def test_a_file_of_the_feed_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    import __spark_entry__ as entry

    rows = spark.range(300_000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, rand(1) * 1e6) AS ts",
        "id % 1500 AS user_id", "'click' AS event_type", "rand(2) AS value", "uuid() AS props",
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(entry, "FEED_FILES", 1)
    files = entry._timed_feed(spark, str(tmp_path)) and entry.tables(spark, str(tmp_path)).feed
    (file,) = spark.read.parquet(files).inputFiles()
    assert pq.ParquetFile(file.removeprefix("file://")).num_row_groups > 3


def test_peak_stream_equals_its_twin(spark, stream, ws):
    source, table = stream
    path = ws.path("peaks")
    rates.write_peaks(source, path, ws.path("peaks-checkpoint")).awaitTermination()
    got = rates.read_peaks(spark, path)
    assert rows(got) == rows(rates.running_peak_hour(rates.hourly_counts(table)))


@pytest.mark.parametrize("lateness", ["1 hour", "400 days"])
def test_rows_out_of_order_are_counted_or_reported(spark, stream, ws, lateness):
    """Three files, newest first, one per micro-batch; then one more, later on."""
    _, table = stream
    known = table.where("police_station IS NOT NULL AND created_datetime IS NOT NULL")
    times = sorted(r[0] for r in known.select("created_datetime").collect())
    third = len(times) // 3
    path = ws.path("unsorted")
    parts = [
        known.where(F.col("created_datetime") >= F.lit(times[2 * third])),
        known.where(F.col("created_datetime").between(F.lit(times[third]), F.lit(times[2 * third])) & (F.col("created_datetime") < F.lit(times[2 * third]))),
        known.where(F.col("created_datetime") < F.lit(times[third])),
    ]
    place = ws.path("unsorted-state")
    read = dropped = 0
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
        run = rates.run_buckets(ws, source, "police_station", 5, lateness, place)
        read, dropped = read + run.n_read, dropped + run.n_dropped
        assert run.n_read == part.count()
    counted = run.buckets.agg(F.sum("n")).first()[0]
    assert read == known.count() and counted + dropped == read
    if lateness == "400 days":
        assert dropped == 0
        assert rows(rates.stream_sliding_rate(run)) == rows(rates.sliding_rate(table))
    else:
        assert dropped > 0


def test_sliding_counts_by_hand(spark):
    times = [(dt.datetime(2024, 1, 1, 0, m),) for m in (1, 4, 6, 11)] + [(None,)]
    df = spark.createDataFrame(times, "created_datetime timestamp_ntz").withColumn("k", F.lit("x"))
    got = {r["window_start"]: r["violations"] for r in rates.sliding_counts(df, ["k"], 10, 5).collect()}
    start = dt.datetime(2023, 12, 31, 23, 55)
    assert got == {start + dt.timedelta(minutes=5 * i): n for i, n in enumerate((2, 3, 2, 1))}
    with pytest.raises(ValueError):
        rates.sliding_counts(df, ["k"], 10, 3)


def test_drift_of_equal_and_of_moved_scores(spark):
    scores = lambda *v: spark.createDataFrame([(x,) for x in v], "score double")
    same = scores(0.05, 0.5, 1.0)
    assert all(r["psi"] == 0 for r in rates.score_drift(same, same).collect())
    moved = {r["bin"]: r["psi"] for r in rates.score_drift(scores(0.05), scores(0.95)).collect()}
    assert moved == pytest.approx({0: (1e-4 - 1) * math.log(1e-4), 9: (1 - 1e-4) * math.log(1e4)})
