import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kerbsight.operators.quality import ValidationError
from kerbsight.plans.batch import CityTables, run
from kerbsight.sources import files
from kerbsight.sources.published import Published


def test_run_writes_every_table(spark, tmp_path, violations, city):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    files.sink_csv(violations, raw)
    tables = run(spark, raw, out, rounds=3)
    out = Published(spark, out).current()
    names = {p.name for p in Path(out).iterdir()}
    assert names == {
        "cleaned_violations", "temporal_profiles", "heatmap_city", "heatmap_street", "cell_features",
        "station_features", "priority_queue_csv", "top50_priority_csv", "station_priority_csv",
        "hotspot_summary_csv", "station_features_csv", "model_metadata", "model", "model_nodes",
    }
    written = spark.read.parquet(f"{out}/cell_features")
    expected = city.cells.select("cell_id", "violation_count", "severity_sum", "unique_vehicles")
    assert written.select(*expected.columns).exceptAll(expected).count() == 0
    clusters = city.hotspots.select("cell_id", "cluster_id")
    assert written.select("cell_id", "cluster_id").exceptAll(clusters).count() == 0
    assert spark.read.option("header", True).csv(f"{out}/top50_priority_csv").count() == 50
    text = next(Path(f"{out}/model_metadata").glob("*.json")).read_text()
    assert set(json.loads(text)) == {"feature_importance", "metrics", "feature_cols"}
    row = tables.totals().first()
    assert row["total_rows"] == violations.count() and row["street_cells"] == written.count()
    tables.close()


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file()}


def test_a_rejected_input_leaves_all_outputs_as_they_were(spark, tmp_path, violations):
    raw, bad, out = (str(tmp_path / x) for x in ("raw", "bad", "out"))
    files.sink_csv(violations, raw)
    run(spark, raw, out, method="ols").close()
    before = tree(out)
    files.sink_csv(violations.withColumn("latitude", F.lit(0.0)), bad)
    with pytest.raises(ValidationError, match="geo outliers"):
        run(spark, bad, out, method="ols")
    assert tree(out) == before
    files.sink_csv(violations.limit(300), raw)
    run(spark, raw, out, method="ols").close()
    assert CityTables.open(spark, out).facts.count() == 300


def test_a_run_that_dies_leaves_the_published_set_whole(spark, tmp_path, violations, ws, monkeypatch):
    """Killed before its last table, between the last table and the manifest, and not at all."""
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    files.sink_csv(violations, raw)
    run(spark, raw, out, method="ols", multiline=False).close()
    before = tree(out)

    def totals():
        opened = CityTables.open(spark, out, method="ols", ws=ws)
        return opened.facts.count(), opened.scored.agg(F.sum("violation_count")).first()[0], opened.heatmap(9).count()

    want = totals()
    files.sink_csv(violations.limit(300), raw)

    def killed(*args):
        raise KeyboardInterrupt

    for owner, name in ((files, "sink_model_metadata"), (Published, "commit")):
        with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
            patch.setattr(owner, name, killed)
            run(spark, raw, out, method="ols")
        assert tree(out) == before and totals() == want
    held = CityTables.open(spark, out, method="ols", ws=ws)
    run(spark, raw, out, method="ols").close()
    assert totals()[0] == 300 and held.scored.agg(F.sum("violation_count")).first()[0] == want[1]
    published = Published(spark, out)
    assert published.numbers() == [1, 2]
    published.prune(1)
    assert published.numbers() == [2] and totals()[0] == 300 and len(list(Path(f"{out}/versions").iterdir())) == 1


def test_a_set_is_published_whole_and_once(spark, tmp_path, monkeypatch):
    published = Published(spark, str(tmp_path / "out"))
    assert published.current() is None
    place = published.new()
    files.sink_parquet(spark.range(3), f"{place}/a")
    with pytest.raises(ValueError, match="not written: b"):
        published.commit(place, ["a", "b"])
    assert published.current() is None
    assert published.commit(place, ["a"]) == 1 and published.current() == place
    # another run that has not seen the first one's manifest
    monkeypatch.setattr(Published, "numbers", lambda self: [])
    with pytest.raises(OSError, match="another run"):
        published.commit(place, ["a"])


def test_stored_tables_are_read_and_missing_ones_built(spark, tmp_path, violations, ws):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    files.sink_csv(violations, raw)
    built = run(spark, raw, out, method="ols")
    key = ["police_station", "violation_count", "congestion_score"]
    want = sorted(map(tuple, built.scored_stations.select(*key).collect()))
    built.close()  # nothing of the run's workspace is needed any more
    opened = CityTables.open(spark, out, method="ols", ws=ws)
    assert sorted(map(tuple, opened.scored_stations.select(*key).collect())) == want
    assert "rollup" not in vars(opened) and "cells" not in vars(opened)
    assert opened.heatmap(9).count() == opened.scored.count()
    place = Published(spark, out).current()
    files.remove(spark, f"{place}/station_features")
    again = CityTables.open(spark, out, method="ols", ws=ws)
    assert sorted(map(tuple, again.scored_stations.select(*key).collect())) == want
    assert files.is_written(spark, f"{place}/station_features")


def test_unknown_method(spark, violations):
    with pytest.raises(ValueError):
        CityTables(spark, violations, method="guess")


def test_cluster_totals_agree(city):
    """Relations that must hold between the tables of any run."""
    summary = city.hotspot_summary.agg(F.sum("cell_count"), F.sum("total_violations")).first()
    spots = city.hotspots.where("is_hotspot").agg(F.count("*"), F.sum("violation_count")).first()
    assert tuple(summary) == tuple(spots)
    stations = city.scored_stations.agg(F.sum("hotspot_cells"), F.sum("total_cells")).first()
    known = city.hotspots.where("police_station != 'UNKNOWN'")
    assert tuple(stations) == tuple(known.agg(F.count_if("is_hotspot"), F.count("*")).first())
