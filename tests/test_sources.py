import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from kerbsight.functions.hexgrid import CITY
from kerbsight.operators import heatmap
from kerbsight.session import Workspace, checkpoint_root
from kerbsight.sources import files


def test_csv_keeps_quotes_spaces_and_microseconds(spark, tmp_path):
    rows = [(" a ", '["X","Y"]', dt.datetime(2024, 1, 1, 0, 0, 0, 123456), None)]
    df = spark.createDataFrame(rows, "police_station string, violation_type string, created_datetime timestamp_ntz, junction_name string")
    files.sink_csv(df, str(tmp_path / "x"))
    got = files.scan_csv(spark, str(tmp_path / "x")).first()
    assert got["police_station"] == " a " and got["violation_type"] == '["X","Y"]'
    assert got["created_datetime"] == "2024-01-01T00:00:00.123456" and got["junction_name"] is None
    assert got["vehicle_type"] is None  # absent in the file


def test_files_with_different_headers_are_matched_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,latitude,longitude\n1,12.9,77.6\n")
    (tmp_path / "b.csv").write_text("\ufeffid,longitude,extra,latitude\n2,77.5,x,12.8\n3,77.4,y,12.7\n")
    (tmp_path / "c.csv").write_text("")
    rows = files.scan_csv(spark, str(tmp_path)).collect()
    got = {r["id"]: (r["latitude"], r["longitude"], r["extra"]) for r in rows}
    assert got == {"1": (12.9, 77.6, None), "2": (12.8, 77.5, "x"), "3": (12.7, 77.4, "y")}


def test_line_feeds_in_fields_survive(spark, tmp_path):
    text = 'two\nlines, a "quote"\r\nand more'
    df = spark.createDataFrame([("1", text), ("2", "plain")], "id string, junction_name string")
    files.sink_csv(df, str(tmp_path / "x"))
    got = {r["id"]: r["junction_name"] for r in files.scan_csv(spark, str(tmp_path / "x")).collect()}
    assert got["2"] == "plain" and got["1"].replace("\r\n", "\n") == text.replace("\r\n", "\n")


def test_other_schemas_get_no_violation_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,n\nx,1\n")
    df = files.scan_csv(spark, str(tmp_path), T.StructType.fromDDL("k string, n int, m double"))
    assert df.columns == ["k", "n", "m"] and tuple(df.first()) == ("x", 1, None)


def test_malformed_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,latitude\n1,12.5\n2,north\n3,12.6,surplus\n")
    rows = files.scan_csv(spark, str(tmp_path), malformed="_bad").collect()
    assert {r["id"]: r["_bad"] for r in rows} == {"1": None, "2": "2,north", "3": "3,12.6,surplus"}


def test_missing_file_is_reported(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        files.scan_csv(spark, str(tmp_path / "none"))


def test_partitioned_sink_prunes(spark, tmp_path, city):
    path = str(tmp_path / "cleaned")
    files.sink_parquet(city.facts, path, ["date_ist"])
    back = files.scan_parquet(spark, path)
    assert back.count() == city.facts.count()
    plan = heatmap.between_dates(back, "2024-01-05", "2024-01-06")
    assert len(plan.inputFiles()) == len(back.inputFiles())  # the listing, before pruning
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_ist" in physical


def test_geojson_lines_and_documents(spark, tmp_path, city):
    found = heatmap.geojson_features(city.heatmap(7), CITY)
    files.sink_geojson(found, str(tmp_path / "lines"))
    back = files.scan_geojson(spark, str(tmp_path / "lines"))
    key = lambda r: r["feature"]["properties"]["cell_id"]
    assert sorted(back.collect(), key=key) == sorted(found.collect(), key=key)
    document = tmp_path / "doc.json"
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()]
    document.write_text('{"type": "FeatureCollection",\n "features": [' + ",\n".join(lines) + "]}")
    whole = files.scan_feature_collections(spark, str(document))
    assert whole.count() == back.count()


def test_build_if_missing_builds_once(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def builder():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.build_if_missing(spark, path, builder).count() == 3
    assert calls == [1]


def test_workspace_reads_what_it_wrote_and_cleans_up(spark):
    space = Workspace(spark)
    assert space.root.startswith(checkpoint_root(spark))
    table = space.save("numbers", spark.range(5))
    assert table.count() == 5
    space.close()
    with pytest.raises(Exception):
        spark.read.parquet(space.root)


class FakeSession:
    """A session whose configuration names no checkpoint folder."""

    def __init__(self, master, folder=None):
        self.conf = self
        self.sparkContext = self
        self.master, self.folder = master, folder

    def get(self, _key, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


@pytest.mark.parametrize("master", ["yarn", "local[2]", "local-cluster[2,1,1024]"])
def test_no_session_chooses_its_own_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(FakeSession(master))
    assert checkpoint_root(FakeSession(master, "hdfs:/shared/")) == "hdfs:/shared"


def test_a_workspace_with_a_root_gives_the_context_a_folder():
    session = FakeSession("yarn")
    assert Workspace(session, "hdfs:/mine").root.startswith("hdfs:/mine/run-")
    assert session.folder == "hdfs:/mine/checkpoints"


def test_unsorted_dates_can_be_written_without_a_shuffle(spark, tmp_path, city):
    path = str(tmp_path / "plain")
    files.sink_parquet(city.facts.select("id", "date_ist"), path, ["date_ist"], rebalance=False)
    assert files.scan_parquet(spark, path).count() == city.facts.count()
