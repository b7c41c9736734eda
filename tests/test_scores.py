import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbsight.operators import congestion, priority

# Published station rows, among them the extremes of every scaled column.
# violation_count, severity_mean, recurrence_score, congestion_score, priority_score, tier
STATIONS = [
    (34468, 0.7937043054427294, 0.1509815132456642, 0.9897965069192657, 1.0, "IMMEDIATE"),
    (28044, 0.7722685779489373, 0.15127758420441348, 0.9414332220278665, 0.9356895850411616, "IMMEDIATE"),
    (22200, 0.7727747747747747, 0.106665957333617, 0.8105736867167006, 0.820671488815448, "IMMEDIATE"),
    (20819, 0.73047696815409, 0.1498960917074479, 0.7283495147382198, 0.7365501734465796, "HIGH"),
    (6736, 0.8094566508313539, 0.098679638637943, 0.6247854638070227, 0.6601841849816362, "HIGH"),
    (3209, 0.8497662823309442, 0.145726664040961, 0.6037491464413377, 0.657224692886702, "HIGH"),
    (5018, 0.7771821442805898, 0.0858183473708172, 0.5892320325638147, 0.5846757046425878, "MODERATE"),
    (6546, 0.7199663916895813, 0.096201195919803, 0.4942366407633788, 0.4860289434873522, "MODERATE"),
    (870, 0.80816091954023, 0.0348557692307692, 0.3900839523749218, 0.363330553348441, "LOW"),
    (2303, 0.6739036039947894, 0.0645009416195856, 0.4383634107499932, 0.3343789688847469, "LOW"),
    (5, 0.78, 0.6666666666666666, 0.0, 0.0, "MINIMAL"),
]


def test_station_scores_equal_the_published_ones(spark):
    ddl = "police_station string, violation_count long, severity_mean double, recurrence_score double, congestion_score double"
    df = spark.createDataFrame([(f"S{i}", *row[:4]) for i, row in enumerate(STATIONS)], ddl)
    got = {r["police_station"]: r for r in priority.station_priority(df).collect()}
    for i, row in enumerate(STATIONS):
        assert got[f"S{i}"]["priority_score"] == pytest.approx(row[4], abs=1e-12)
        assert got[f"S{i}"]["priority_tier"] == row[5]


def cells_of(spark, rows):
    ddl = "cell_id string, violation_count long, severity_mean double, recurrence_score double, hotspot_density double"
    return spark.createDataFrame(rows, ddl)


def test_queue_of_equal_cells_is_all_half_and_ordered_by_id(spark):
    got = priority.priority_queue(cells_of(spark, [(c, 4, 0.7, 0.0, 0.0) for c in "bca"])).collect()
    assert [r["cell_id"] for r in got] == ["a", "b", "c"]
    assert {r["priority_score"] for r in got} == {0.5} and got[0]["priority_tier"] == "MODERATE"
    assert got[0]["contributing_factors"] == {
        "hotspot_density": 0.0, "violation_intensity": 0.5, "recurrence": 0.0, "severity": 0.5,
    }


def test_queue_equals_the_formula(spark):
    rng = np.random.default_rng(5)
    n = 60
    count, sev = rng.integers(1, 500, n), rng.uniform(0.5, 1, n)
    rec, density = rng.uniform(0, 1, n), rng.uniform(0, 1, n) * (rng.uniform(size=n) > 0.4)
    rows = [(f"{i:03d}", int(count[i]), float(sev[i]), float(rec[i]), float(density[i])) for i in range(n)]
    unit = lambda x: (x - x.min()) / (x.max() - x.min())
    expected = unit(0.4 * density + 0.3 * unit(np.log1p(count)) + 0.2 * rec + 0.1 * unit(sev))
    got = {r["cell_id"]: r["priority_score"] for r in priority.priority_queue(cells_of(spark, rows)).collect()}
    assert [got[f"{i:03d}"] for i in range(n)] == pytest.approx(list(expected), abs=1e-12)
    best = [r["cell_id"] for r in priority.priority_queue(cells_of(spark, rows), 7).collect()]
    assert best == [f"{i:03d}" for i in np.argsort(-expected)[:7]]


def test_missing_factors_count_as_zero(spark):
    got = priority.priority_queue(cells_of(spark, [("a", 9, None, None, None), ("b", 2, 0.9, 0.4, 1.0)])).collect()
    assert [r["cell_id"] for r in got] == ["b", "a"]


def test_constant_prediction_scores_half(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "cell_id string, congestion_raw double")
    assert {r["congestion_score"] for r in congestion.congestion_scores(df).collect()} == {0.5}


def test_station_without_majority_cell_scores_zero(spark, ws):
    scored = spark.createDataFrame(
        [(f"s:{i}:0", "A", i / 10, i > 4) for i in range(11)],
        "cell_id string, police_station string, congestion_score double, is_hotspot boolean",
    )
    stations = spark.createDataFrame([("A", 5), ("NULL", 2)], "police_station string, violation_count long")
    got = {r["police_station"]: r for r in congestion.station_congestion(ws, scored, stations).collect()}
    assert got["A"]["congestion_score"] == pytest.approx(0.9)
    assert (got["A"]["hotspot_cells"], got["A"]["total_cells"]) == (6, 11)
    assert got["NULL"]["congestion_score"] == 0.0 and got["NULL"]["total_cells"] == 0
    assert got["NULL"]["congestion_score_p90"] is None


def test_all_scores_lie_in_the_unit_interval(city):
    for df, column in ((city.scored, "congestion_score"), (city.queue, "priority_score"), (city.station_queue, "priority_score")):
        low, high = df.agg(F.min(column), F.max(column)).first()
        assert 0.0 <= low <= high <= 1.0


def test_trees_fit_about_as_well_as_the_line(spark, violations, city):
    model = congestion.train_gbt(city.hotspots, rounds=200)
    line, trees = city.model.metrics.first(), model.metrics.first()
    assert trees["r2"] > line["r2"] - 0.02
    assert sum(model.importance.values()) == pytest.approx(100, abs=0.5)
    evaluated = congestion.evaluate(model, city.hotspots)
    assert evaluated["mae"] == pytest.approx(trees["mae"]) and evaluated["r2"] == pytest.approx(trees["r2"])
    predicted = model.predict(city.hotspots)
    assert predicted.count() == city.cells.count() and "_features" not in predicted.columns


def test_missing_model_inputs_are_skipped(city):
    slim = city.hotspots.drop("hour_std", "hotspot_density")
    assert congestion.available_features(slim) == [
        "severity_mean", "weekday_pct", "vehicle_diversity", "unique_vehicles", "recurrence_score",
    ]


def test_split_is_stable_and_about_one_in_five(city):
    split = lambda n: {r["cell_id"]: r["is_test"] for r in congestion.train_test_split(city.cells.repartition(n)).collect()}
    first = split(1)
    assert first == split(6)
    assert 0.1 < sum(first.values()) / len(first) < 0.3


def test_the_node_table_predicts_what_the_model_predicts(spark, ws, city):
    model = congestion.train_gbt(city.hotspots, rounds=12)
    nodes = ws.save("nodes", congestion.node_table(ws, model))
    cells = city.hotspots.withColumn("severity_mean", F.when(F.col("unique_vehicles") > 2, F.col("severity_mean")))
    want = {r["cell_id"]: r["congestion_raw"] for r in model.predict(cells).collect()}
    got = {r["cell_id"]: r["congestion_raw"] for r in congestion.score_nodes(cells, nodes).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(set(got.values())) > 10
    shape = nodes.groupBy("tree").agg(F.count("*").alias("n"), F.max("node").alias("top"), F.count_if(F.col("feature").isNull()).alias("leaves"))
    assert all(r["top"] == r["n"] - 1 and r["leaves"] == (r["n"] + 1) // 2 <= 32 for r in shape.collect())
    root = nodes.where("node = 0")
    assert root.count() == 12 and root.where("n_rows > 0 AND gain > 0").count() == 12
