import pytest

from kerbsight.operators import lookups

CELLS = (
    "cell_id string, hq long, hr long, violation_count long, congestion_score double, recurrence_score double, "
    "severity_mean double, police_station string, top_violation string, hour_peak int, is_hotspot boolean"
)


@pytest.fixture(scope="module")
def cells(spark):
    rows = [
        ("s:0:0", 0, 0, 30, 0.9, 0.2, 0.8, "A", "NO PARKING", 9, True),
        ("s:1:0", 1, 0, 10, 0.5, 0.0, 0.6, "B", "WRONG PARKING", 18, False),
    ]
    return spark.createDataFrame(rows, CELLS)


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [
        ("Safe 100%", 0, 0, 3), ("Safe 100%", 1, 0, 1), ("Safe 1000", 0, 0, 2),
        ("Off map", None, None, 4), ("Elsewhere", 7, 7, 600),
    ]
    return spark.createDataFrame(rows, "junction_name string, street_q long, street_r long, n_rows long")


def cards(df):
    return {r["name"]: r.asDict() for r in df.collect()}


def test_junction_scores_are_weighted_by_the_cells(cells, pairs):
    got = cards(lookups.junction_scorecard(pairs, cells))["Safe 100%"]
    assert got["score"] == pytest.approx((0.9 * 30 + 0.5 * 10) / 40)
    assert (got["violation_count"], got["total_cells"], got["hotspot_cells"]) == (4, 2, 1)
    assert (got["police_station"], got["top_violation"], got["peak_hour"]) == ("A", "NO PARKING", 9)


def test_junction_without_a_known_cell_gets_the_defaults(cells, pairs):
    got = cards(lookups.junction_scorecard(pairs, cells))
    for name, n_cells in (("Off map", 0), ("Elsewhere", 1)):
        r = got[name]
        assert (r["score"], r["recurrence_rate"], r["severity_index"]) == (0.5, 0.0, 0.5)
        assert (r["police_station"], r["top_violation"], r["peak_hour"]) == ("Unknown", "Unknown", 12)
        assert (r["hotspot_cells"], r["total_cells"]) == (0, n_cells)
    assert got["Elsewhere"]["confidence_score"] == pytest.approx(0.80 + 0.18 * 0.6)


def test_search_takes_the_text_literally(cells, pairs):
    assert [r["junction_name"] for r in lookups.matching_junctions(pairs, "100%").collect()] == ["Safe 100%"]
    assert lookups.matching_junctions(pairs, "s_fe").count() == 0
    assert lookups.best_junction(pairs, "SAFE").first()["junction_name"] == "Safe 100%"
    assert cards(lookups.junction_lookup(pairs, cells, "safe"))["Safe 100%"]["violation_count"] == 4
    assert lookups.junction_lookup(pairs, cells, "nowhere").count() == 0


def test_cells_of_a_junction(cells, pairs):
    assert lookups.junction_cells(pairs, cells, "Safe 1000").count() == 1


def test_station_confidence_and_sentences(spark):
    ddl = (
        "police_station string, violation_count long, congestion_score double, hotspot_cells long, total_cells long, "
        "recurrence_score double, severity_mean double, hour_peak int"
    )
    rows = [("Up", 34468, 0.99, 14, 14, 0.1509815, 0.7937, 9), ("Low", 100, 0.1, 0, 3, 0.0, 0.725, 0)]
    stations = spark.createDataFrame(rows, ddl)
    got = cards(lookups.station_factors(lookups.station_scorecard(stations)))
    assert got["Up"]["confidence_score"] == pytest.approx(0.98)
    assert got["Low"]["confidence_score"] == pytest.approx(0.85 + 0.13 * 0.02)
    assert "14 chronic hotspot grid cell(s) out of 14" in got["Up"]["contributing_factors"][0]
    assert got["Up"]["contributing_factors"][1].startswith("Vehicle Recurrence: 15.1% of")
    assert "No high-intensity hotspot clusters detected in the 3" in got["Low"]["contributing_factors"][0]
    assert "index is 0.72/1.0" in got["Low"]["contributing_factors"][2]
    assert "around hour 00:00 IST" in got["Low"]["contributing_factors"][3]
    assert set(cards(lookups.station_scorecard(stations, "uP"))) == {"Up"}


def test_risk_panel_texts(spark, ws):
    ddl = "name string, score double, hotspot_cells long, total_cells long, recurrence_rate double, severity_index double, peak_hour int"
    rows = [
        ("a", 0.955, 4, 4, 0.15, 0.75, 0), ("b", 0.5, 1, 2, 0.08, 0.5, 23),
        ("c", 0.5, 1, 9, 0.01, 0.25, 9), ("d", 0.0, 0, 0, 0.0, 0.1, 12),
    ]
    df = spark.createDataFrame(rows, ddl)
    got = cards(lookups.risk_panel(df))
    assert got["a"]["peak_window"] == "23:00-01:00" and got["b"]["peak_window"] == "22:00-00:00"
    assert [got[n]["hotspot_pct"] for n in "abcd"] == [100, 50, 11, 0]
    assert [got[n]["hotspot_text"].split(":")[0] for n in "abcd"] == ["Chronic", "Clustered", "Partial", "Clear"]
    assert [got[n]["recurrence_text"].split(":")[0] for n in "abcd"] == [
        "High Recurrence", "Moderate", "Low Recurrence", "Low Recurrence",
    ]
    assert [got[n]["severity_text"].split(":")[0] for n in "abcd"] == ["Very High", "High", "Moderate", "Low Severity"]
    assert [got[n]["rank_band"] for n in "abcd"] == ["#1 Citywide", "#25 Citywide", "#25 Citywide", "#38 Citywide"]
    assert got["a"]["risk_label"] == "Critical Risk" and got["d"]["risk_label"] == "Minimal Risk"
    ranks = {r["name"]: r["score_rank"] for r in lookups.score_ranks(ws, df).collect()}
    assert ranks == {"a": 1, "b": 2, "c": 2, "d": 4}


def test_alert_rules(spark, cells):
    rules = spark.createDataFrame([("s:0:0", 30), ("s:0:0", 29), ("s:9:9", 1)], "cell_id string, threshold long")
    got = {(r["cell_id"], r["threshold"]): r for r in lookups.threshold_alerts(rules, cells).collect()}
    assert got["s:0:0", 30]["alert_triggered"] is False
    assert got["s:0:0", 29]["alert_triggered"] is True
    assert got["s:0:0", 29]["message"] == (
        "Alert triggered! Cell violation count (30) exceeds threshold (29). Webhook dispatched."
    )
    assert got["s:9:9", 1]["status"] == "not found" and got["s:9:9", 1]["current_count"] is None


def test_queue_filters(city):
    queue = city.queue
    found = lookups.enforcement_queue(queue, 500, station="STATION 1")
    assert {r["police_station"] for r in found.collect()} == {"Station 1"}
    assert all(r["hotspot_rank"] is None for r in found.where("NOT is_hotspot").collect())
    assert lookups.enforcement_queue(queue).count() == 20
    for limit in (0, 501):
        with pytest.raises(ValueError):
            lookups.enforcement_queue(queue, limit)


def test_dashboard_of_an_empty_queue(city):
    row = lookups.dashboard_stats(city.queue.limit(0)).first()
    assert row["total_cells"] == 0 and row["avg_congestion"] == 0.0 and row["total_violations"] == 0
