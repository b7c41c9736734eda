import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kerbsight.functions import columns as C, fixed


def one(spark, expr, value, ddl):
    return spark.createDataFrame([(value,)], f"v {ddl}").select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('["A","B"]', ["A", "B"]),
        ("MALFORMED", ["MALFORMED"]),
        ('"WRONG"', ["WRONG"]),
        ("5", ["5"]),
        ("[]", []),
        (None, []),
        ("[1", ["[1"]),
        ('\t ["A"] ', ["A"]),
        ('{"a":1}', ['{"a":1}']),
        ("null and void", ["null and void"]),
        ('["A"] x', ['["A"] x']),
        ('["A"]["B"]', ['["A"]["B"]']),
        ('"A" "B"', ['"A" "B"']),
    ],
)
def test_violation_list(spark, text, expected):
    assert one(spark, C.violation_list, text, "string") == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("[112,104]", [112, 104]),
        ("112", [112]),
        ("bad", []),
        (None, []),
        ("99999999999", [99999999999]),
        ("[99999999999]", [99999999999]),
        ('[112,"x"]', [112, None]),
        ('["112"]', [112]),
        ('"112"', [112]),
        ("1.5", [None]),
        ("[112] x", []),
        ("[]", []),
        ("[null, -3]", [None, -3]),
    ],
)
def test_offence_list(spark, text, expected):
    assert one(spark, C.offence_list, text, "string") == expected


def test_first_or_unknown(spark):
    assert one(spark, C.first_or_unknown, [], "array<string>") == "UNKNOWN"
    assert one(spark, C.first_or_unknown, ["A", "B"], "array<string>") == "A"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-01 10:00:00+05:30", dt.datetime(2024, 1, 1, 4, 30)),
        ("2024-01-01 10:00:00+00", dt.datetime(2024, 1, 1, 10)),
        ("2024-01-01T10:00:00.25Z", dt.datetime(2024, 1, 1, 10, 0, 0, 250000)),
        ("2024-01-01 10:00:00", dt.datetime(2024, 1, 1, 10)),
        ("2024-01-01", dt.datetime(2024, 1, 1)),
        ("garbage", None),
        (None, None),
        ("2024-01-01 10:00:00 Asia/Kolkata", dt.datetime(2024, 1, 1, 4, 30)),
        ("2024-01-01 10:00:00 IST", None),
        ("2024-01-01 10:00:00 EST", None),
        ("2024-01-01 10:00:00 GMT", dt.datetime(2024, 1, 1, 10)),
        ("2024-01-01 10:00:00 UTC", dt.datetime(2024, 1, 1, 10)),
        ("2024-01-01 10:00:00-0300", dt.datetime(2024, 1, 1, 13)),
        ("2024-01-01T10:00", dt.datetime(2024, 1, 1, 10)),
        ("2024-01-01 10:00:00.5 Nowhere/Land", None),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_timestamps_do_not_depend_on_the_session_zone(spark, text, expected, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(spark, lambda c: C.utc_wall_clock(c, "string"), text, "string") == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_local_time_crosses_midnight(spark):
    local = one(spark, C.local_time, dt.datetime(2024, 1, 1, 20), "timestamp_ntz")
    assert local == dt.datetime(2024, 1, 2, 1, 30)
    weekday = lambda c: F.weekday(C.local_time(c))
    assert one(spark, weekday, dt.datetime(2024, 1, 1, 20), "timestamp_ntz") == 1


def test_severity_is_an_exact_match(spark):
    weight = lambda v: float(one(spark, C.severity_weight, v, "string"))
    assert weight("NO PARKING") == 0.9
    assert weight("PARKING IN A MAIN ROAD") == 0.5
    assert weight("UNKNOWN") == 0.5
    assert weight(None) == 0.5


@pytest.mark.parametrize(
    "score, tier", [(0.8, "IMMEDIATE"), (0.7999, "HIGH"), (0.4, "MODERATE"), (0.2, "LOW"), (0.0, "MINIMAL")]
)
def test_tiers(spark, score, tier):
    assert one(spark, C.tier, score, "double") == tier
    actions = {name: text for _, name, text in fixed.TIERS}
    assert one(spark, C.action, score, "double") == actions[tier]


def test_clip_keeps_null(spark):
    assert one(spark, C.clip01, None, "double") is None
    assert one(spark, C.clip01, 1.5, "double") == 1.0
    assert one(spark, C.clip01, -0.5, "double") == 0.0


def test_constant_column_scales_to_half(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    got = df.select(C.unit_range(F.col("v"), F.lit(3.0), F.lit(3.0)).alias("o")).collect()
    assert [r["o"] for r in got] == [0.5, 0.5]


def test_rounding_equals_printf(spark):
    rng = random.Random(7)
    values = [rng.random() * rng.choice([1, 100]) for _ in range(2000)]
    values += [i / 1000 for i in range(3000)] + [i / 128 for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 3):
        got = df.select("v", C.round_printf(F.col("v"), digits).alias("o")).collect()
        assert all(r["o"] == float(f"{r['v']:.{digits}f}") for r in got)
