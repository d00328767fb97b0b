import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tripflow.functions import coerce, geo, lines, scoring


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_to_number_is_lenient(spark):
    raw = ["12", " 1.5 ", "1e3", "12d", "12f", "0x1p3", "1,000", "abc", "", None, "NaN", "-.5", "inf"]
    assert column(spark, raw, "string", coerce.to_number) == [
        12.0, 1.5, 1000.0, None, None, None, None, None, None, None, None, -0.5, math.inf,
    ]


def test_round_half_even_matches_exact_binary_rounding(spark):
    values = [1.005, 2.675, 0.125, 0.375, 2.5, 3.5, -1.005, -0.125, 66.565, 1e-9, 1234.5, 68423.45, 0.0]
    values += [i / 1000 + 0.0005 for i in range(200)]
    for digits in (1, 2, 3, 4):
        got = column(spark, values, "double", lambda v: coerce.round_half_even(v, digits))
        assert got == [round(v, digits) for v in values]


def test_utc_text(spark):
    raw = ["2024-01-01T05:00:00-05:00", "2024-01-01T05:00:00Z", "2024-01-01 05:00:00", "soon", None]
    assert column(spark, raw, "string", lambda v: coerce.iso_seconds(coerce.to_utc(v))) == [
        "2024-01-01T10:00:00+00:00", "2024-01-01T05:00:00+00:00", "2024-01-01T05:00:00+00:00", None, None,
    ]


def test_first_present_keeps_zero(spark):
    rows = spark.createDataFrame([(None, "", "null", "0"), ("a", "b", None, None), (None, "", "null", None)], "a string, b string, c string, d string")
    got = [r["x"] for r in rows.select(coerce.first_present(*[F.col(c) for c in "abcd"]).alias("x")).collect()]
    assert got == ["0", "a", None]


def test_haversine(spark):
    rows = spark.createDataFrame([(33.75, -84.39, 32.08, -81.09), (0.0, 0.0, 0.0, 180.0), (10.0, 10.0, 10.0, 10.0)], "a double, b double, c double, d double")
    got = [r["x"] for r in rows.select(geo.haversine_miles(*[F.col(c) for c in "abcd"]).alias("x")).collect()]
    assert got[0] == pytest.approx(222.6, abs=1.0)
    assert got[1] == pytest.approx(math.pi * geo.EARTH_RADIUS_MILES)
    assert got[2] == 0.0


def test_roads(spark):
    roads = ["I-75", " i-85 ", "SR-400", "ga-316", "US-41", "Main", "", None]
    assert column(spark, roads, "string", scoring.freeflow_mph) == [70.0, 70.0, 45.0, 45.0, 45.0, 50.0, 50.0, 50.0]
    assert column(spark, roads, "string", scoring.path_factor) == [1.1, 1.1] + [1.2] * 6


def test_rush_hours_are_inclusive(spark):
    times = [dt.datetime(2024, 1, 1, h, m) for h, m in [(6, 59), (7, 0), (9, 59), (10, 0), (16, 0), (18, 59), (19, 0)]]
    got = column(spark, times, "timestamp", lambda v: scoring.rush_hour_bump(v.cast("timestamp")))
    local = [scoring_bump(t) for t in times]
    assert got == local


def scoring_bump(t):
    return 0.10 if 7 <= t.hour <= 9 else 0.12 if 16 <= t.hour <= 18 else 0.0


def test_weather(spark):
    winds = ["10 to 25 mph", "25 mph", "calm", "", None]
    assert column(spark, winds, "string", scoring.wind_mph) == [10.0, 25.0, 0.0, 0.0, 0.0]
    texts = ["Light RAIN", "Hail", "Drizzle", "Sunny", None]
    assert column(spark, texts, "string", lambda v: scoring.weather_bump(v, F.lit("21 mph"))) == [
        pytest.approx(0.11), 0.03, 0.03, 0.03, 0.03,
    ]
    assert column(spark, texts, "string", scoring.precipitation_flag) == [True, True, True, False, False]


def test_speed_floor_and_null(spark):
    assert column(spark, [0.0, 1.0, None], "double", lambda v: scoring.effective_mph(F.lit(4.0), scoring.speed_multiplier(v))) == [5.0, 5.0, None]
    assert column(spark, [-0.5, 0.5, 1.5, None], "double", scoring.clamp01) == [0.0, 0.5, 1.0, None]


POINTS = "array<struct<lat:double,lon:double>>"


def decode(text):
    """Plain decoder, for checking only."""
    points, lat, lon, i = [], 0, 0, 0
    while i < len(text):
        step = []
        for _ in range(2):
            shift = value = 0
            while True:
                chunk = ord(text[i]) - 63
                i += 1
                value |= (chunk & 31) << shift
                shift += 5
                if chunk < 32:
                    break
            step.append(~(value >> 1) if value & 1 else value >> 1)
        lat, lon = lat + step[0], lon + step[1]
        points.append((lat / 1e5, lon / 1e5))
    return points


def test_polyline(spark):
    published = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    others = [(0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (-0.00001, 0.00001), (33.749, -84.388)]
    got = column(spark, [published, others, [], None], POINTS, lines.encode_polyline)
    assert got[0] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert decode(got[1]) == [(round(a, 5), round(b, 5)) for a, b in others]
    assert got[2:] == [None, None]


def test_geojson(spark):
    got = column(spark, [[(1.0, 2.0)], None], POINTS, lines.geojson_line)
    assert [r["coordinates"] for r in got] == [[[2.0, 1.0]], []]


def test_times_out_of_range_are_null(spark):
    raw = ["1900-01-01T00:00:00Z", "1600-01-01T00:00:00Z", "2262-04-12T00:00:00Z", "2262-04-11T00:00:00Z"]
    got = column(spark, raw, "string", lambda v: coerce.iso_seconds(coerce.to_utc(v)))
    assert [g is None for g in got] == [False, True, True, False]
