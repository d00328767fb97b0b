import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripflow.operators import nearest_station as ns
from tripflow.operators import nearest_time as nt


def miles(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 3958.7613 * math.asin(math.sqrt(min(1.0, x)))


def brute_force(points, stations, k, reach):
    result = {}
    for i, lat, lon in points:
        near = [(round(miles(lat, lon, s[1], s[2]) * 1e8), s[0]) for s in stations]
        near = sorted(n for n in near if n[0] <= reach * 1e8)
        result[i] = [s for _, s in near[:k]]
    return result


def lookup(spark, points, stations, **options):
    frame = spark.createDataFrame(stations, "station_id long, lat double, lon double, probability double")
    index = ns.build_station_index(frame, ["probability"], **options)
    where = spark.createDataFrame(points, "i long, lat double, lon double")
    found = ns.nearest_stations(where, index, F.col("lat"), F.col("lon"))
    rows = found.select("i", F.transform("neighbours", lambda n: n["station"]["station_id"]).alias("ids")).collect()
    assert len(rows) == len(points)
    return index, {r["i"]: r["ids"] or [] for r in rows}


def clustered(seed, n):
    """Two thirds scattered; a third within a few hundred feet, some at one spot."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            lat, lon = 33.7 + rnd.random() * 1e-2, -84.4 + rnd.random() * 1e-2
        elif i % 7 == 0:
            lat, lon = 33.75, -84.25
        else:
            lat, lon = 33 + rnd.random() * 2, -85 + rnd.random() * 2
        rows.append((i, lat, lon, rnd.random()))
    return rows


@pytest.mark.parametrize("tree_bytes", [1 << 20, 20_000, 100])
def test_knn_equals_brute_force(spark, tree_bytes):
    stations = clustered(1, 400)
    rnd = random.Random(2)
    points = [(i, 33 + rnd.random() * 2, -85 + rnd.random() * 2) for i in range(150)]
    points += [(200 + i, 33.7 + rnd.random() * 2e-2, -84.4 + rnd.random() * 2e-2) for i in range(100)]
    points += [(400, 33.75, -84.25), (401, 10.0, 10.0), (402, None, -84.0)]
    index, got = lookup(spark, points, stations, k=5, max_miles=12.0, tree_bytes=tree_bytes)
    want = brute_force(points[:-1], stations, 5, 12.0)
    assert got.pop(402) == []
    assert got == want
    assert got[401] == []
    assert (index.subtrees is None) == (tree_bytes == 1 << 20)


def entries(value):
    """Numbers of entries of each list in a nested tree."""
    yield len(value)
    for e in value:
        if isinstance(e["content"], list):
            yield from entries(e["content"])


@pytest.mark.parametrize("n", [500, 5000])
def test_lists_stay_short_however_tight_the_group(spark, n):
    rnd = random.Random(n)
    rows = [(i, 33.7 + rnd.random() * 1e-3, -84.4 + rnd.random() * 1e-3, 0.5) for i in range(n)]
    points = [(0, 33.7005, -84.3995), (1, 33.6, -84.3), (2, 33.9, -84.4), (3, 33.7, -84.0)]
    index, got = lookup(spark, points, rows, k=10)
    assert got == brute_force(points, rows, 10, 25.0)
    assert max(entries(index.tree.first()["top"])) <= 8
    # what a far point measures, level by level, is a strip of the group and not all of it
    frame = spark.createDataFrame(points, "i long, lat double, lon double")
    opened = frame.withColumns({"_phi": F.radians("lat"), "_theta": F.radians("lon"), "_cos": F.cos(F.radians("lat")), "_e": index.tree.scalar()})
    for _ in range(index.levels):
        opened = ns._descended(opened, 1, 10, 25.0)
        assert opened.agg(F.max(F.size("_e"))).first()[0] <= max(300, n // 8)


def test_index_is_stored_and_read_again(spark, tmp_path):
    rows = clustered(7, 300)
    points = spark.createDataFrame([(i, 33 + i / 40, -85 + i / 50) for i in range(80)], "i long, lat double, lon double")
    frame = spark.createDataFrame(rows, "station_id long, lat double, lon double, probability double")
    for tree_bytes in (1 << 20, 5000):
        index = ns.build_station_index(frame, ["probability"], k=4, tree_bytes=tree_bytes)
        ns.save_station_index(index, str(tmp_path / str(tree_bytes)))
        again = ns.load_station_index(spark, str(tmp_path / str(tree_bytes)))
        one, two = (ns.nearest_stations(points, x, F.col("lat"), F.col("lon")).orderBy("i").collect() for x in (index, again))
        assert one == two and again.k == 4


def test_groups_cover_their_stations(spark):
    rows = clustered(3, 700) + [(1000, 89.99, 12.0, 0.1), (1001, -89.99, 12.0, 0.1), (1002, 10.0, 179.99, 0.1), (1003, 10.0, -179.99, 0.1)]
    frame = spark.createDataFrame(rows, "station_id long, lat double, lon double, probability double")
    index = ns.build_station_index(frame, ["probability"], k=1000)

    def check(group):
        if not isinstance(group["content"], list):
            return [group["content"]]
        held = [s for e in group["content"] for s in check(e)]
        assert len(held) == group["n"]
        for s in held:
            assert miles(math.degrees(group["phi"]), math.degrees(group["theta"]), s["lat"], s["lon"]) <= group["radius"] + 1e-6
        return held

    assert sorted(s["station_id"] for g in index.tree.first()["top"] for s in check(g)) == sorted(r[0] for r in rows)


def test_knn_over_poles_and_date_line(spark):
    stations = [(1, 89.9, 10.0, 0.1), (2, 89.9, -170.0, 0.1), (3, 0.0, 179.95, 0.1), (4, 0.0, -179.95, 0.1), (5, -89.95, 77.0, 0.1)]
    points = [(1, 89.95, -60.0), (2, 0.0, -179.99), (3, 0.1, 179.99), (4, -90.0, 0.0), (5, 0.0, 180.0)]
    _, got = lookup(spark, points, stations, k=3, max_miles=25.0)
    assert got == brute_force(points, stations, 3, 25.0)


def test_radius_after_top_k_and_weights(spark):
    stations = [(1, 33.0, -84.0, 0.2), (2, 33.1, -84.0, 0.6), (3, 35.0, -84.0, 1.0)]
    frame = spark.createDataFrame(stations, "station_id long, lat double, lon double, probability double")
    index = ns.build_station_index(frame, ["probability"])
    points = spark.createDataFrame([(1, 33.02, -84.0), (2, 40.0, -84.0)], "i long, lat double, lon double")
    found = ns.nearest_stations(points, index, F.col("lat"), F.col("lon"))
    got = {r["i"]: r["p"] for r in found.select("i", ns.weighted_mean(F.col("neighbours"), "probability").alias("p")).collect()}
    w = [1 / (miles(33.02, -84, s[1], s[2]) + 1e-3) for s in stations[:2]]
    assert got[1] == pytest.approx((0.2 * w[0] + 0.6 * w[1]) / sum(w))
    assert got[2] is None
    rows = ns.neighbour_rows(found, ["i"]).collect()
    assert [r["rank"] for r in rows] == [1, 2] and sum(r["weight"] for r in rows) == pytest.approx(1)


def moments_frame(spark, times):
    rows = spark.createDataFrame([(t, t, f"f{i}") for i, t in enumerate(times)], "start timestamp, seen timestamp, text string")
    return nt.distinct_moments(rows, F.col("start"), F.col("seen"), [F.col("text")])


def micros(t):
    return round((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)


@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_nearest_time_equals_brute_force(spark, broadcast_bytes):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    times = {start + dt.timedelta(hours=h) for h in range(0, 72, 6)}
    times |= {start + dt.timedelta(days=9, seconds=rnd.randrange(7200)) for _ in range(300)}  # a busy day after a gap
    times |= {start + dt.timedelta(days=9, hours=5, microseconds=40 * i) for i in range(60)}
    asks = [start + dt.timedelta(seconds=rnd.randrange(-86400, 14 * 86400)) for _ in range(300)]
    asks += [start + dt.timedelta(days=9, hours=5, microseconds=rnd.randrange(3000)) for _ in range(50)]
    asks += [start + dt.timedelta(hours=3), start - dt.timedelta(days=400), start + dt.timedelta(days=400)]
    index = nt.build_time_index(moments_frame(spark, sorted(times)), list_target=8, broadcast_bytes=broadcast_bytes)
    assert index.days.select("width").distinct().count() > 1
    points = spark.createDataFrame(list(enumerate(asks)) + [(9999, None)], "i long, t timestamp")
    got = {r["i"]: r["at"] for r in nt.nearest_in_time(points, index, F.col("t")).select("i", "nearest.at").collect()}
    assert got.pop(9999) is None
    ats = sorted(micros(t) for t in times)
    want = {i: min(ats, key=lambda a: (abs(a - micros(t)), a)) for i, t in enumerate(asks)}
    assert got == want


def test_nearest_time_newest_copy_wins_and_empty_log(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(t, t, "old"), (t, t + dt.timedelta(hours=1), "new"), (None, t, "no start")], "start timestamp, seen timestamp, text string")
    points = spark.createDataFrame([(1, t)], "i long, t timestamp")
    moments = nt.distinct_moments(rows, F.col("start"), F.col("seen"), [F.col("text")])
    found = nt.nearest_in_time(points, nt.build_time_index(moments), F.col("t"))
    assert found.first()["nearest"]["row"]["text"] == "new"
    empty = nt.nearest_in_time(points, nt.build_time_index(moments.where("at < 0")), F.col("t"))
    assert empty.first()["nearest"] is None


@pytest.mark.parametrize("wide", [2.0, 1e-3])
def test_points_are_held_against_few_stations(wide):
    """A block of points keeps the stations that may count for one of them, spread or in a tight group, and no others."""
    rnd = np.random.default_rng(5)
    stations = np.radians(np.stack([33 + wide * rnd.random(3000), -85 + wide * rnd.random(3000)], axis=1))
    points = np.radians(np.stack([33 + 2 * rnd.random(2000), -85 + 2 * rnd.random(2000)], axis=1))
    where, places = ns._in_space(*points.T), ns._in_space(*stations.T)
    for radius, n in ((None, None), (np.zeros(3000), np.ones(3000))):
        point, entry = ns._near_pairs(where, places, radius, n, 10, float(ns._chord(60.0)))
        got = set(zip(point.tolist(), entry.tolist()))
        d = ns._far(where[:, None, :], places[None, :, :])
        want = np.argsort(d, axis=1)[:, :10]
        for p, first in enumerate(want):
            assert all((p, e) in got for e in first[d[p, first] <= ns._chord(60.0)].tolist())
        assert len(got) == len(point) <= 12 * len(points)


@pytest.mark.parametrize("tree_bytes", [1 << 20, 3000])
def test_many_points_equal_brute_force(spark, tree_bytes):
    rnd = random.Random(11)
    rows = [(i, 33.5 + rnd.randrange(40) * 1e-5, -83.5 + rnd.randrange(40) * 1e-5, None if i % 5 == 0 else 0.5) for i in range(600)]
    rows += [(1000 + i, 33 + rnd.random(), -84 + rnd.random(), 0.5) for i in range(200)]
    points = [(i, 33 + rnd.random(), -84 + rnd.random()) for i in range(1500)] + [(2000, float("nan"), -84.0), (2001, 33.5, None)]
    _, got = lookup(spark, points, rows, k=7, max_miles=40.0, tree_bytes=tree_bytes)
    assert got.pop(2000) == got.pop(2001) == []
    assert got == brute_force(points[:-2], rows, 7, 40.0)


def test_no_stations_and_later_filters(spark):
    points = [(1, 33.0, -84.0), (2, 34.0, -84.0)]
    frame = spark.createDataFrame([], "station_id long, lat double, lon double, probability double")
    index = ns.build_station_index(frame, ["probability"])
    found = ns.nearest_stations(spark.createDataFrame(points, "i long, lat double, lon double"), index, F.col("lat"), F.col("lon"))
    assert found.where(F.size("neighbours") == 0).count() == 2
    # a filter on the result is not pushed into the search, which would then run twice
    assert found.where(F.size("neighbours") > 0)._jdf.queryExecution().optimizedPlan().toString().count("search(") == 1
