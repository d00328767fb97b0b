import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tripflow.schemas import INCIDENT_LOG
from tripflow.sources import commits, logs, payloads, requests, station_files


def bodies(spark, *docs):
    rows = [("2024-01-01 00:00:00", d if isinstance(d, str) else json.dumps(d)) for d in docs]
    return spark.createDataFrame(rows, "s string, body string").select(F.col("s").cast("timestamp").alias("snapshot_utc"), "body")


def test_headers():
    assert station_files.clean_header(" aadt 2019 (est.) ") == "AADT_2019_EST"


def test_header_collision(spark):
    with pytest.raises(ValueError, match="collide"):
        station_files.clean_headers(spark.createDataFrame([("a", "b")], "`a b` string, `A_B` string"))


def test_csv_stays_text(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Station ID,TruckPct 2010\n007,1.50\n,\n")
    rows = station_files.rename_truck_columns(station_files.read_wide_csv(spark, str(tmp_path / "s.csv")))
    assert [tuple(r) for r in rows.collect()] == [("007", "1.50"), (None, None)]
    assert rows.columns == ["STATION_ID", "TRUCK_2010"]


def test_year_columns():
    assert station_files.volume_years(["AADT_2020", "AADT_2018", "AADT_20", "AADT_2019_OLD"]) == [2018, 2020]
    assert station_files.lost_years(["AADT_2019_OLD", "AADT_2019_NEW", "AADT_2020"]) == [2019]
    with pytest.raises(ValueError):
        station_files.volume_years(["TRUCK_2020"])


def test_flatten_shapes(spark):
    docs = [
        {"events": [{"id": 1}, 5, None, [{"id": 2}]]},
        {"data": {"event": {"id": 3}}},
        {"event": {"id": 4}, "events": {"id": 5}},
        {"events": None, "id": 6},
        [],
        "not json",
        {"id": 7},
        [[{"id": 8}], "x"],
    ]
    got = payloads.flatten_objects(bodies(spark, *docs)).select(payloads.text_at("event", "id").alias("id"))
    assert sorted(int(r["id"]) for r in got.collect()) == [1, 2, 3, 5, 7, 8]


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 17, 30])
def test_flatten_opens_any_depth(spark, depth):
    wrapped, listed = {"id": 1}, {"id": 2}
    for _ in range(depth):
        wrapped, listed = {"data": wrapped}, [listed]
    got = payloads.flatten_objects(bodies(spark, wrapped, listed, {"id": 3})).select(payloads.text_at("event", "id").alias("id"))
    assert sorted(int(r["id"]) for r in got.collect()) == [1, 2, 3]


def test_incident_coordinates(spark):
    docs = [
        {"id": 1, "lat": "33.5", "lon": -84},
        {"id": 2, "lat": 1, "location": {"latitude": 2, "longitude": 3}},
        {"id": 3, "geo": {"lat": 4}, "geometry": {"coordinates": [5, 6]}},
        {"id": 4, "lat": "x", "lon": 7},
        {"id": 5, "latitude": "", "lat": "null", "Latitude": 0, "X": 0},
        {"id": 6, "lat": 9},
    ]
    rows = {r["id"]: (r["lat"], r["lon"]) for r in payloads.incident_rows(payloads.flatten_objects(bodies(spark, *docs))).collect()}
    assert rows == {
        "1": (33.5, -84.0), "2": (2.0, 3.0), "3": (4.0, 5.0), "4": (None, None), "5": (0.0, 0.0), "6": (None, None),
    }


def test_incident_fields(spark):
    doc = {"eventId": 0, "typeDesc": "Crash", "title": "", "description": "both", "lanes": 0, "lanesAffected": 2, "StartTime": "s", "road": "I-75", "dir": "N"}
    row = payloads.incident_rows(payloads.flatten_objects(bodies(spark, doc))).first()
    assert (row["id"], row["type"], row["headline"], row["lanesBlocked"]) == ("0", "Crash", "both", "0")
    assert (row["startTime"], row["roadName"], row["direction"], row["status"]) == ("s", "I-75", "N", None)


def test_alerts(spark):
    docs = [{"features": [{"id": "a", "properties": {"event": "Flood"}}, 3]}, [{"id": "b", "properties": 4}], {"features": None}]
    got = [(r["id"], r["event"]) for r in payloads.alert_rows(bodies(spark, *docs)).orderBy("id").collect()]
    assert got == [("a", "Flood"), ("b", None)]


def test_forecast_periods(spark):
    docs = [{"properties": {"periods": [{"startTime": "t", "temperature": 61, "windSpeed": "5 mph"}, {}]}}, {"properties": {}}, "oops"]
    rows = payloads.forecast_rows(bodies(spark, *docs)).orderBy("position").collect()
    assert [(r["startTime"], r["temperature"], r["windSpeed"]) for r in rows] == [("t", 61.0, "5 mph"), (None, None, None)]


def test_payload_files(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "features": []\n}')
    row = payloads.read_payload_files(spark, str(tmp_path)).first()
    assert json.loads(row["body"]) == {"features": []} and row["snapshot_utc"] is not None


def test_missing_log_is_empty_and_append_keeps_order(spark, tmp_path):
    path = str(tmp_path / "log")
    assert logs.read_log(spark, path, INCIDENT_LOG).count() == 0
    rows = bodies(spark, "x").select("snapshot_utc", F.lit("1").alias("id"), F.lit(1).alias("surplus"))
    logs.append_log(rows, path, INCIDENT_LOG)
    logs.append_log(rows, path, INCIDENT_LOG)
    back = logs.read_log(spark, path, INCIDENT_LOG)
    assert back.columns[:3] == ["snapshot_utc", "id", "type"] and "surplus" not in back.columns
    assert back.count() == 2  # no deduplication


def test_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = bodies(spark, "x").select("snapshot_utc", F.lit("1").alias("id"))
    for batch in (0, 0, 1):
        logs.append_log(rows, path, INCIDENT_LOG, batch)
    assert logs.read_log(spark, path, INCIDENT_LOG).count() == 2


def test_writers_keep_to_their_own_rows(spark, tmp_path):
    path = str(tmp_path / "logs" / "incidents")
    rows = bodies(spark, "x").select("snapshot_utc", F.lit("1").alias("id"))
    for writer in ("a", "b/c=d", "a"):
        logs.append_log(rows, path, INCIDENT_LOG, 0, writer)
    logs.append_log(rows, path, INCIDENT_LOG)
    assert logs.read_log(spark, path, INCIDENT_LOG).count() == 3
    # retention leaves rows with their writers, so a batch that is run again replaces its own
    logs.prune_log(spark, path, INCIDENT_LOG, "2024-01-02 00:00:00", days=3000)
    logs.append_log(rows, path, INCIDENT_LOG, 0, "b/c=d")
    assert logs.read_log(spark, path, INCIDENT_LOG).count() == 3


def incident_times(spark, *times):
    return spark.createDataFrame([(t, str(i)) for i, t in enumerate(times)], "snapshot_utc timestamp, id string")


def test_retention_writes_the_cutoff_day_only(spark, tmp_path):
    path = str(tmp_path / "logs" / "incidents")
    day = [dt.datetime(2024, 1, d, h) for d in (1, 2, 3) for h in (6, 18)]
    for batch in (0, 1):
        logs.append_log(incident_times(spark, *day, None), path, INCIDENT_LOG, batch, "s")
    before = {x.path: x for x in commits.live_leaves(spark, str(tmp_path / "logs"))[1]}
    logs.prune_log(spark, path, INCIDENT_LOG, "2024-01-12 12:00:00", days=10)
    after = {x.path: x for x in commits.live_leaves(spark, str(tmp_path / "logs"))[1]}
    assert sorted(r["id"] for r in logs.read_log(spark, path, INCIDENT_LOG).collect()) == ["3", "3", "4", "4", "5", "5"]
    # the third day's folders are the same ones; the second day's belong to the same batches
    assert {p for p, x in before.items() if x.key == "2024-01-03"} == {p for p, x in after.items() if x.key == "2024-01-03"}
    assert sorted((x.key, x.batch) for x in after.values()) == [("2024-01-02", "0"), ("2024-01-02", "1"), ("2024-01-03", "0"), ("2024-01-03", "1")]
    logs.append_log(incident_times(spark, *day), path, INCIDENT_LOG, 1, "s")
    assert logs.read_log(spark, path, INCIDENT_LOG).count() == 3 + 6
    since = logs.read_log(spark, path, INCIDENT_LOG, F.lit("2024-01-03").cast("timestamp"))
    assert since.count() == 4


def test_changes_that_meet_are_all_kept(spark, tmp_path):
    root = str(tmp_path / "logs")
    path = f"{root}/incidents"
    day = [dt.datetime(2024, 1, d, 18) for d in (1, 2, 3)]
    for batch in (0, 1):
        logs.append_log(incident_times(spark, *day), path, INCIDENT_LOG, batch, "s")

    def meanwhile():
        logs.append_log(incident_times(spark, *day), path, INCIDENT_LOG, 0, "s")
        logs.append_log(incident_times(spark, *day), path, INCIDENT_LOG, 7, "s")

    logs.prune_log(spark, path, INCIDENT_LOG, "2024-01-12 12:00:00", days=10, before_commit=meanwhile)
    live = commits.live_leaves(spark, root)[1]
    # batch 1 was cut; batch 0 was replaced and batch 7 added while it was read, they go next time
    assert sorted((x.batch, x.key[-1]) for x in live) == [("0", "1"), ("0", "2"), ("0", "3"), ("1", "2"), ("1", "3"), ("7", "1"), ("7", "2"), ("7", "3")]
    assert logs.read_log(spark, path, INCIDENT_LOG).count() == 8
    tried = []

    def change(leaves):
        if not tried:
            commits.commit(spark, root, lambda x: x[1:])
        tried.append(len(leaves))
        return leaves[1:]

    commits.commit(spark, root, change)
    assert tried == [8, 7] and len(commits.live_leaves(spark, root)[1]) == 6


def test_tables_of_a_batch_appear_together(spark, tmp_path):
    root = str(tmp_path / "root")
    one, two = incident_times(spark, dt.datetime(2024, 1, 1)), spark.range(3)
    commits.write_batch(root, {"one": (one, []), "two": (two, [])}, "w", 0)
    broken = spark.range(1).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        commits.write_batch(root, {"one": (one.union(one), []), "two": (broken, [])}, "w", 1)
    assert commits.read_table(spark, root, "one", "id string").count() == 1
    commits.write_batch(root, {"one": (one.union(one), []), "two": (two, [])}, "w", 1)
    assert commits.read_table(spark, root, "one", "id string").count() == 3 and commits.read_table(spark, root, "two", "id long").count() == 6


def test_pruning_skips_old_days(spark, tmp_path):
    path = str(tmp_path / "logs" / "incidents")
    logs.append_log(incident_times(spark, dt.datetime(2022, 1, 1), dt.datetime(2023, 1, 1), dt.datetime(2023, 1, 2)), path, INCIDENT_LOG)
    read = logs.read_log(spark, path, INCIDENT_LOG, F.lit("2023-01-01 12:00:00").cast("timestamp"))
    assert len(read.inputFiles()) == 2 and not any("2022-01-01" in f for f in read.inputFiles())
    assert sorted(r["id"] for r in read.collect()) == ["1", "2"]



@pytest.mark.parametrize("around", ["\t", "\n", "\u00a0 ", " \u3000"])
def test_all_white_space_is_stripped(spark, around):
    from tripflow.functions.coerce import strip

    row = spark.createDataFrame([(f"{around}I-75 N{around}",)], "t string").select(strip(F.col("t"))).first()
    assert row[0] == "I-75 N"


def test_keep_recent_drops_bad_dates(spark):
    rows = spark.createDataFrame([("2024-01-01T00:00:00+00:00",), ("2023-01-01T00:00:00+00:00",), ("junk",), (None,)], "snapshot_utc string")
    assert logs.keep_recent(rows, "snapshot_utc", "2024-03-01 00:00:00").count() == 1


def test_record_roundtrip(spark, tmp_path):
    logs.write_record(spark, {"a": [1, 2], "b": "x"}, str(tmp_path / "r"))
    assert logs.read_record(spark, str(tmp_path / "r")) == {"a": [1, 2], "b": "x"}


GOOD = {"roadway": " I-75 ", "origin": {"lat": 33, "lon": "-84"}, "destination": {"lat": 34, "lon": -85}}


@pytest.mark.parametrize(
    "body, expected",
    [
        (GOOD, ("I-75", 0, True, "auto", "encoded")),
        (GOOD | {"leave_in": 7}, ("I-75", 7, True, "auto", "encoded")),
        (GOOD | {"leave_in_minutes": None, "leave_in": 7}, ("I-75", 0, True, "auto", "encoded")),
        (GOOD | {"leave_in_minutes": "15", "live": "false"}, ("I-75", 15, True, "auto", "encoded")),
        (GOOD | {"leave_in_minutes": 15.9, "live": 0}, ("I-75", 15, False, "auto", "encoded")),
        (GOOD | {"live": None, "router": "none", "polyline_format": "geojson"}, ("I-75", 0, False, "none", "geojson")),
        (GOOD | {"live": "", "leave_in_minutes": ""}, ("I-75", 0, False, "auto", "encoded")),
        ("{", requests.BAD_JSON),
        ({}, requests.BAD_PAYLOAD),
        ([], requests.BAD_PAYLOAD),
        (GOOD | {"origin": {"lat": "x", "lon": 1}}, requests.BAD_PAYLOAD),
        (GOOD | {"leave_in": "soon"}, requests.BAD_LEAVE_IN),
    ],
)
def test_requests(spark, body, expected):
    text = body if isinstance(body, str) else json.dumps(body)
    rows = spark.createDataFrame([(1, text)], "trip_id long, body string").withColumn("request_ts", F.current_timestamp())
    accepted, rejected = requests.split_requests(rows)
    if isinstance(expected, str):
        assert accepted.count() == 0 and rejected.first()["reason"] == expected
    else:
        r = accepted.first()
        assert rejected.count() == 0
        assert (r["roadway"], r["leave_in_minutes"], r["live"], r["router"], r["polyline_format"]) == expected
