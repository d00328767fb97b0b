"""Whole jobs: training with artifacts, trip scoring, streams, plans."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tripflow.operators import live
from tripflow.operators.nearest_station import build_station_index
from tripflow.operators.routes import normalise_routes
from tripflow.plans import training, trips
from tripflow.schemas import FORECAST_LOG, HEARTBEAT_LOG, INCIDENT_LOG, LABEL, RUN_RECORD
from tripflow.operators.routes import empty_routes
from tripflow.sources import commits
from tripflow.sources.logs import append_logs, prune_log, read_log
from tripflow.sources.requests import with_defaults
from tripflow.streaming import door
from tripflow.streaming.ingest import ingest_stream, landed_runs, log_rows
from tripflow.streaming.live_state import refresh_live_state
from tripflow.streaming.score import score_stream


@pytest.fixture(scope="module")
def index(spark):
    stations = spark.createDataFrame([(1, 33.5, -84.5, 0.5), (2, 33.6, -84.5, 0.5)], "station_id long, lat double, lon double, probability double")
    return build_station_index(stations, ["probability"])


REQUEST = "trip_id long, request_ts timestamp, roadway string, origin struct<lat:double,lon:double>, destination struct<lat:double,lon:double>, live boolean, router string, polyline_format string"


def request(i, hour=12, live=True, router="auto", fmt="encoded", lat=33.0):
    return (i, dt.datetime(2024, 1, 1, hour), " I-75 ", (lat, -84.0), (lat + 1, -85.0), live, router, fmt)


def logs(spark):
    forecasts = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), "2024-01-01T12:00:00+00:00", "Rain", "25 mph"), (dt.datetime(2024, 1, 1), "2024-01-01T20:00:00+00:00", "Sunny", "5 mph")],
        "snapshot_utc timestamp, startTime string, shortForecast string, windSpeed string",
    )
    incidents = spark.createDataFrame([("1",), ("x",)], "lanesBlocked string")
    return forecasts, incidents


def test_trip_results(spark, index):
    rows = [request(1), request(2, hour=8), request(3, live=False), request(4, lat=60.0), request(5, router="none", fmt="geojson"), request(6, router="ors")]
    responses = [
        (1, "google", json.dumps({"routes": [{"legs": [{"distance": {"value": 160934.4}, "duration": {"value": 60}}, {}], "overview_polyline": {"points": "xyz"}}]}), None),
        (6, "ors", None, "timeout"),
    ]
    routes = normalise_routes(spark.createDataFrame(responses, "trip_id long, provider string, body string, error string"))
    frame = with_defaults(spark.createDataFrame(rows, REQUEST))
    scored = trips.score_trips(frame, index, *logs(spark), routes)
    got = {r["trip_id"]: r for r in trips.trip_records(scored).collect()}
    assert got[1]["speed"]["probability_after_all_adjustments"] == pytest.approx(0.5 + 0.11 + 0.15)
    assert got[1]["live"]["nws_desc"] == "rain" and got[1]["live"]["ga511_events"] == 2
    assert got[1]["route"]["provider"] == "google" and got[1]["route"]["distance_miles"] == 100.0
    assert got[1]["route"]["polyline"]["encoded"] == "xyz" and got[1]["route"]["base_duration_minutes"] == 1.0
    assert got[1]["eta"]["hours"] == pytest.approx(100 / (70 * (1 - 0.4 * 0.76)), abs=1e-3)
    assert got[2]["speed"]["probability_after_all_adjustments"] == pytest.approx(0.86)
    assert got[3]["speed"]["probability_after_all_adjustments"] == 0.5 and got[3]["live"]["live_used"] is False
    assert got[3]["live"]["nws_bump"] is None
    assert got[4]["eta"]["minutes"] is None and got[4]["route"]["provider"] == "fallback"
    assert got[5]["route"]["geojson"]["coordinates"] == [[-84.0, 33.0], [-85.0, 34.0]]
    assert got[5]["route"]["polyline"] is None and got[5]["route"]["error"] == "routing disabled"
    assert got[6]["route"]["provider"] == "fallback" and got[6]["route"]["error"] == "timeout"


def test_trips_without_logs(spark, index):
    scored = trips.score_trips(with_defaults(spark.createDataFrame([request(1)], REQUEST)), index)
    row = trips.trip_records(scored).first()
    assert row["speed"]["probability_after_all_adjustments"] == 0.5 and row["live"]["live_used"] is False


def test_empty_incident_log_adds_nothing(spark):
    empty = live.incident_summary(spark.createDataFrame([], "lanesBlocked string"))
    assert spark.range(1).select(live.summary_bump(empty).alias("s")).first()["s"]["bump"] is None


def test_trip_plan_has_no_python_and_no_nested_loop(spark, index):
    scored = trips.score_trips(with_defaults(spark.createDataFrame([request(1)], REQUEST)), index, *logs(spark))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    for word in ("NestedLoop", "Cartesian", "PythonUDF", "EvalPython", "SortMergeJoin", "Window"):
        assert word not in plan
    # lookups only: the requests themselves are never shuffled
    assert "hashpartitioning" not in plan


def test_training_and_artifacts(spark, tmp_path):
    rows = spark.range(300).select(
        F.col("id").cast("string").alias("STATION_ID"),
        (F.col("id") % 100 + 0.0).alias("AADT_LATEST"),
        F.col("id").alias("AADT_2024"),
        (F.col("id") % 100 + 1.0).alias("AADT_MEAN_3YR"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 7 / 10.0).alias("KFACTOR"),
        F.lit(33.0).alias("LAT"),
        F.lit(-84.0).alias("LON"),
        F.when(F.col("id") % 9 != 0, F.concat(F.lit("F'"), (F.col("id") % 3).cast("string"))).alias("FUNCTIONAL_CLASS"),
    )
    model, scored = training.train(rows, trees=3)
    metrics = training.quality(scored)
    assert metrics["ROC_AUC"] > 0.95 and metrics["PR_AUC"] > 0.9 and scored.count() == 60
    folder = str(tmp_path / "artifacts")
    training.save_artifacts(spark, folder, model, training.contract_record(rows), metrics)
    loaded, contract = training.load_artifacts(spark, folder)
    assert contract["label"] == LABEL and contract["latest_year"] == 2024
    before = {r["station_id"]: r["probability"] for r in training.score_stations(rows, model).collect()}
    after = {r["station_id"]: r["probability"] for r in training.score_stations(rows, loaded).collect()}
    assert before == after and all(0 <= p <= 1 for p in after.values())
    unseen = rows.limit(1).withColumn("FUNCTIONAL_CLASS", F.lit("never seen"))
    assert training.score_stations(unseen, loaded).count() == 1


def run_record(i, **extra):
    doc = {
        "snapshot_utc": f"2024-01-01T00:{i:02d}:00Z",
        "forecast": json.dumps({"properties": {"periods": [
            {"startTime": f"2024-01-01T00:{i + 1:02d}:00+00:00", "endTime": "2024-01-01T02:00:00+00:00", "shortForecast": "later"},
            {"startTime": "2023-12-31T23:00:00+00:00", "endTime": "2024-01-01T01:00:00+00:00", "shortForecast": " Light drizzle ", "temperature": 50},
        ]}}),
        "alerts": '{"features": []}',
        "incidents": json.dumps({"events": [{"id": i}, {"id": i + 100}]}),
    }
    return json.dumps(doc | extra)


def test_stream_ingest_is_exactly_once(spark, tmp_path):
    landing, out, mark = tmp_path / "landing", str(tmp_path / "logs"), str(tmp_path / "mark")
    landing.mkdir()

    def run():
        ingest_stream(landed_runs(spark, str(landing)), out, mark).awaitTermination()

    (landing / "a.json").write_text(run_record(0) + "\n" + run_record(5))
    run()
    failed = run_record(10, forecast=None, alerts=None, weather_error="down", incidents=None, incident_error="503")
    (landing / "b.json").write_text(failed)
    run()
    run()  # nothing new: adds nothing
    incidents = read_log(spark, f"{out}/incidents", INCIDENT_LOG)
    assert sorted(int(r["id"]) for r in incidents.collect()) == [0, 5, 100, 105]
    beats = read_log(spark, f"{out}/heartbeats", HEARTBEAT_LOG).orderBy("snapshot_utc").collect()
    assert [(b["nws_ok"], b["wx_short"], b["wx_precip_flag"], b["nws_periods_written"], b["ga511_events_count"], b["errors"]) for b in beats] == [
        (True, "Light drizzle", True, 2, 2, ""),
        (True, "Light drizzle", True, 2, 2, ""),
        (False, None, None, 0, 0, "down; 503"),
    ]


def test_streams_share_results_and_take_routes(spark, index, tmp_path):
    """Two streams number their batches from 0; both keep their rows, and routes reach the records."""
    frame = spark.createDataFrame([request(i) for i in range(6)], REQUEST)
    frame.write.parquet(str(tmp_path / "in"))
    routes = spark.createDataFrame(
        [(2, "ors", True, 7.5, 12.0, [(33.0, -84.0), (33.1, -84.1)], "abc", None)], empty_routes(spark).schema
    )
    for name in ("a", "b"):
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        score_stream(
            with_defaults(stream), index, str(tmp_path / "out"), str(tmp_path / name), routes=lambda: routes
        ).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 12 and got.select("writer").distinct().count() == 2
    batch = trips.trip_records(trips.score_trips(with_defaults(frame), index, None, None, routes))
    columns = batch.columns
    assert sorted(map(str, got.select(*columns).distinct().collect())) == sorted(map(str, batch.collect()))


def test_stream_scores_equal_batch_scores(spark, index, tmp_path):
    frame = spark.createDataFrame([request(i, hour=i % 24) for i in range(30)], REQUEST)
    for part in (0, 1):
        frame.where(F.col("trip_id") % 2 == part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        forecasts, incidents = logs(spark)
        score_stream(with_defaults(stream), index, str(tmp_path / "out"), str(tmp_path / "mark"), lambda: forecasts, lambda: incidents).awaitTermination()
    batch = trips.trip_records(trips.score_trips(with_defaults(frame), index, *logs(spark)))
    pick = ["trip_id", "eta.minutes", "speed.effective_speed_mph"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*pick)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*pick).collect()))


def test_request_door_replays_without_doubles_or_losses(spark, index, tmp_path, monkeypatch):
    good = {"roadway": "I-75", "origin": {"lat": 33.0, "lon": -84.0}, "destination": {"lat": 34.0, "lon": -85.0}, "live": False}
    far = good | {"origin": {"lat": 60.0, "lon": -84.0}, "destination": {"lat": 61.0, "lon": -84.0}}
    landing, root = tmp_path / "landing", str(tmp_path / "tables")
    landing.mkdir()

    def land(name, *rows):
        lines = [json.dumps({"trip_id": i, "request_ts": "2024-01-01T12:00:00Z", "body": b if isinstance(b, str) else json.dumps(b)}) for i, b in rows]
        (landing / name).write_text("\n".join(lines))

    def serve():
        door.serve_requests(door.landed_bodies(spark, str(landing)), index, root, str(tmp_path / "mark"), model="m1").awaitTermination()

    def told():
        tables = (door.results(spark, root), door.unscored(spark, root), door.rejects(spark, root))
        return [sorted(r["trip_id"] for r in t.collect()) for t in tables]

    land("a.json", (1, good), (2, far), (3, "{broken"), (4, {"roadway": "x"}))
    serve()
    assert told() == [[1], [2], [3, 4]]
    # the second table's write fails: nothing of the batch is seen, though trips are written
    land("b.json", (5, good), (6, far), (7, "no"))
    write, calls = commits.write_leaves, []

    def failing(rows, folder, table, *rest):
        calls.append(table)
        if table == door.REJECTS:
            raise OSError("disk full")
        return write(rows, folder, table, *rest)

    monkeypatch.setattr(commits, "write_leaves", failing)
    with pytest.raises(Exception, match="disk full"):
        serve()
    assert calls == [door.TRIPS, door.REJECTS] and told() == [[1], [2], [3, 4]]
    monkeypatch.setattr(commits, "write_leaves", write)
    serve()
    serve()
    assert told() == [[1, 5], [2, 6], [3, 4, 7]]
    row = door.results(spark, root).where("trip_id = 5").first()
    assert row["model"] == "m1" and row["inputs"]["roadway"] == "I-75" and row["notes"] == []


def test_heartbeats_are_made_in_place(spark):
    doc = json.loads(run_record(0))
    rows = [json.dumps(doc), json.dumps(doc | {"incidents": "[[[[[[[[[[{\"id\": 1}]]]]]]]]]]", "weather_error": "late"})]
    records = spark.read.schema(RUN_RECORD).json(spark.sparkContext.parallelize(rows))
    beats = log_rows(records)["heartbeats"]
    # two collectors in one second keep their own counts, and nothing is joined or shuffled
    assert sorted((r["ga511_events_count"], r["nws_periods_written"], r["errors"]) for r in beats.collect()) == [(1, 2, "late"), (2, 2, "")]
    plan = beats._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert log_rows(records)["incidents"].count() == 3


def test_live_state_reads_only_new_folders(spark, tmp_path):
    folder, root = str(tmp_path / "logs"), str(tmp_path / "state")

    def land(batch, day, lanes, short):
        at = dt.datetime(2024, 1, day)
        forecasts = spark.createDataFrame([(at, "2024-01-05T00:00:00Z", short), (at, f"2024-01-0{day}T06:00:00Z", "Sunny")], "snapshot_utc timestamp, startTime string, shortForecast string")
        incidents = spark.createDataFrame([(at, x) for x in lanes], "snapshot_utc timestamp, lanesBlocked string")
        append_logs({"forecasts": (forecasts, FORECAST_LOG), "incidents": (incidents, INCIDENT_LOG)}, folder, batch, "s")

    def told(state):
        moments = {r["at"]: (r["row"]["description"], r["row"]["bump"]) for r in state.moments.collect()}
        return moments, tuple(state.summary.first())

    def anew():
        whole = refresh_live_state(spark, folder, str(tmp_path / f"whole{len(list(tmp_path.iterdir()))}"))
        return told(whole)

    assert told(refresh_live_state(spark, folder, root)) == ({}, (0, False, False))
    land(0, 1, ["0", "1"], "Rain")
    first = refresh_live_state(spark, folder, root)
    assert told(first) == anew() and told(first)[1] == (2, True, False) and len(first.taken) == 2
    land(1, 2, ["2"], "Snow")
    second = refresh_live_state(spark, folder, root)
    # only the second batch's folders were read, and the newer copy of a forecast won
    assert len(second.taken) == 2 and all("batch_id=1" in p for p in second.taken) and told(second) == anew()
    assert told(second)[1] == (3, True, True) and ("snow", 0.08) in told(second)[0].values()
    assert refresh_live_state(spark, folder, root).taken == []
    # a batch that ran again, and retention, take folders away: the state is made anew
    land(1, 2, ["0"], "Fog")
    third = refresh_live_state(spark, folder, root)
    assert len(third.taken) == 4 and told(third) == anew() and told(third)[1] == (3, True, False)
    prune_log(spark, f"{folder}/incidents", INCIDENT_LOG, "2024-01-02 12:00:00", days=1)
    assert told(refresh_live_state(spark, folder, root)) == anew() and anew()[1] == (1, False, False)


def test_stream_scores_from_the_live_state(spark, index, tmp_path):
    frame = spark.createDataFrame([request(i, hour=i % 24) for i in range(10)], REQUEST)
    frame.write.parquet(str(tmp_path / "in"))
    forecasts, incidents = logs(spark)
    stamped = incidents.withColumn("snapshot_utc", F.lit("2024-01-01").cast("timestamp"))
    folder = str(tmp_path / "logs")
    append_logs({"forecasts": (forecasts, FORECAST_LOG), "incidents": (stamped, INCIDENT_LOG)}, folder)
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    live_of = lambda: refresh_live_state(spark, folder, str(tmp_path / "state"))
    score_stream(with_defaults(stream), index, str(tmp_path / "out"), str(tmp_path / "mark"), live=live_of).awaitTermination()
    batch = trips.trip_records(trips.score_trips(with_defaults(frame), index, forecasts, incidents))
    got = spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_batch_of_one_file_is_dealt_over_tasks(spark, tmp_path):
    from tripflow.schemas import HEARTBEAT_LOG
    from tripflow.sources import logs
    from tripflow.streaming.ingest import ingest_stream, landed_runs

    line = '{"snapshot_utc": "2024-01-02T03:%02d:00Z", "forecast": null, "alerts": "[]", "incidents": "{\\"events\\": [{\\"id\\": 1}]}"}'
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "one.json").write_text("\n".join(line % i for i in range(40)))
    ingest_stream(landed_runs(spark, str(tmp_path / "runs")), str(tmp_path / "logs"), str(tmp_path / "checkpoint")).awaitTermination()
    beats = logs.read_log(spark, str(tmp_path / "logs" / "heartbeats"), HEARTBEAT_LOG)
    assert beats.count() == 40 and beats.agg(F.sum("ga511_events_count")).first()[0] == 40
    assert beats.select(F.input_file_name()).distinct().count() > 1
