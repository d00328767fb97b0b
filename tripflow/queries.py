"""Every operator as a query over the provided tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow import fixtures as fx
from tripflow.functions import coerce, geo, lines, scoring
from tripflow.operators import live, metrics, nearest_time, ranking, routes, split
from tripflow.operators import stations as st
from tripflow.operators.impute import fill, fit_fill_values
from tripflow.operators.joins import null_safe_join
from tripflow.operators.nearest_station import (
    StationIndex,
    build_station_index,
    load_station_index,
    nearest_stations,
    neighbour_rows,
    save_station_index,
)
from tripflow.plans import training, trips
from tripflow.schemas import CATEGORICAL_FEATURES, FORECAST_LOG, HEARTBEAT_LOG, INCIDENT_LOG, LABEL, NUMERIC_FEATURES
from tripflow.session import new_folder
from tripflow.sources import logs, payloads, requests, station_files
from tripflow.streaming import door
from tripflow.streaming.live_state import refresh_live_state
from tripflow.streaming.ingest import ingest_stream, log_rows
from tripflow.streaming.score import score_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SLOPE_DIGITS = 6


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(*names: str, digits: int = SLOPE_DIGITS) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


def _text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def station_index(spark: SparkSession, sf_dir: str) -> StationIndex:
    return build_station_index(fx.stations(spark, sf_dir), ["probability"])


def station_table(spark: SparkSession, sf_dir: str, prefer: str = "training") -> DataFrame:
    return st.station_table(
        fx.volumes_old(spark, sf_dir), fx.volumes_new(spark, sf_dir), fx.annual(spark, sf_dir), prefer
    )


# ---- station tables -------------------------------------------------------


@query
def header_clean(spark, sf_dir):
    clean = station_files.clean_headers(fx.volumes_new(spark, sf_dir))
    return clean.select("STATION_ID", "FUNCTIONAL_CLASS", *[f"AADT_{y}" for y in fx.NEW_YEARS])


@query
def csv_scan(spark, sf_dir):
    path = new_folder(spark, "csv")
    fx.volumes_old(spark, sf_dir).write.option("header", True).csv(path)
    old = station_files.rename_truck_columns(station_files.read_wide_csv(spark, path))
    return old.select(
        "STATION_ID",
        "FUNCTIONAL_CLASS",
        *[station_files.number_column(old, f"AADT_{y}").alias(f"AADT_{y}") for y in fx.OLD_YEARS],
        *[F.round(station_files.number_column(old, f"TRUCK_{y}"), 6).alias(f"TRUCK_{y}") for y in fx.OLD_YEARS],
    )


@query
def numeric_coerce(spark, sf_dir):
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("string")
    raw = (
        F.when(key % 8 == 0, F.concat(F.lit("  "), price, F.lit(" ")))
        .when(key % 8 == 1, F.concat(price, F.lit("d")))
        .when(key % 8 == 2, "1,234")
        .when(key % 8 == 3, "NaN")
        .when(key % 8 == 4, "")
        .when(key % 8 == 5, F.concat(F.lit("0x1p"), (key % 9).cast("string")))
        .otherwise(price)
    )
    return fx.table(spark, sf_dir, "orders").select(key.alias("id"), coerce.to_number(raw).alias("number"))


@query
def coordinate_choice(spark, sf_dir):
    key = F.col("s_suppkey")
    both = fx.table(spark, sf_dir, "supplier").select(
        key.alias("STATION_ID"),
        (F.lit(30) + key % 7).cast("string").alias("LAT"),
        (F.lit(40) + key % 5).cast("string").alias("LATITUDE"),
        (F.lit(-80) - key % 3).cast("string").alias("LONG"),
        F.lit("x").alias("LONGITUDE"),
        F.lit("1").alias("AADT_2000"),
    )
    serving = st.typed_stations(both, "serving").select("STATION_ID", F.col("LAT").alias("serving_lat"), F.col("LON").alias("lon"))
    trained = st.typed_stations(both, "training").select("STATION_ID", F.col("LAT").alias("training_lat"))
    return serving.join(trained, "STATION_ID").withColumnRenamed("STATION_ID", "station_id")


@query
def station_full_join(spark, sf_dir):
    old = station_files.clean_headers(fx.volumes_old(spark, sf_dir))
    new = station_files.clean_headers(fx.volumes_new(spark, sf_dir))
    joined = null_safe_join(old, new, st.STATION_KEYS, "full")
    return joined.select(*st.STATION_KEYS, "AADT_1995", "AADT_1998", "AADT_1999", "AADT_2001", "LATITUDE")


@query
def typed_keys(spark, sf_dir):
    """Keys that are written in several ways, words for missing values, and a year that both tables have."""
    old, new, annual = fx.spelled_tables(spark, sf_dir)
    merged = st.merge_stations(old, new, annual)
    lost = ",".join(str(y) for y in st.merge_report(merged)["lost_years"])
    return merged.select(
        "STATION_ID", "FUNCTIONAL_CLASS", "AADT_1995", "AADT_2001", "KFACTOR", "STATION_TYPE", F.lit(lost).alias("lost_years")
    )


@query
def attribute_distinct(spark, sf_dir):
    return st.attribute_rows(station_files.clean_headers(fx.annual(spark, sf_dir)))


@query
def station_attr_join(spark, sf_dir):
    merged = st.merge_stations(fx.volumes_old(spark, sf_dir), fx.volumes_new(spark, sf_dir), fx.annual(spark, sf_dir))
    return merged.select("STATION_ID", "FUNCTIONAL_CLASS", "KFACTOR", "DFACTOR", "STATION_TYPE")


@query
def station_slope(spark, sf_dir):
    return station_table(spark, sf_dir).select("STATION_ID", "STATION_TYPE", *_rounded("AADT_TREND_SLOPE"))


@query
def station_rolling(spark, sf_dir):
    return station_table(spark, sf_dir).select("STATION_ID", "STATION_TYPE", *_rounded("AADT_MEAN_3YR", "AADT_STD_3YR"))


@query
def station_truck_mean(spark, sf_dir):
    return station_table(spark, sf_dir).select("STATION_ID", "STATION_TYPE", *_rounded("TRUCK_PCT_MEAN"))


@query
def station_latest(spark, sf_dir):
    return station_table(spark, sf_dir).select("STATION_ID", "STATION_TYPE", *_rounded("AADT_LATEST", "TRUCK_PCT_LATEST"))


@query
def station_features(spark, sf_dir):
    located = st.located(station_table(spark, sf_dir, "serving"))
    contract = st.feature_contract(located, keep=["STATION_ID"])
    return contract.select("STATION_ID", *_rounded(*NUMERIC_FEATURES), *CATEGORICAL_FEATURES)


@query
def feature_contract(spark, sf_dir):
    partial = fx.stations(spark, sf_dir).select("station_id", F.col("lat").alias("LAT"), F.lit(1).alias("extra"))
    return st.feature_contract(partial, keep=["station_id"])


# ---- training -------------------------------------------------------------


@query
def label_p75(spark, sf_dir):
    rows = training.labelled(station_table(spark, sf_dir))
    return rows.select("STATION_ID", "STATION_TYPE", F.col(LABEL).cast("long").alias("label"))


@query
def stratified_split(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    marked = split.stratified_split(orders, "o_orderstatus", ["o_orderkey"])
    return marked.select("o_orderkey", "is_test")


@query
def impute_median(spark, sf_dir):
    train = training.training_table(station_table(spark, sf_dir)).where(~F.col("is_test"))
    medians = ranking.exact_quantiles(train, NUMERIC_FEATURES, 0.5)
    return medians.select("name", F.round("quantile", 6).alias("median"))


@query
def impute_mode(spark, sf_dir):
    train = training.training_table(station_table(spark, sf_dir)).where(~F.col("is_test"))
    return ranking.modes(train, CATEGORICAL_FEATURES)


@query
def impute_filled(spark, sf_dir):
    table = training.training_table(station_table(spark, sf_dir))
    values = fit_fill_values(table.where(~F.col("is_test")), ["KFACTOR", "AADT_MEAN_3YR"], CATEGORICAL_FEATURES)
    return fill(table, values).groupBy("FUNCTIONAL_CLASS", "STATION_TYPE").agg(
        F.count("*").alias("n"),
        F.round(F.sum("KFACTOR"), 6).alias("k_sum"),
        F.round(F.sum("AADT_MEAN_3YR"), 4).alias("mean_sum"),
    )


def _labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "labels").select(
        F.col("quality").alias("label"), (F.col("doc_id") * 31 % 97 / 97.0).alias("score")
    )


@query
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_labelled_scores(spark, sf_dir), "label", "score").select(*_rounded("roc_auc", digits=9))


@query
def pr_curve(spark, sf_dir):
    curve = metrics.pr_curve(_labelled_scores(spark, sf_dir), "label", "score")
    return curve.select(*_rounded("score", "precision", "recall"))


@query
def pr_auc(spark, sf_dir):
    return metrics.pr_auc(_labelled_scores(spark, sf_dir), "label", "score").select(*_rounded("pr_auc", digits=9))


@query
def classification_report(spark, sf_dir):
    report = metrics.classification_report(_labelled_scores(spark, sf_dir), "label", "score")
    return report.select("row", *_rounded("precision", "recall", "f1"), "support")


@query
def metrics_record(spark, sf_dir):
    """The measures of a scored test set, written as the metrics record and read back."""
    scored = _labelled_scores(spark, sf_dir).select(F.col("label").alias(LABEL), F.col("score").alias("probability"))
    path = new_folder(spark, "metrics")
    logs.write_record(spark, training.quality(scored), path)
    names = {"ROC_AUC": "roc_auc", "PR_AUC": "pr_auc", "0 recall": "recall_0", "1 precision": "precision_1", "1 f1": "f1_1", "1 support": "support_1"}
    return spark.read.json(path).select(*[F.round(F.col(f"`{k}`").cast("double"), 6).alias(v) for k, v in names.items()])


@query
def gbt_scores(spark, sf_dir):
    """Fit on the training part, save, load, score every located station."""
    stations = station_table(spark, sf_dir)
    model, scored = training.train(stations)
    folder = new_folder(spark, "model")
    training.save_artifacts(spark, folder, model, training.contract_record(stations), training.quality(scored))
    loaded, _ = training.load_artifacts(spark, folder)
    return training.score_stations(st.located(stations), loaded)


@query
def model_roundtrip(spark, sf_dir):
    """Every located station: is its score a probability, and is it the same from the model that was saved and loaded."""
    stations = station_table(spark, sf_dir)
    model, scored = training.train(stations)
    folder = new_folder(spark, "model")
    training.save_artifacts(spark, folder, model, training.contract_record(stations), training.quality(scored))
    loaded, _ = training.load_artifacts(spark, folder)
    shaped = st.feature_contract(st.located(stations), keep=["STATION_ID"])
    both = training.with_probability(shaped, model).withColumnRenamed("probability", "fitted")
    both = training.with_probability(both, loaded)
    return both.select(
        "STATION_ID",
        F.col("probability").between(0, 1).alias("in_range"),
        (F.col("probability") == F.col("fitted")).alias("same_after_loading"),
    )


@query
def contract_record(spark, sf_dir):
    folder = new_folder(spark, "contract")
    logs.write_record(spark, training.contract_record(station_table(spark, sf_dir)), folder)
    return spark.read.json(folder).select(
        F.array_join("numeric_features", ",").alias("numeric_features"),
        F.array_join("categorical_features", ",").alias("categorical_features"),
        "label",
        "label_definition",
        "latest_year",
    )


@query
def onehot_features(spark, sf_dir):
    """Where each filled category has its one in the encoded vector, and how long that is, for both categorical columns."""
    table = training.training_table(station_table(spark, sf_dir))
    train = table.where(~F.col("is_test")).drop("is_test")
    encoded = Pipeline(stages=training.feature_stages(train)).fit(train).transform(table)

    def placed(feature: str) -> DataFrame:
        vector = vector_to_array(f"{feature}_VECTOR")
        return encoded.groupBy(
            F.lit(feature).alias("feature"),
            F.col(f"{feature}_FILLED").alias("category"),
            F.array_position(vector, 1.0).cast("long").alias("position"),
            F.size(vector).cast("long").alias("width"),
        ).agg(F.count("*").alias("n"))

    return placed("FUNCTIONAL_CLASS").union(placed("STATION_TYPE"))


# ---- trips ----------------------------------------------------------------


@query
def request_validate(spark, sf_dir):
    accepted, rejected = requests.split_requests(fx.request_bodies(spark, sf_dir))
    return logs.union_logs(accepted, rejected).select(
        "trip_id",
        "roadway",
        F.col("origin.lat").alias("origin_lat"),
        F.col("destination.lon").alias("destination_lon"),
        "leave_in_minutes",
        "live",
        "router",
        "polyline_format",
        "reason",
    )


@query
def haversine(spark, sf_dir):
    trip = fx.requests(spark, sf_dir)
    lat, lon = trips.trip_midpoint()
    ends = [F.col("origin.lat"), F.col("origin.lon"), F.col("destination.lat"), F.col("destination.lon")]
    return trip.select(
        "trip_id",
        F.round(geo.haversine_miles(*ends), 6).alias("miles"),
        F.round(lat, 6).alias("mid_lat"),
        F.round(lon, 6).alias("mid_lon"),
    )


@query
def freeflow_speed(spark, sf_dir):
    return fx.requests(spark, sf_dir).select(
        "trip_id",
        scoring.freeflow_mph(F.col("roadway")).alias("freeflow_mph"),
        scoring.path_factor(F.col("roadway")).alias("path_factor"),
    )


@query
def knn_stations(spark, sf_dir):
    found = nearest_stations(fx.requests(spark, sf_dir), station_index(spark, sf_dir), *trips.trip_midpoint())
    rows = neighbour_rows(found, ["trip_id"])
    return rows.select("trip_id", F.col("rank").cast("long").alias("rank"), "station_id", *_rounded("dist_miles", "weight"))


@query
def knn_close(spark, sf_dir):
    """Radius of two miles: many trips keep no station, but keep their row."""
    index = build_station_index(fx.stations(spark, sf_dir), ["probability"], max_miles=2.0)
    found = nearest_stations(fx.requests(spark, sf_dir), index, *trips.trip_midpoint())
    return found.select("trip_id", F.coalesce(F.size("neighbours"), F.lit(0)).cast("long").alias("stations"))


@query
def knn_tight_group(spark, sf_dir):
    """All stations within some hundred feet, which most trips see from afar."""
    index = build_station_index(fx.tight_stations(spark, sf_dir), ["probability"], max_miles=60.0)
    found = nearest_stations(fx.requests(spark, sf_dir), index, *trips.trip_midpoint())
    return neighbour_rows(found, ["trip_id"]).select("trip_id", F.col("rank").cast("long").alias("rank"), "station_id", *_rounded("dist_miles"))


@query
def knn_stored_index(spark, sf_dir):
    """A tree that is cut into subtrees, written, read again, and searched."""
    path = new_folder(spark, "stations")
    save_station_index(build_station_index(fx.stations(spark, sf_dir), ["probability"], tree_bytes=2000), path)
    found = nearest_stations(fx.requests(spark, sf_dir), load_station_index(spark, path), *trips.trip_midpoint())
    return found.select("trip_id", F.concat_ws(",", F.transform("neighbours", lambda n: n["station"]["station_id"].cast("string"))).alias("stations"))


@query
def idw_probability(spark, sf_dir):
    scored = trips.base_probability(fx.requests(spark, sf_dir), station_index(spark, sf_dir))
    return scored.select("trip_id", *_rounded("p_base"))


@query
def rush_hour_bump(spark, sf_dir):
    depart = scoring.departure_time(F.col("request_ts"), F.col("leave_in_minutes"))
    local = F.from_utc_timestamp(depart, "America/New_York")
    return fx.requests(spark, sf_dir).select(
        "trip_id", _text(depart).alias("depart_utc"), scoring.rush_hour_bump(local).alias("bump")
    )


@query
def forecast_nearest(spark, sf_dir):
    log = fx.forecast_log(spark, sf_dir)
    index = nearest_time.build_time_index(live.forecast_moments(log))
    found = nearest_time.nearest_in_time(fx.requests(spark, sf_dir), index, F.col("request_ts"))
    return found.select("trip_id", F.col("nearest.at").alias("at_micros"), F.col("nearest.row.description").alias("description"))


@query
def forecast_containing(spark, sf_dir):
    """Per collector run the forecast period in force, else the nearest."""
    records = fx.run_records(fx.events(spark, sf_dir))
    periods = payloads.forecast_rows(records.select("snapshot_utc", F.col("forecast").alias("body")))
    current = live.current_period(periods, ["position", "shortForecast", "temperature"])
    return current.select(
        F.unix_micros("snapshot_utc").alias("at_micros"),
        F.col("period.position").cast("long").alias("position"),
        F.col("period.shortForecast").alias("short"),
        F.col("period.temperature").alias("temperature"),
    )


@query
def weather_bump(spark, sf_dir):
    return fx.events(spark, sf_dir).select(
        "event_id",
        scoring.wind_mph(F.col("wind")).alias("wind"),
        F.round(scoring.weather_bump(F.col("short"), F.col("wind")), 4).alias("bump"),
        scoring.precipitation_flag(F.col("short")).alias("precipitation"),
    )


@query
def incident_summary(spark, sf_dir):
    summary = live.incident_summary(fx.incident_log(spark, sf_dir))
    bump = scoring.incident_bump(F.col("events"), F.col("any_lane"), F.col("two_lanes"))
    return summary.select("events", "any_lane", "two_lanes", F.round(bump, 4).alias("bump"))


@query
def live_bump(spark, sf_dir):
    rows = fx.requests(spark, sf_dir).withColumn("p_time", F.col("trip_id") % 90 / 100.0)
    rows = rows.withColumn("depart_utc", F.col("request_ts"))
    moments, summary = live.forecast_moments(fx.forecast_log(spark, sf_dir)), live.incident_summary(fx.incident_log(spark, sf_dir))
    adjusted = trips.adjusted_for_live(rows, moments, summary)
    return adjusted.select("trip_id", "live.live_used", "live.nws_bump", "live.ga511_bump", "live.ga511_events", *_rounded("p_final"))


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.score_trips(
        requests.with_defaults(fx.requests(spark, sf_dir)),
        station_index(spark, sf_dir),
        fx.forecast_log(spark, sf_dir),
        fx.incident_log(spark, sf_dir),
        routes.normalise_routes(fx.route_responses(spark, sf_dir)),
        region="America/New_York",
    )


@query
def trip_eta(spark, sf_dir):
    """Flagship: requests to probability, speed, distance and ETA."""
    return _trips(spark, sf_dir).select(
        "trip_id",
        *_rounded("p_base", "p_time", "p_final", "effective_mph", digits=5),
        *_rounded("route_miles", "eta_minutes", digits=4),
    )


@query
def trip_record(spark, sf_dir):
    """Nested result record written and read back, then flattened for comparison."""
    path = new_folder(spark, "results")
    logs.write_results(trips.trip_records(_trips(spark, sf_dir)), path)
    return spark.read.parquet(path).select(
        "trip_id",
        F.col("route.provider").alias("provider"),
        "route.distance_miles",
        "route.base_duration_minutes",
        F.col("route.polyline.encoded").alias("encoded"),
        F.to_json("route.geojson.coordinates").alias("coordinates"),
        F.col("route.error").alias("route_error"),
        F.col("speed.probability_after_all_adjustments").alias("probability"),
        F.col("live.live_used").alias("live_used"),
    )


@query
def output_round(spark, sf_dir):
    price = F.col("l_extendedprice")
    return fx.table(spark, sf_dir, "lineitem").groupBy("l_extendedprice").agg(F.count("*").alias("n")).select(
        "l_extendedprice",
        "n",
        coerce.round_half_even(price, 1).alias("one"),
        coerce.round_half_even(price / 1000, 3).alias("three"),
        coerce.round_half_even(-price / 100, 2).alias("two"),
    )


# ---- routes ---------------------------------------------------------------


@query
def route_normalise(spark, sf_dir):
    normal = routes.normalise_routes(fx.route_responses(spark, sf_dir))
    return normal.select(
        "trip_id",
        "provider",
        "ok",
        *_rounded("distance_miles", "duration_minutes"),
        F.size("coordinates").cast("long").alias("points"),
        F.round(F.col("coordinates")[0]["lat"], 6).alias("first_lat"),
        "encoded",
        "error",
    )


@query
def route_fallback(spark, sf_dir):
    normal = routes.normalise_routes(fx.route_responses(spark, sf_dir))
    chosen = routes.route_for(fx.requests(spark, sf_dir), normal)
    return chosen.select(
        "trip_id",
        F.when(F.col("answer.ok"), F.col("answer.provider")).otherwise(routes.FALLBACK).alias("provider"),
        F.round(routes.used_miles(F.lit(1.5)), 6).alias("miles"),
        "route_error",
    )


@query
def route_leg_sum(spark, sf_dir):
    legs = fx.table(spark, sf_dir, "lineitem").withColumn(
        "metres", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_extendedprice"))
    )
    totals = routes.leg_totals(legs, "l_orderkey", "metres", "l_quantity")
    return totals.select("l_orderkey", *_rounded("distance_miles", "duration_minutes"))


@query
def polyline_encode(spark, sf_dir):
    made = routes.lines_from_points(fx.route_points(spark, sf_dir), "route_id", "seq", "lat", "lon")
    return made.select("route_id", lines.encode_polyline(F.col("line")).alias("encoded"))


@query
def geojson_line(spark, sf_dir):
    made = routes.lines_from_points(fx.route_points(spark, sf_dir), "route_id", "seq", "lat", "lon")
    rounded = F.transform(
        "line",
        lambda p: F.struct(
            coerce.round_half_even(p["lat"], 2).alias("lat"), coerce.round_half_even(p["lon"], 4).alias("lon")
        ),
    )
    return made.select("route_id", F.to_json(lines.geojson_line(rounded)).alias("geojson"))


# ---- payloads and logs ----------------------------------------------------


def _log(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return log_rows(fx.run_records(fx.events(spark, sf_dir)))[name]


@query
def forecast_rows(spark, sf_dir):
    return _log(spark, sf_dir, "forecasts").select(
        F.unix_micros("snapshot_utc").alias("at_micros"),
        F.col("position").cast("long").alias("position"),
        "startTime",
        "temperature",
        "windSpeed",
        "windDirection",
        "shortForecast",
    )


@query
def alert_rows(spark, sf_dir):
    return _log(spark, sf_dir, "alerts").select(
        F.unix_micros("snapshot_utc").alias("at_micros"), "id", "event", "severity", "areaDesc"
    )


@query
def incident_flatten(spark, sf_dir):
    records = fx.run_records(fx.events(spark, sf_dir))
    objects = payloads.flatten_objects(records.select("snapshot_utc", F.col("incidents").alias("body")))
    return objects.groupBy(F.unix_micros("snapshot_utc").alias("at_micros")).agg(F.count("*").alias("objects"))


@query
def incident_fields(spark, sf_dir):
    return _log(spark, sf_dir, "incidents").select(
        F.unix_micros("snapshot_utc").alias("at_micros"), "id", "lanesBlocked", "lat", "lon", "headline"
    )


@query
def coordinate_resolve(spark, sf_dir):
    k = F.col("k")

    def maybe(step: int, value: Column) -> Column:
        return F.when(k % step != 0, value.cast("string"))

    flat = maybe(2, k + 1), maybe(3, k + 2)
    nested = maybe(5, k + 3), maybe(7, F.when(k % 11 == 0, F.lit("bad")).otherwise((k + 4).cast("string")))
    lat, lon = payloads.resolve_coordinates(flat, nested, ((k + 5).cast("string"), (k + 6).cast("string")))
    return fx.events(spark, sf_dir).select("event_id", lat.alias("lat"), lon.alias("lon"))


@query
def iso_text(spark, sf_dir):
    text = F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'-05:00'")
    )
    return fx.events(spark, sf_dir).select(
        "event_id", coerce.iso_seconds(F.col("ts")).alias("iso"), coerce.iso_seconds(coerce.to_utc(text)).alias("parsed")
    )


@query
def heartbeat(spark, sf_dir):
    return _heartbeat_view(_log(spark, sf_dir, "heartbeats"))


def _heartbeat_view(rows: DataFrame) -> DataFrame:
    return rows.select(F.unix_micros("snapshot_utc").alias("at_micros"), *[c for c in rows.columns if c != "snapshot_utc"])


@query
def log_union(spark, sf_dir):
    incidents = fx.incident_log(spark, sf_dir)
    more = fx.events(spark, sf_dir).where(F.col("event_type") == "click").select(
        F.col("ts").alias("snapshot_utc"), F.col("event_id").cast("string").alias("id"), F.lit("I-75").alias("roadName")
    )
    return logs.union_logs(incidents, more).select("id", "lanesBlocked", "roadName")


@query
def log_append_scan(spark, sf_dir):
    """Two appends to a log, the second with other columns, then a scan of it."""
    path = f"{new_folder(spark, 'logs')}/incidents"
    logs.append_log(fx.incident_log(spark, sf_dir), path, INCIDENT_LOG)
    moved = fx.incident_log(spark, sf_dir).select("snapshot_utc", F.col("id").alias("headline"))
    logs.append_log(moved, path, INCIDENT_LOG)
    return logs.read_log(spark, path, INCIDENT_LOG).select(
        F.unix_micros("snapshot_utc").alias("at_micros"), "id", "lanesBlocked", "headline"
    )


@query
def retention(spark, sf_dir):
    path = f"{new_folder(spark, 'logs')}/incidents"
    logs.append_log(fx.incident_log(spark, sf_dir), path, INCIDENT_LOG)
    logs.prune_log(spark, path, INCIDENT_LOG, "2024-01-31 00:00:00", days=10)
    return logs.read_log(spark, path, INCIDENT_LOG).select("id")


# ---- streams --------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = fx.table(spark, sf_dir, "events").schema
    return fx.as_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def _ingest(spark: SparkSession, sf_dir: str) -> str:
    folder = new_folder(spark, "stream")
    runs = fx.run_records(_event_stream(spark, sf_dir))
    ingest_stream(runs, folder, f"{folder}/checkpoint").awaitTermination()
    return folder


def _incident_view(spark: SparkSession, folder: str) -> DataFrame:
    rows = logs.read_log(spark, f"{folder}/incidents", INCIDENT_LOG)
    return rows.select(F.unix_micros("snapshot_utc").alias("at_micros"), "id", "lanesBlocked", "lat", "lon", "headline")


@query
def stream_ingest(spark, sf_dir):
    return _incident_view(spark, _ingest(spark, sf_dir))


@query
def log_two_streams(spark, sf_dir):
    """Two streams with checkpoints of their own, both numbering batches from 0, into the same logs."""
    folder = new_folder(spark, "stream")
    for name in ("first", "second"):
        runs = fx.run_records(_event_stream(spark, sf_dir))
        ingest_stream(runs, folder, f"{folder}/{name}").awaitTermination()
    return _incident_view(spark, folder)


@query
def retention_then_ingest(spark, sf_dir):
    """A second stream goes on with a log that retention has cut."""
    folder = _ingest(spark, sf_dir)
    logs.prune_log(spark, f"{folder}/incidents", INCIDENT_LOG, "2024-01-31 00:00:00", days=10)
    ingest_stream(fx.run_records(_event_stream(spark, sf_dir)), folder, f"{folder}/another").awaitTermination()
    return _incident_view(spark, folder)


@query
def retention_during_ingest(spark, sf_dir):
    """While retention cuts a log, a stream's first batch is run again and another is added; retention commits last."""
    path = f"{new_folder(spark, 'logs')}/incidents"
    rows = fx.incident_log(spark, sf_dir)
    parts = [rows.where(F.col("id").cast("long") % 3 == i) for i in range(3)]
    for batch in (0, 1):
        logs.append_log(parts[batch], path, INCIDENT_LOG, batch, "stream")

    def meanwhile() -> None:
        for batch in (0, 2):
            logs.append_log(parts[batch], path, INCIDENT_LOG, batch, "stream")

    logs.prune_log(spark, path, INCIDENT_LOG, "2024-01-31 12:00:00", days=10, before_commit=meanwhile)
    return logs.read_log(spark, path, INCIDENT_LOG).select("id")


@query
def stream_heartbeat(spark, sf_dir):
    return _heartbeat_view(logs.read_log(spark, f"{_ingest(spark, sf_dir)}/heartbeats", HEARTBEAT_LOG))


@query
def live_state_scores(spark, sf_dir):
    """Trips against a live state that took the logs in as two batches."""
    folder = new_folder(spark, "live")
    middle = F.lit("2024-01-16").cast("timestamp")
    for number, part in enumerate((F.col("snapshot_utc") < middle, F.col("snapshot_utc") >= middle)):
        forecasts, incidents = fx.forecast_log(spark, sf_dir).where(part), fx.incident_log(spark, sf_dir).where(part)
        logs.append_logs({"forecasts": (forecasts, FORECAST_LOG), "incidents": (incidents, INCIDENT_LOG)}, f"{folder}/logs", number)
        state = refresh_live_state(spark, f"{folder}/logs", f"{folder}/state")
    scored = trips.score_trips(
        requests.with_defaults(fx.requests(spark, sf_dir)),
        station_index(spark, sf_dir),
        routes=routes.normalise_routes(fx.route_responses(spark, sf_dir)),
        region="America/New_York",
        live=(state.moments, state.summary),
    )
    return scored.select("trip_id", *_rounded("p_final", "effective_mph", digits=5))


@query
def request_job(spark, sf_dir):
    """Landed bodies to results, rejects and unscored trips; stations in the north only, so some trips see none."""
    folder = new_folder(spark, "door")
    fx.request_bodies(spark, sf_dir).write.json(f"{folder}/landed")
    stations = build_station_index(fx.stations(spark, sf_dir).where("lat >= 33.5"), ["probability"])
    answered = routes.normalise_routes(fx.route_responses(spark, sf_dir))
    door.serve_requests(
        door.landed_bodies(spark, f"{folder}/landed"),
        stations,
        f"{folder}/tables",
        f"{folder}/checkpoint",
        lambda: fx.forecast_log(spark, sf_dir),
        lambda: fx.incident_log(spark, sf_dir),
        lambda: answered,
        region="America/New_York",
    ).awaitTermination()

    def told(rows: DataFrame, outcome: str) -> DataFrame:
        return rows.select(
            "trip_id", F.lit(outcome).alias("outcome"), F.lit(None).cast("string").alias("reason"), F.col("route.provider").alias("provider"),
            F.col("speed.probability_after_all_adjustments").alias("probability"), F.col("eta.minutes").alias("minutes"),
            F.col("inputs.leave_in_minutes").alias("leave_in_minutes"),
        )

    refused = door.rejects(spark, f"{folder}/tables").select("trip_id", F.lit("reject").alias("outcome"), "reason")
    answers = told(door.results(spark, f"{folder}/tables"), "result").union(told(door.unscored(spark, f"{folder}/tables"), "unscored"))
    return answers.unionByName(refused, allowMissingColumns=True)


@query
def stream_trip_scores(spark, sf_dir):
    folder = new_folder(spark, "stream")
    schema = fx.table(spark, sf_dir, "orders").schema
    orders = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    stream = score_stream(
        requests.with_defaults(fx.as_requests(orders)),
        station_index(spark, sf_dir),
        f"{folder}/results",
        f"{folder}/checkpoint",
        lambda: fx.forecast_log(spark, sf_dir),
        lambda: fx.incident_log(spark, sf_dir),
        region="America/New_York",
        routes=lambda: routes.normalise_routes(fx.route_responses(spark, sf_dir)),
    )
    stream.awaitTermination()
    return spark.read.parquet(f"{folder}/results").select(
        "trip_id",
        F.col("speed.probability_after_all_adjustments").alias("probability"),
        F.col("live.prob_before_live").alias("before_live"),
        F.col("speed.effective_speed_mph").alias("effective_mph"),
        F.col("eta.minutes").alias("minutes"),
        F.col("route.provider").alias("provider"),
    )
