"""The trip job: a table of requests to a table of speeds, ETAs and routes.

Stations, forecasts and incidents are reduced to small indexes or one row
beforehand. The requests then flow through lookups and arithmetic in a single
stage; only a table of routing responses, when given, brings a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.functions.coerce import round_half_even
from tripflow.functions.geo import haversine_miles, midpoint
from tripflow.functions.scoring import (
    clamp01,
    departure_time,
    effective_mph,
    freeflow_mph,
    path_factor,
    rush_hour_bump,
    speed_multiplier,
)
from tripflow.operators.live import forecast_moments, incident_summary, live_adjustment, summary_bump
from tripflow.operators.nearest_station import StationIndex, nearest_stations, weighted_mean
from tripflow.operators.nearest_time import build_time_index, nearest_in_time
from tripflow.operators.routes import route_for, route_payload, used_miles


def trip_midpoint() -> tuple[Column, Column]:
    return (
        midpoint(F.col("origin.lat"), F.col("destination.lat")),
        midpoint(F.col("origin.lon"), F.col("destination.lon")),
    )


def base_probability(requests: DataFrame, stations: StationIndex) -> DataFrame:
    """Adds ``p_base``, null where no station is in reach."""
    scored = nearest_stations(requests, stations, *trip_midpoint())
    return scored.withColumn("p_base", weighted_mean(F.col("neighbours"), "probability")).drop("neighbours")


def adjusted_for_departure(trips: DataFrame, region: str) -> DataFrame:
    """Adds ``depart_utc`` and ``p_time``; the rush hour is judged in the region's local time."""
    depart = departure_time(F.col("request_ts"), F.col("leave_in_minutes"))
    local = F.from_utc_timestamp("depart_utc", region)
    return trips.withColumn("depart_utc", depart).withColumn("p_time", clamp01(F.col("p_base") + rush_hour_bump(local)))


def adjusted_for_live(trips: DataFrame, moments: DataFrame | None, summary: DataFrame | None) -> DataFrame:
    """Adds ``p_final`` and the ``live`` details, from forecast moments and the one-row incident summary."""
    if moments is not None:
        index = build_time_index(moments)
        trips = nearest_in_time(trips, index, F.col("depart_utc")).withColumn("weather", F.col("nearest.row")).drop("nearest")
    else:
        trips = trips.withColumn("weather", F.lit(None).cast("struct<description:string,bump:double>"))
    if summary is not None:
        trips = trips.withColumn("incidents", summary_bump(summary))
    else:
        trips = trips.withColumn("incidents", F.lit(None).cast("struct<events:bigint,bump:double>"))
    return (
        trips.withColumn(
            "_live", live_adjustment(F.col("p_time"), F.col("live"), F.col("weather"), F.col("incidents"))
        )
        .withColumns({"p_final": F.col("_live.probability"), "live": F.col("_live.details")})
        .drop("_live", "weather", "incidents")
    )


def score_trips(
    requests: DataFrame,
    stations: StationIndex,
    forecast_log: DataFrame | None = None,
    incident_log: DataFrame | None = None,
    routes: DataFrame | None = None,
    region: str = "UTC",
    live: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Typed requests (see ``with_defaults``) to one wide row per trip.

    ``live`` are forecast moments and incident summary that are kept already, in
    place of the logs they are made from.

    Trips without a station in reach keep their row: probability, speed and ETA
    are null.
    """
    trips = adjusted_for_departure(base_probability(requests, stations), region)
    moments, summary = live or (
        forecast_moments(forecast_log) if forecast_log is not None else None,
        incident_summary(incident_log) if incident_log is not None else None,
    )
    trips = adjusted_for_live(trips, moments, summary)
    if routes is not None:
        trips = route_for(trips, routes)
    else:
        trips = trips.withColumns(
            {
                "answer": F.lit(None).cast(
                    "struct<provider:string,ok:boolean,distance_miles:double,duration_minutes:double,"
                    "coordinates:array<struct<lat:double,lon:double>>,encoded:string,error:string>"
                ),
                "route_error": F.lit(None).cast("string"),
            }
        )
    straight = haversine_miles(
        F.col("origin.lat"), F.col("origin.lon"), F.col("destination.lat"), F.col("destination.lon")
    )
    return (
        trips.withColumns({"straight_miles": straight, "path_factor": path_factor(F.col("roadway"))})
        .withColumns(
            {
                "estimate_miles": F.col("straight_miles") * F.col("path_factor"),
                "freeflow_mph": freeflow_mph(F.col("roadway")),
                "speed_multiplier": speed_multiplier(F.col("p_final")),
            }
        )
        .withColumns(
            {
                "route_miles": used_miles(F.col("estimate_miles")),
                "effective_mph": effective_mph(F.col("freeflow_mph"), F.col("speed_multiplier")),
            }
        )
        .withColumn("eta_hours", F.col("route_miles") / F.col("effective_mph"))
        .withColumn("eta_minutes", F.col("eta_hours") * 60.0)
    )


def trip_records(
    trips: DataFrame, model: str | None = None, horizon_minutes: int | None = None, notes: list[str] | None = None
) -> DataFrame:
    """The nested result record, rounded for output, with the request as it was understood.

    ``model``, ``horizon_minutes`` and ``notes`` are the job's own and repeated in every record.
    """
    ends = F.array(F.col("origin"), F.col("destination"))
    line = F.transform(ends, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    noted = F.array(*[F.lit(n) for n in notes or []]).cast("array<string>")
    return trips.select(
        "trip_id",
        F.lit(model).cast("string").alias("model"),
        F.lit(horizon_minutes).cast("int").alias("horizon_minutes"),
        F.struct("roadway", "origin", "destination", "leave_in_minutes").alias("inputs"),
        F.struct(
            round_half_even(F.col("eta_minutes"), 1).alias("minutes"),
            round_half_even(F.col("eta_hours"), 3).alias("hours"),
        ).alias("eta"),
        F.struct(
            round_half_even(F.col("straight_miles"), 3).alias("straight_line_miles"),
            round_half_even(F.col("route_miles"), 3).alias("route_distance_miles_used"),
            F.col("path_factor").alias("path_factor_if_no_router"),
        ).alias("distance"),
        F.struct(
            F.col("freeflow_mph"),
            round_half_even(F.col("p_final"), 4).alias("probability_after_all_adjustments"),
            round_half_even(F.col("speed_multiplier"), 3).alias("speed_multiplier"),
            round_half_even(F.col("effective_mph"), 2).alias("effective_speed_mph"),
        ).alias("speed"),
        route_payload(line, F.col("estimate_miles")).alias("route"),
        F.col("live"),
        noted.alias("notes"),
    )


def split_unscored(trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored trips, and those no station was in reach of.

    Meant for a written result table: on a plan the scoring would run twice.
    """
    return trips.where(F.col("p_final").isNotNull()), trips.where(F.col("p_final").isNull())
