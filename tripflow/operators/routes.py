"""Route geometry: provider responses to one layout, route choice, line jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripflow.functions.coerce import round_half_even, to_number
from tripflow.functions.lines import (
    encode_polyline,
    from_lon_lat,
    geojson_line,
)
from tripflow.functions.scoring import metres_to_miles, seconds_to_minutes

# Providers in order of preference, route labels and error texts.
PROVIDERS = ["geoapify", "ors", "google"]
NO_ROUTER = "none"
ANY_ROUTER = "auto"
FALLBACK = "fallback"
NO_FEATURES = "no features"
BAD_FEATURE = "route feature without properties or with an unreadable line"
NO_ROUTES = "no routes"
BAD_BODY = "response is not JSON"
ROUTING_DISABLED = "routing disabled"
NO_PROVIDER = "no routing keys set"

LEGS = "array<struct<distance:struct<value:double>,duration:struct<value:double>>>"
ROUTE_COLUMNS = [
    "trip_id",
    "provider",
    "ok",
    "distance_miles",
    "duration_minutes",
    "coordinates",
    "encoded",
    "error",
]
ANSWER_COLUMNS = ROUTE_COLUMNS[1:]


def _number(path: str) -> Column:
    return to_number(F.try_variant_get("doc", path, "string"))


def _leg_sum(field: str) -> Column:
    legs = F.try_variant_get("doc", "$.routes[0].legs", LEGS)
    return F.aggregate(
        F.coalesce(legs, F.array().cast(LEGS)),
        F.lit(0.0),
        lambda acc, leg: acc + F.coalesce(leg[field]["value"], F.lit(0.0)),
    )


def normalise_routes(responses: DataFrame) -> DataFrame:
    """(trip_id, provider, body, error) in three layouts to one route layout.

    Only the layout belonging to the row's provider is read. Lines arrive as
    ``[[lon, lat], ...]``; of a multi-line the first line counts.
    """
    provider = F.col("provider")
    is_legs = provider == "google"
    path = "$.features[0].geometry.coordinates"
    line = F.try_variant_get("doc", path, "array<array<double>>")
    first_line = F.try_variant_get("doc", f"{path}[0]", "array<array<double>>")
    many = (provider == "geoapify") & F.try_variant_get("doc", f"{path}[0][0]", "double").isNull()
    pairs = F.coalesce(F.when(many, first_line).otherwise(line), F.array().cast("array<array<double>>"))
    coordinates = F.when(~is_legs, from_lon_lat(pairs))
    found = F.when(is_legs, F.schema_of_variant(F.try_variant_get("doc", "$.routes[0]", "variant"))).otherwise(
        F.schema_of_variant(F.try_variant_get("doc", "$.features[0]", "variant"))
    )
    # a feature needs properties, and a line where its provider puts one
    properties = F.schema_of_variant(F.try_variant_get("doc", "$.features[0].properties", "variant"))
    given = F.schema_of_variant(F.try_variant_get("doc", path, "variant"))
    complete = properties.startswith("OBJECT") & (given.isNull() | F.when(many, first_line).otherwise(line).isNotNull())
    missing = F.when(
        is_legs, F.coalesce(F.try_variant_get("doc", "$.status", "string"), F.lit(NO_ROUTES))
    ).otherwise(NO_FEATURES)
    metres = (
        F.when(provider == "geoapify", _number("$.features[0].properties.distance"))
        .when(provider == "ors", _number("$.features[0].properties.summary.distance"))
        .when(is_legs, _leg_sum("distance"))
    )
    seconds = (
        F.when(provider == "geoapify", _number("$.features[0].properties.time"))
        .when(provider == "ors", _number("$.features[0].properties.summary.duration"))
        .when(is_legs, _leg_sum("duration"))
    )
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~provider.isin(*PROVIDERS), F.concat(F.lit("unknown router "), provider))
        .when(F.col("doc").isNull(), BAD_BODY)
        .when(found.isNull() | ~found.startswith("OBJECT"), missing)
        .when(~is_legs & ~F.coalesce(complete, F.lit(False)), BAD_FEATURE)
    )
    routes = (
        responses.withColumn("doc", F.try_parse_json("body"))
        .withColumn("error", error)
        .select(
            "trip_id",
            "provider",
            F.col("error").isNull().alias("ok"),
            F.when(F.col("error").isNull(), metres_to_miles(metres)).alias("distance_miles"),
            F.when(F.col("error").isNull(), seconds_to_minutes(seconds)).alias("duration_minutes"),
            F.when(F.col("error").isNull(), coordinates).alias("coordinates"),
            F.when(is_legs, F.try_variant_get("doc", "$.routes[0].overview_polyline.points", "string")).alias(
                "given"
            ),
            "error",
        )
    )
    return routes.withColumn(
        "encoded", F.when(F.col("ok"), F.coalesce("given", encode_polyline(F.col("coordinates"))))
    ).select(*ROUTE_COLUMNS)


def empty_routes(spark) -> DataFrame:
    return spark.createDataFrame(
        [],
        "trip_id long, provider string, ok boolean, distance_miles double, duration_minutes double, "
        "coordinates array<struct<lat:double,lon:double>>, encoded string, error string",
    )


def ranked_routes(routes: DataFrame) -> DataFrame:
    """One row per trip and provider, with ``is_first`` on the trip's preferred provider."""
    priority = F.array_position(F.array(*[F.lit(p) for p in PROVIDERS]), F.col("provider"))
    in_order = W.partitionBy("trip_id").orderBy(priority, F.desc("ok"), "distance_miles", "duration_minutes")
    repeated = F.lag("provider").over(in_order) == F.col("provider")
    return (
        routes.where(F.col("provider").isin(*PROVIDERS))
        .withColumns({"is_first": F.row_number().over(in_order) == 1, "repeated": repeated})
        .where(~F.coalesce("repeated", F.lit(False)))
        .drop("repeated")
    )


def route_for(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """``trips`` plus ``answer``, the response of the requested router, and ``route_error``.

    ``auto`` asks the first provider that answers for the trip and does not try
    the next one when that answer is an error. Ranking and join share one
    shuffle by trip, and only the answer columns in use are carried along.
    """
    ranked = ranked_routes(routes).select(
        F.col("trip_id").alias("_trip"), *[F.col(c).alias(f"_{c}") for c in ANSWER_COLUMNS], "is_first"
    )
    asked = (F.col("_provider") == F.col("router")) | ((F.col("router") == ANY_ROUTER) & F.col("is_first"))
    error = (
        F.when(F.col("router") == NO_ROUTER, ROUTING_DISABLED)
        .when(~F.col("router").isin(*PROVIDERS, ANY_ROUTER), F.concat(F.lit("unknown router "), F.col("router")))
        .when(F.col("_provider").isNull(), NO_PROVIDER)
        .otherwise(F.col("_error"))
    )
    return trips.join(ranked, (F.col("trip_id") == F.col("_trip")) & asked, "left").select(
        *trips.columns,
        F.struct(*[F.col(f"_{c}").alias(c) for c in ANSWER_COLUMNS]).alias("answer"),
        error.alias("route_error"),
    )


def route_payload(straight_line: Column, estimate_miles: Column) -> Column:
    """Nested route record: the provider's route, else the straight line as fallback."""
    ok = F.coalesce(F.col("answer.ok"), F.lit(False))
    encoded_wanted = F.col("polyline_format") == "encoded"
    encoded = F.when(ok, F.col("answer.encoded")).otherwise(encode_polyline(straight_line))
    line = F.when(ok, F.col("answer.coordinates")).otherwise(straight_line)
    duration = round_half_even(F.coalesce("answer.duration_minutes", F.lit(0.0)), 1)
    return F.struct(
        F.when(ok, F.col("answer.provider")).otherwise(FALLBACK).alias("provider"),
        round_half_even(F.when(ok, used_miles(estimate_miles)).otherwise(estimate_miles), 3).alias(
            "distance_miles"
        ),
        F.when(ok, duration).alias("base_duration_minutes"),
        F.when(encoded_wanted, F.struct(F.lit("encoded").alias("format"), encoded.alias("encoded"))).alias(
            "polyline"
        ),
        F.when(~encoded_wanted, geojson_line(line)).alias("geojson"),
        F.col("route_error").alias("error"),
    )


def used_miles(estimate_miles: Column) -> Column:
    """Provider distance when it has one (0 counts as none), else the estimate."""
    given = F.when(F.coalesce(F.col("answer.ok"), F.lit(False)), F.col("answer.distance_miles"))
    return F.coalesce(F.when(given != 0, given), estimate_miles)


def leg_totals(legs: DataFrame, route: str, metres: str, seconds: str) -> DataFrame:
    """Miles and minutes per route from a table of legs, missing values as 0."""
    return legs.groupBy(route).agg(
        metres_to_miles(F.sum(F.coalesce(F.col(metres), F.lit(0.0)))).alias("distance_miles"),
        seconds_to_minutes(F.sum(F.coalesce(F.col(seconds), F.lit(0.0)))).alias("duration_minutes"),
    )


def lines_from_points(points: DataFrame, route: str, seq: str, lat: str, lon: str) -> DataFrame:
    """One ordered line per route; the line is one value, as large as its route."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))))
    return points.groupBy(route).agg(ordered.alias("points")).select(
        route,
        F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("line"),
    )
