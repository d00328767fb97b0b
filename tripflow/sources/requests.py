"""Trip requests: JSON bodies to typed rows, with the rejected ones kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.functions.coerce import strip, to_number

# Defaults and rejection texts.
DEFAULT_ROUTER = "auto"
DEFAULT_POLYLINE_FORMAT = "encoded"
BAD_JSON = "Invalid or missing JSON body"
BAD_PAYLOAD = "Payload must include roadway, origin{lat,lon}, destination{lat,lon}"
BAD_LEAVE_IN = "leave_in_minutes must be a whole number"


def read_request_bodies(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with ``trip_id``, ``request_ts`` and the request ``body`` as text."""
    return spark.read.schema("trip_id long, request_ts timestamp, body string").json(path)


POINT_FIELDS = ["origin.lat", "origin.lon", "destination.lat", "destination.lon"]
OPTION_FIELDS = ["leave_in_minutes", "leave_in", "live", "router", "polyline_format"]


def _extracted(bodies: DataFrame) -> DataFrame:
    """Each field once: its text, and for options the JSON kind, null when the key is absent."""

    def text(path: str) -> Column:
        return F.try_variant_get("doc", f"$.{path}", "string")

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("doc", f"$.{path}", "variant"))

    fields = F.struct(
        F.col("doc").isNotNull().alias("is_json"),
        *[to_number(text(f)).alias(f.replace(".", "_")) for f in POINT_FIELDS],
        text("roadway").alias("roadway"),
        kind("roadway").alias("roadway_kind"),
        *[text(f).alias(f) for f in OPTION_FIELDS],
        *[kind(f).alias(f"{f}_kind") for f in OPTION_FIELDS],
    )
    # Generating one row per body keeps later filters on these fields from being
    # pushed below the parsing, which would then run once per use.
    return bodies.withColumn("doc", F.try_parse_json("body")).select(
        "trip_id", "request_ts", F.inline(F.array(fields))
    )


def _minutes(field: str) -> Column:
    """Whole minutes; null, zero and empty are 0; null when not a whole number."""
    text, kind = strip(F.col(field)), F.col(f"{field}_kind")
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
    return (
        F.when(kind.isNull() | text.isNull() | (text == ""), 0)
        .when(kind == "STRING", whole)
        .when(kind == "BOOLEAN", (text == "true").cast("int"))
        .otherwise(text.try_cast("double").try_cast("int"))
    )


def _truthy(field: str, default: bool) -> Column:
    """Truth value as scripts see it: null, 0, empty text, list and object are false."""
    text, kind = F.col(field), F.col(f"{field}_kind")
    return (
        F.when(kind.isNull(), default)
        .when(text.isNull(), False)
        .when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", text == "true")
        .when(kind.rlike("^(ARRAY|OBJECT)"), ~text.isin("[]", "{}"))
        .otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(True)))
    )


def _option(field: str, default: str) -> Column:
    """Text of the option; an explicit null reads as the word None, a missing key as the default."""
    return F.when(F.col(f"{field}_kind").isNull(), default).otherwise(F.coalesce(field, F.lit("None")))


def parse_requests(bodies: DataFrame) -> DataFrame:
    """(trip_id, request_ts, body) to typed requests plus ``reason``, null when accepted."""
    fields = _extracted(bodies)
    complete = F.col("roadway_kind").isNotNull()
    for name in POINT_FIELDS:
        complete = complete & F.col(name.replace(".", "_")).isNotNull()
    leave_in = F.when(F.col("leave_in_minutes_kind").isNotNull(), _minutes("leave_in_minutes")).otherwise(
        _minutes("leave_in")
    )

    def point(name: str) -> Column:
        return F.struct(F.col(f"{name}_lat").alias("lat"), F.col(f"{name}_lon").alias("lon")).alias(name)

    return fields.withColumn("minutes", leave_in).select(
        "trip_id",
        "request_ts",
        strip(F.coalesce("roadway", F.lit("None"))).alias("roadway"),
        point("origin"),
        point("destination"),
        F.col("minutes").alias("leave_in_minutes"),
        _truthy("live", True).alias("live"),
        _option("router", DEFAULT_ROUTER).alias("router"),
        _option("polyline_format", DEFAULT_POLYLINE_FORMAT).alias("polyline_format"),
        F.when(~F.col("is_json"), BAD_JSON)
        .when(~complete, BAD_PAYLOAD)
        .when(F.col("minutes").isNull(), BAD_LEAVE_IN)
        .alias("reason"),
    )


def split_requests(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted requests, and rejected ones with the reason."""
    parsed = parse_requests(bodies)
    accepted = parsed.where(F.col("reason").isNull()).drop("reason")
    rejected = parsed.where(F.col("reason").isNotNull()).select("trip_id", "request_ts", "reason")
    return accepted, rejected


def with_defaults(requests: DataFrame) -> DataFrame:
    """Same defaults for requests that arrive already typed, absent columns included."""
    minutes = [F.col(c) for c in ("leave_in_minutes", "leave_in") if c in requests.columns]

    def filled(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in requests.columns else F.lit(default)

    return requests.withColumns(
        {
            "roadway": strip(F.col("roadway")),
            "leave_in_minutes": F.coalesce(*minutes, F.lit(0)).cast("int"),
            "live": filled("live", True),
            "router": filled("router", DEFAULT_ROUTER),
            "polyline_format": filled("polyline_format", DEFAULT_POLYLINE_FORMAT),
        }
    ).drop("leave_in")
