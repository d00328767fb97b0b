"""Landed JSON payloads to log rows: forecasts, alerts, incidents.

Payloads keep their shape as ``variant`` until the typed projection, so one bad
or unexpected body costs its own rows and never the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.functions.coerce import first_present, to_number
from tripflow.schemas import RUN_RECORD
from tripflow.session import cut_lineage

#: wrappers and lists opened between two looks at what is left
LEVELS_PER_ROUND = 4

# Wrapper keys in order, and the source keys of every incident field.
WRAPPER_KEYS = ["events", "event", "data"]
INCIDENT_KEYS = {
    "id": ["id", "eventId", "incidentId", "Id"],
    "type": ["type", "eventType", "typeDesc"],
    "subtype": ["subtype", "eventSubType", "subTypeDesc"],
    "headline": ["headline", "title", "shortDescription", "description", "fullDesc"],
    "status": ["status", "eventStatus", "Status"],
    "startTime": ["startTime", "start_time", "starttime", "StartTime"],
    "endTime": ["endTime", "end_time", "endtime", "EndTime"],
    "lanesBlocked": ["lanesBlocked", "lanes", "lanesAffected"],
    "roadName": ["roadName", "route", "routeName", "road", "street", "roadwayName"],
    "direction": ["direction", "dir", "Direction"],
}
FLAT_LATITUDE_KEYS = ["latitude", "lat", "Latitude", "Y"]
FLAT_LONGITUDE_KEYS = ["longitude", "lon", "Longitude", "X"]
NESTED_LATITUDE_PATHS = ["location.latitude", "point.lat", "geo.lat"]
NESTED_LONGITUDE_PATHS = ["location.longitude", "point.lon", "geo.lon"]
GEOJSON_LONGITUDE_PATH = "geometry.coordinates[0]"
GEOJSON_LATITUDE_PATH = "geometry.coordinates[1]"
FORECAST_TEXT_FIELDS = [
    "startTime",
    "endTime",
    "temperatureUnit",
    "windSpeed",
    "windDirection",
    "shortForecast",
    "detailedForecast",
]
ALERT_PROPERTIES = [
    "event",
    "severity",
    "certainty",
    "urgency",
    "effective",
    "onset",
    "ends",
    "headline",
    "areaDesc",
]


def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file: its body and, as snapshot time, when it landed."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_modification_time").alias("snapshot_utc"), F.col("value").alias("body")
    )


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one collector run per line (many runs per file)."""
    return spark.read.schema(RUN_RECORD).json(path)


def text_at(value: str, path: str) -> Column:
    return F.try_variant_get(F.col(value), f"$.{path}", "string")


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def _periods(doc: str) -> Column:
    return F.try_variant_get(doc, "$.properties.periods", "array<variant>")


def _features(doc: str) -> Column:
    """The alerts of a features wrapper or a bare list, objects only."""
    listed = F.coalesce(F.try_variant_get(doc, "$.features", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
    return F.filter(listed, is_object)


def parsed_runs(records: DataFrame) -> DataFrame:
    """Collector runs with ``periods``, ``alerts`` and ``objects``, lists of variants, in place of their bodies.

    Every body is parsed and opened once; logs and heartbeats read the lists. A
    list is null where its source delivered nothing of the kind.
    """
    docs = records.withColumns({c: F.try_parse_json(c) for c in ("forecast", "alerts", "incidents")})
    return _innermost(
        docs.select(
            "snapshot_utc", "weather_error", "incident_error", _periods("forecast").alias("periods"), _features("alerts").alias("alerts"),
            F.when(F.col("incidents").isNotNull(), F.array("incidents")).alias("objects"),
        )
    )


def period_rows(runs: DataFrame) -> DataFrame:
    """(snapshot_utc, periods) to one row per forecast period, with its place in the list."""
    periods = runs.select("snapshot_utc", F.posexplode("periods").alias("position", "period"))
    texts = [text_at("period", f).alias(f) for f in FORECAST_TEXT_FIELDS]
    temperature = to_number(text_at("period", "temperature")).alias("temperature")
    return periods.select("snapshot_utc", "position", *texts[:2], temperature, *texts[2:])


def forecast_rows(payloads: DataFrame) -> DataFrame:
    """(snapshot_utc, body) to one row per forecast period."""
    parsed = payloads.select("snapshot_utc", F.try_parse_json("body").alias("doc"))
    return period_rows(parsed.select("snapshot_utc", _periods("doc").alias("periods")))


def feature_rows(runs: DataFrame) -> DataFrame:
    """(snapshot_utc, alerts) to one row per alert."""
    return runs.select("snapshot_utc", F.explode("alerts").alias("alert")).select(
        "snapshot_utc",
        text_at("alert", "id").alias("id"),
        *[text_at("alert", f"properties.{p}").alias(p) for p in ALERT_PROPERTIES],
    )


def alert_rows(payloads: DataFrame) -> DataFrame:
    """(snapshot_utc, body) to one row per alert; a features wrapper or a bare list."""
    parsed = payloads.select("snapshot_utc", F.try_parse_json("body").alias("doc"))
    return feature_rows(parsed.select("snapshot_utc", _features("doc").alias("alerts")))


def _innermost(runs: DataFrame) -> DataFrame:
    """``runs`` with the nodes of ``objects`` opened: the innermost objects, however deep they lie.

    Each step opens one wrapper or one list of every node in place; objects
    without a wrapper key stay as they are and scalars vanish. A round's result
    is written once, with whether a row has nodes left to open; only such rows go
    into another round.
    """
    done, rows = None, runs
    while True:
        for _ in range(LEVELS_PER_ROUND):
            seen = F.transform("objects", lambda node: F.struct(node.alias("node"), *[x.alias(n) for n, x in zip(("inside", "items"), _inside(node))]))
            rows = rows.withColumn("objects", F.flatten(F.transform(seen, _opened)))
        rows = cut_lineage(rows.withColumn("_deep", F.coalesce(F.exists("objects", _openable), F.lit(False))))
        closed = rows.where(~F.col("_deep")).drop("_deep")
        done = closed if done is None else done.unionByName(closed)
        rows = rows.where("_deep").drop("_deep")
        if rows.isEmpty():
            return done.withColumn("objects", F.filter("objects", is_object))


def flatten_objects(payloads: DataFrame) -> DataFrame:
    """(snapshot_utc, body) to one row per innermost object."""
    doc = F.try_parse_json("body")
    opened = _innermost(payloads.select("snapshot_utc", F.when(doc.isNotNull(), F.array(doc)).alias("objects")))
    return object_rows(opened)


def object_rows(runs: DataFrame) -> DataFrame:
    """(snapshot_utc, objects) to one row per object."""
    return runs.select("snapshot_utc", F.explode("objects").alias("event"))


def _inside(node: Column) -> tuple[Column, Column]:
    """What a wrapper holds, and the items of a list; null where the node is neither."""
    inside = F.coalesce(*[F.try_variant_get(node, f"$.{k}", "variant") for k in WRAPPER_KEYS])
    return inside, F.try_variant_get(node, "$", "array<variant>")


def _openable(node: Column) -> Column:
    inside, items = _inside(node)
    return inside.isNotNull() | items.isNotNull()


def _opened(seen: Column) -> Column:
    """The nodes that take a node's place, from the node and what was found in it, looked up once."""
    inside, items = seen["inside"], seen["items"]
    return F.when(inside.isNotNull(), F.array(inside)).when(items.isNotNull(), items).otherwise(F.array(seen["node"]))


def resolve_coordinates(
    flat: tuple[Column, Column], nested: tuple[Column, Column], geojson: tuple[Column, Column]
) -> tuple[Column, Column]:
    """(lat, lon) from three places in order.

    One missing flat coordinate discards both; GeoJSON fills only what the
    nested paths left open; one value that is no number nulls both.
    """
    flat_complete = flat[0].isNotNull() & flat[1].isNotNull()
    lat, lon = [
        F.when(flat_complete, flat[i]).otherwise(F.coalesce(nested[i], geojson[i])) for i in (0, 1)
    ]
    bad = (lat.isNotNull() & to_number(lat).isNull()) | (lon.isNotNull() & to_number(lon).isNull())
    return F.when(~bad, to_number(lat)), F.when(~bad, to_number(lon))


def incident_rows(objects: DataFrame) -> DataFrame:
    """(snapshot_utc, event variant) to incident log rows."""

    def pick(paths: list[str]) -> Column:
        return first_present(*[text_at("event", p) for p in paths])

    found = objects.select(
        "snapshot_utc",
        *[pick(keys).alias(name) for name, keys in INCIDENT_KEYS.items()],
        pick(FLAT_LATITUDE_KEYS).alias("flat_lat"),
        pick(FLAT_LONGITUDE_KEYS).alias("flat_lon"),
        pick(NESTED_LATITUDE_PATHS).alias("nested_lat"),
        pick(NESTED_LONGITUDE_PATHS).alias("nested_lon"),
        pick([GEOJSON_LATITUDE_PATH]).alias("geo_lat"),
        pick([GEOJSON_LONGITUDE_PATH]).alias("geo_lon"),
    )
    lat, lon = resolve_coordinates(
        (F.col("flat_lat"), F.col("flat_lon")),
        (F.col("nested_lat"), F.col("nested_lon")),
        (F.col("geo_lat"), F.col("geo_lon")),
    )
    names = list(INCIDENT_KEYS)
    return found.select(
        "snapshot_utc", *names[:7], lat.alias("lat"), lon.alias("lon"), *names[7:]
    )
