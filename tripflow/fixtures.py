"""Input tables of the jobs, derived from the provided tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.session import spread

OLD_YEARS = [1995, 1996, 1997, 1998]
NEW_YEARS = [1999, 2000, 2001]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(key: Column, factor: int, start: float) -> Column:
    return F.lit(start) + (key * factor % 300) / 100.0


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, lat, lon and a fixed probability."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("station_id"),
        _spread(key, 37, 32.0).alias("lat"),
        _spread(key, 91, -85.0).alias("lon"),
        (key % 10 / 10.0).alias("probability"),
    )


def tight_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stations in a square of about 300 feet, further inland."""
    key = F.col("station_id")
    return stations(spark, sf_dir).withColumns(
        {"lat": F.lit(33.5) + (key * 37 % 300) / 300000.0, "lon": F.lit(-83.5) + (key * 91 % 300) / 300000.0}
    )


def yearly_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, year, aadt, truck in long form."""
    volumes = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("station"), F.year("l_shipdate").alias("year"))
        .agg(F.sum("l_quantity").alias("total"), (F.avg("l_discount") * 100).alias("truck"))
    )
    gap = (F.col("station") * 7 + F.col("year")) % 11 == 0
    return volumes.select("station", "year", F.when(~gap, F.col("total")).alias("aadt"), "truck")


def _wide_volumes(spark: SparkSession, sf_dir: str, years: list[int], truck_header: str, omit: int) -> DataFrame:
    """Wide text table with raw headers, as a file would deliver it."""
    volumes = yearly_volumes(spark, sf_dir).where(F.col("year").isin(years))
    wide = volumes.groupBy("station").agg(
        *[F.max(F.when(F.col("year") == y, F.col("aadt"))).cast("string").alias(f"AADT {y}") for y in years],
        *[F.max(F.when(F.col("year") == y, F.col("truck"))).cast("string").alias(f"{truck_header} {y}") for y in years],
    )
    key = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").where(key % omit != 0)
    return suppliers.join(wide, key == F.col("station"), "left").select(
        key.cast("string").alias("Station ID"),
        F.when(key % 17 != 0, F.concat(F.lit("FC"), (F.col("s_nationkey") % 5).cast("string"))).alias("Functional Class"),
        *[c for c in wide.columns if c != "station"],
        "s_suppkey",
    )


def volumes_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide_volumes(spark, sf_dir, OLD_YEARS, "TruckPct", 13).drop("s_suppkey")


def volumes_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return (
        _wide_volumes(spark, sf_dir, NEW_YEARS, "Truck", 19)
        .withColumns({"Latitude": _spread(key, 37, 32.0).cast("string"), "Long": _spread(key, 91, -85.0).cast("string")})
        .drop("s_suppkey")
    )


def spelled_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three station tables with keys and numbers spelled differently, and 1998 in both volume tables."""
    key = F.col("s_suppkey")
    text = key.cast("string")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    kind = F.when(key % 4 == 0, "NA").when(key % 4 == 1, "n/a").otherwise(F.concat(F.lit("FC"), (key % 4).cast("string")))
    old = suppliers.where(key % 13 != 0).select(
        F.concat(F.lit("00"), text).alias("Station ID"), kind.alias("Functional Class"), text.alias("AADT 1995"), text.alias("AADT 1998")
    )
    blank = F.when(key % 4 < 2, "").otherwise(kind)
    new = suppliers.where(key % 19 != 0).select(
        F.concat(F.lit("+"), text).alias("Station ID"), blank.alias("Functional Class"), text.alias("AADT 2001"), text.alias("AADT 1998")
    )
    attributes = suppliers.select(F.concat(text, F.lit(".0")).alias("Station ID"), F.lit(".1").alias("KFactor"), F.lit("0.5").alias("DFactor"), F.lit("T").alias("Station Type"))
    again = suppliers.where(key % 2 == 0).select(text.alias("Station ID"), F.lit("0.10").alias("KFactor"), F.lit("5e-1").alias("DFactor"), F.lit("T").alias("Station Type"))
    other = suppliers.where(key % 23 == 0).select(text.alias("Station ID"), F.lit("NaN").alias("KFactor"), F.lit("0.5").alias("DFactor"), F.lit("null").alias("Station Type"))
    return old, new, attributes.union(again).union(other)


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes as text; every 23rd station has a second, different row."""
    key = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier")

    def rows(source: DataFrame, shift: float, kind: Column) -> DataFrame:
        return source.select(
            key.cast("string").alias("Station ID"),
            (F.lit(0.05 + shift) + key % 10 / 100.0).cast("string").alias("KFactor"),
            (F.lit(0.5) + key % 7 / 100.0).cast("string").alias("DFactor"),
            kind.alias("Station Type"),
        )

    return rows(suppliers, 0.0, F.concat(F.lit("T"), (key % 3).cast("string"))).unionByName(
        rows(suppliers.where(key % 23 == 0), 0.02, F.lit("T9"))
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed trip requests, one per order."""
    columns = ["o_orderkey", "o_custkey", "o_orderpriority"]
    return as_requests(spread(table(spark, sf_dir, "orders").select(*columns)))


def as_requests(orders: DataFrame) -> DataFrame:
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    priority = F.left("o_orderpriority", F.lit(1))
    roadway = (
        F.when(priority == "1", "I-75")
        .when(priority == "2", "SR-400")
        .when(priority == "3", " ga-316 ")
        .when(priority == "4", "US-41")
        .otherwise("Peachtree St")
    )
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return orders.select(
        key.alias("trip_id"),
        (start + F.make_dt_interval(mins=(key * 977 % 43200).cast("int"))).alias("request_ts"),
        roadway.alias("roadway"),
        F.struct(_spread(cust, 53, 32.0).alias("lat"), _spread(cust, 29, -85.0).alias("lon")).alias("origin"),
        F.struct(_spread(key, 41, 32.0).alias("lat"), _spread(key, 67, -85.0).alias("lon")).alias("destination"),
        (key % 4 * 15).cast("int").alias("leave_in_minutes"),
        (key % 6 != 0).alias("live"),
        F.when(key % 8 == 0, "none").when(key % 8 == 1, "geoapify").when(key % 8 == 2, "ors").when(
            key % 8 == 3, "google"
        ).otherwise("auto").alias("router"),
        F.when(key % 5 == 0, "geojson").otherwise("encoded").alias("polyline_format"),
    )


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as raw bodies; some are broken, incomplete, or use other names and kinds of values."""
    key = F.col("trip_id")
    good = F.to_json(F.struct("roadway", "origin", "destination", F.col("leave_in_minutes").alias("leave_in"), "live"))
    body = (
        F.when(key % 11 == 0, "{broken")
        .when(key % 13 == 0, '{"roadway": "I-75", "origin": {"lat": 33}}')
        .when(key % 17 == 0, '{"roadway": "I-75", "origin": {"lat": "x", "lon": 1}, "destination": {"lat": 1, "lon": 2}}')
        .when(
            key % 19 == 0,
            '{"roadway": " US-1 ", "origin": {"lat": "33.5", "lon": -84}, "destination": {"lat": 34, "lon": -84.5},'
            ' "leave_in_minutes": null, "leave_in": 9, "live": 0, "router": "ors"}',
        )
        .otherwise(good)
    )
    return requests(spark, sf_dir).select("trip_id", "request_ts", body.alias("body"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(spread(table(spark, sf_dir, "events")))


def as_events(raw: DataFrame) -> DataFrame:
    """Events with a zoned time, their small counter and the forecast texts."""
    kind = F.col("event_type")
    short = (
        F.when(kind == "error", "Thunderstorms")
        .when(kind == "signup", "Light Rain")
        .when(kind == "view", "Sunny")
        .when(kind == "click", "Mostly Cloudy")
        .otherwise("Snow Showers")
    )
    wind = F.when(F.col("event_id") % 9 == 0, "calm").otherwise(
        F.concat((F.floor("value") % 35).cast("string"), F.lit(" mph"))
    )
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        short.alias("short"),
        wind.alias("wind"),
    )


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def forecast_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One forecast start per event, logged one hour ahead."""
    return events(spark, sf_dir).select(
        (F.col("ts") - F.make_dt_interval(hours=F.lit(1))).alias("snapshot_utc"),
        _iso(F.col("ts")).alias("startTime"),
        F.col("short").alias("shortForecast"),
        F.col("wind").alias("windSpeed"),
    )


def incident_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where(F.col("event_type") == "error")
    lanes = F.when(F.col("k") % 5 != 0, (F.col("k") % 4).cast("string"))
    return rows.select(
        F.col("ts").alias("snapshot_utc"), F.col("event_id").cast("string").alias("id"), lanes.alias("lanesBlocked")
    )


def run_records(rows: DataFrame) -> DataFrame:
    """One collector run per event: raw bodies in varying shapes, some failed sources.

    Forecast: two periods, the second in force only for even events. Alerts: a
    features wrapper or a bare list. Incidents: bare, wrapped, nested or listed,
    with coordinates flat, nested or as GeoJSON.
    """
    key = F.col("event_id")
    minute = F.make_dt_interval(mins=F.lit(1))

    def period(start: Column, end: Column, short: Column, temperature: Column) -> Column:
        return F.struct(
            _iso(start).alias("startTime"),
            _iso(end).alias("endTime"),
            temperature.alias("temperature"),
            F.lit("F").alias("temperatureUnit"),
            F.col("wind").alias("windSpeed"),
            short.alias("shortForecast"),
        )

    later = period(F.col("ts") + minute * 5, F.col("ts") + minute * 65, F.lit("Hail later"), F.col("k") + 1)
    now = period(
        F.when(key % 2 == 0, F.col("ts") - minute).otherwise(F.col("ts") + minute * 2),
        F.col("ts") + minute * 59,
        F.col("short"),
        F.col("k"),
    )
    forecast = F.to_json(F.struct(F.struct(F.array(later, now).alias("periods")).alias("properties")))
    alert = F.struct(
        F.concat(F.lit("A"), key.cast("string")).alias("id"),
        F.struct(F.col("event_type").alias("event"), F.lit("Severe").alias("severity")).alias("properties"),
    )
    alerts = F.when(key % 3 == 0, F.to_json(F.struct(F.array(alert, alert).alias("features")))).when(
        key % 3 == 1, F.to_json(F.array(alert))
    ).otherwise('{"features": []}')
    head = F.concat(F.lit('{"id": "'), key.cast("string"), F.lit('", "lanes": '), (F.col("k") % 4).cast("string"))
    lat, lon = (F.col("k") + 3000) / 100.0, (F.lit(-8000) - F.col("k")) / 100.0
    flat = F.concat(head, F.lit(', "lat": "'), lat.cast("string"), F.lit('", "lon": '), lon.cast("string"), F.lit("}"))
    nested = F.concat(
        head, F.lit(', "lat": 1.5, "location": {"latitude": '), lat.cast("string"),
        F.lit(', "longitude": '), lon.cast("string"), F.lit("}}"),
    )
    geojson = F.concat(
        head, F.lit(', "geometry": {"coordinates": ['), lon.cast("string"), F.lit(", "), lat.cast("string"), F.lit("]}}")
    )
    bad = F.concat(head, F.lit(', "lat": "north", "lon": 5}'))
    incidents = (
        F.when(key % 5 == 0, flat)
        .when(key % 5 == 1, F.concat(F.lit('{"events": ['), nested, F.lit(", 7, "), flat, F.lit("]}")))
        .when(key % 5 == 2, F.concat(F.lit('{"data": {"event": [['), geojson, F.lit("]]}}")))
        .when(key % 5 == 3, F.concat(F.lit("["), bad, F.lit(", null]")))
        .otherwise('{"events": null}')
    )
    weather_failed, incidents_failed = key % 11 == 0, key % 7 == 0
    return rows.select(
        F.col("ts").alias("snapshot_utc"),
        F.when(~weather_failed, forecast).alias("forecast"),
        F.when(~weather_failed, alerts).otherwise('{"features": []}').alias("alerts"),
        F.when(~incidents_failed, incidents).alias("incidents"),
        F.when(weather_failed, "weather timeout").alias("weather_error"),
        F.when(incidents_failed, "HTTP 503: busy").alias("incident_error"),
    )


def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per line item: route, seq, lat, lon."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("route_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("seq"),
        _spread(F.col("l_partkey"), 7, 32.0).alias("lat"),
        (F.lit(-85.0) + F.col("l_extendedprice") / 100000.0).alias("lon"),
    )


def route_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing responses of three providers as raw bodies, some failed or missing."""
    rows = requests(spark, sf_dir)
    key = F.col("trip_id")
    metres, seconds = (key % 1000 * 100.0).cast("string"), (key % 777 * 6.0).cast("string")
    a = F.concat(F.lit("["), F.col("origin.lon").cast("string"), F.lit(", "), F.col("origin.lat").cast("string"), F.lit("]"))
    b = F.concat(F.lit("["), F.col("destination.lon").cast("string"), F.lit(", "), F.col("destination.lat").cast("string"), F.lit("]"))
    line = F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]"))
    first = F.concat(
        F.lit('{"features": [{"properties": {"distance": '), metres, F.lit(', "time": '), seconds,
        F.lit('}, "geometry": {"coordinates": '),
        F.when(key % 2 == 0, line).otherwise(F.concat(F.lit("["), line, F.lit("]"))), F.lit("}}]}"),
    )
    second = F.concat(
        F.lit('{"features": [{"properties": {"summary": {"distance": '), metres, F.lit(', "duration": '), seconds,
        F.lit('}}, "geometry": {"coordinates": '), line, F.lit("}}]}"),
    )
    third = F.concat(
        F.lit('{"routes": [{"legs": [{"distance": {"value": '), metres, F.lit('}, "duration": {"value": '), seconds,
        F.lit('}}, {"distance": {"value": 50}}], "overview_polyline": {"points": "abc"}}]}'),
    )

    def answers(provider: str, body: Column, keep: Column, failed: Column, empty: str) -> DataFrame:
        return rows.where(keep).select(
            "trip_id",
            F.lit(provider).alias("provider"),
            F.when(failed, empty).otherwise(body).alias("body"),
            F.lit(None).cast("string").alias("error"),
        )

    return (
        answers("geoapify", first, key % 3 == 0, key % 9 == 0, '{"features": []}')
        .unionByName(answers("ors", second, key % 2 == 0, key % 10 == 0, '{"features": [null]}'))
        .unionByName(answers("google", third, key % 7 != 0, key % 13 == 0, '{"status": "ZERO_RESULTS"}'))
    )
