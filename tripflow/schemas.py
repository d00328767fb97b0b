"""Column contracts of the log tables, the requests and the model input."""

from __future__ import annotations

# Column names and order of the append-only logs.
FORECAST_LOG = (
    "snapshot_utc timestamp, startTime string, endTime string, temperature double, "
    "temperatureUnit string, windSpeed string, windDirection string, "
    "shortForecast string, detailedForecast string"
)
ALERT_LOG = (
    "snapshot_utc timestamp, id string, event string, severity string, certainty string, "
    "urgency string, effective string, onset string, ends string, headline string, "
    "areaDesc string"
)
INCIDENT_LOG = (
    "snapshot_utc timestamp, id string, type string, subtype string, headline string, "
    "status string, startTime string, endTime string, lat double, lon double, "
    "lanesBlocked string, roadName string, direction string"
)
HEARTBEAT_LOG = (
    "snapshot_utc timestamp, nws_ok boolean, wx_short string, wx_temp double, "
    "wx_wind string, wx_precip_flag boolean, nws_periods_written long, alerts_count long, "
    "ga511_ok boolean, ga511_events_count long, errors string"
)

# Model input contract.
NUMERIC_FEATURES = [
    "LAT",
    "LON",
    "AADT_MEAN_3YR",
    "AADT_STD_3YR",
    "AADT_TREND_SLOPE",
    "TRUCK_PCT_MEAN",
    "TRUCK_PCT_LATEST",
    "KFACTOR",
    "DFACTOR",
]
CATEGORICAL_FEATURES = ["FUNCTIONAL_CLASS", "STATION_TYPE"]
LABEL = "HIGH_CONGESTION_PROXY"

# One landed record per collector run: the raw bodies, or an error text instead.
RUN_RECORD = (
    "snapshot_utc timestamp, forecast string, alerts string, incidents string, "
    "weather_error string, incident_error string"
)

# One landed response per trip and routing provider.
ROUTE_RESPONSE = "trip_id long, provider string, body string, error string"

# A request as it lands, and what becomes of it.
REQUEST_BODY = "trip_id long, request_ts timestamp, body string"
REJECT_RECORD = "trip_id long, request_ts timestamp, reason string"
_POINT = "struct<lat: double, lon: double>"
TRIP_RECORD = (
    "trip_id long, model string, horizon_minutes int, "
    f"inputs struct<roadway: string, origin: {_POINT}, destination: {_POINT}, leave_in_minutes: int>, "
    "eta struct<minutes: double, hours: double>, "
    "distance struct<straight_line_miles: double, route_distance_miles_used: double, path_factor_if_no_router: double>, "
    "speed struct<freeflow_mph: double, probability_after_all_adjustments: double, speed_multiplier: double, effective_speed_mph: double>, "
    "route struct<provider: string, distance_miles: double, base_duration_minutes: double, "
    "polyline: struct<format: string, encoded: string>, "
    "geojson: struct<type: string, coordinates: array<array<double>>>, error: string>, "
    "live struct<live_used: boolean, nws_bump: double, nws_desc: string, ga511_bump: double, ga511_events: long, "
    "prob_before_live: double, prob_after_live: double>, notes array<string>"
)
