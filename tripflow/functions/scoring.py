"""Trip arithmetic: speeds, bumps, times. All plain column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripflow.functions.coerce import strip

# Speeds by roadway prefix, path factors, bumps and their hours.
INTERSTATE_PREFIX = "I-"
STATE_ROAD_PREFIXES = ["SR-", "GA-", "US-"]
INTERSTATE_MPH = 70.0
STATE_ROAD_MPH = 45.0
OTHER_ROAD_MPH = 50.0
INTERSTATE_PATH_FACTOR = 1.10
OTHER_PATH_FACTOR = 1.20
MORNING_HOURS = (7, 9)
EVENING_HOURS = (16, 18)
MORNING_BUMP = 0.10
EVENING_BUMP = 0.12
SPEED_LOSS = 0.4
MIN_SPEED_MPH = 5.0
RAIN_WORDS = ["rain", "thunder", "snow", "storm", "showers"]
PRECIPITATION_WORDS = ["rain", "thunder", "storm", "showers", "snow", "hail", "drizzle"]
RAIN_BUMP = 0.08
STRONG_WIND_MPH = 20
WIND_BUMP = 0.03
INCIDENT_BUMP = 0.05
LANE_BUMP = 0.10
METRES_PER_MILE = 1609.344
SECONDS_PER_MINUTE = 60.0


def _road_name(roadway: Column) -> Column:
    return F.upper(strip(F.coalesce(roadway, F.lit(""))))


def freeflow_mph(roadway: Column) -> Column:
    road = _road_name(roadway)
    state_road = reduce(or_, [road.startswith(p) for p in STATE_ROAD_PREFIXES])
    return (
        F.when(road.startswith(INTERSTATE_PREFIX), INTERSTATE_MPH)
        .when(state_road, STATE_ROAD_MPH)
        .otherwise(OTHER_ROAD_MPH)
    )


def path_factor(roadway: Column) -> Column:
    return F.when(_road_name(roadway).startswith(INTERSTATE_PREFIX), INTERSTATE_PATH_FACTOR).otherwise(
        OTHER_PATH_FACTOR
    )


def departure_time(request_ts: Column, minutes: Column) -> Column:
    return request_ts + F.make_dt_interval(mins=F.coalesce(minutes, F.lit(0)).cast("int"))


def rush_hour_bump(local_ts: Column) -> Column:
    hour = F.hour(local_ts)
    return (
        F.when(hour.between(*MORNING_HOURS), MORNING_BUMP)
        .when(hour.between(*EVENING_HOURS), EVENING_BUMP)
        .otherwise(0.0)
    )


def clamp01(value: Column) -> Column:
    """Clamp to [0, 1]; null stays null (``least`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def speed_multiplier(probability: Column) -> Column:
    return F.lit(1.0) - F.lit(SPEED_LOSS) * probability


def effective_mph(freeflow: Column, multiplier: Column) -> Column:
    return F.when(multiplier.isNotNull(), F.greatest(F.lit(MIN_SPEED_MPH), freeflow * multiplier))


def contains_any(text: Column, words: list[str]) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(words))


def wind_mph(text: Column) -> Column:
    """First whole number in the text (``10 to 25 mph`` is 10), 0 when there is none."""
    digits = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+)", 1)
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def weather_bump(short_forecast: Column, wind_text: Column) -> Column:
    rain = F.when(contains_any(short_forecast, RAIN_WORDS), RAIN_BUMP).otherwise(0.0)
    wind = F.when(wind_mph(wind_text) > STRONG_WIND_MPH, WIND_BUMP).otherwise(0.0)
    return rain + wind


def precipitation_flag(short_forecast: Column) -> Column:
    return contains_any(short_forecast, PRECIPITATION_WORDS)


def incident_bump(events: Column, any_lane: Column, two_lanes: Column) -> Column:
    """Null when the incident log is empty."""
    bump = (
        F.lit(INCIDENT_BUMP)
        + F.when(any_lane, LANE_BUMP).otherwise(0.0)
        + F.when(two_lanes, LANE_BUMP).otherwise(0.0)
    )
    return F.when(events > 0, bump)


def metres_to_miles(metres: Column) -> Column:
    return F.coalesce(metres, F.lit(0.0)) / METRES_PER_MILE


def seconds_to_minutes(seconds: Column) -> Column:
    return F.coalesce(seconds, F.lit(0.0)) / SECONDS_PER_MINUTE
