"""Station features from wide yearly tables.

All yearly statistics are arithmetic over the columns of one row, so after the
merge nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.operators.joins import null_safe_join
from tripflow.operators.kinds import as_kind, column_kinds
from tripflow.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from tripflow.session import cut_lineage
from tripflow.sources.station_files import (
    LATITUDE_NAMES,
    LONGITUDE_NAMES,
    clean_headers,
    coordinate_name,
    lost_years,
    number_column,
    rename_truck_columns,
    truck_years,
    volume_years,
)

# Keys, attribute columns and the widths of the yearly windows.
STATION_KEYS = ["STATION_ID", "FUNCTIONAL_CLASS"]
ATTRIBUTE_COLUMNS = ["STATION_ID", "KFACTOR", "DFACTOR", "STATION_TYPE"]
SLOPE_YEARS = 6
ROLLING_YEARS = 3


def _total(values: list[Column]) -> Column:
    return reduce(add, values)


def _zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _count(values: list[Column]) -> Column:
    return _total([F.when(v.isNotNull(), 1.0).otherwise(0.0) for v in values])


def row_mean(values: list[Column]) -> Column:
    """Mean of the non-null values, null when there are none."""
    if not values:
        return F.lit(None).cast("double")
    return F.try_divide(_total([_zero_if_null(v) for v in values]), _count(values))


def row_std(values: list[Column], mean: Column) -> Column:
    """Population standard deviation of the non-null values; 0 for a single one."""
    squares = _total([_zero_if_null(F.pow(v - mean, 2)) for v in values])
    return F.sqrt(F.try_divide(squares, _count(values)))


def row_slope(values: list[Column], years: list[Column], mean: Column, mean_year: Column) -> Column:
    """Least-squares slope over the non-null years, null below two of them.

    ``years`` are null where the value is.
    """
    cross = _total([_zero_if_null((x - mean_year) * (v - mean)) for x, v in zip(years, values)])
    spread = _total([_zero_if_null(F.pow(x - mean_year, 2)) for x in years])
    return F.try_divide(cross, spread)


def attribute_rows(annual: DataFrame) -> DataFrame:
    """Distinct attribute rows; a station may keep several.

    Values are compared as the kinds of their columns: ``.1`` and ``0.10`` are one.
    """
    rows = cut_lineage(annual.select(*ATTRIBUTE_COLUMNS))
    kinds = column_kinds(rows, ATTRIBUTE_COLUMNS)
    return rows.select(*[as_kind(c, kinds[c]).alias(c) for c in ATTRIBUTE_COLUMNS]).distinct()


def merge_stations(old: DataFrame, new: DataFrame, annual: DataFrame) -> DataFrame:
    """Both volume tables joined in full, then the attributes, fan-out kept; keys are compared as what they hold."""
    old = rename_truck_columns(clean_headers(old))
    volumes = null_safe_join(old, clean_headers(new), STATION_KEYS, "full", typed=True)
    attributes = attribute_rows(clean_headers(annual))
    return null_safe_join(volumes, attributes, ["STATION_ID"], "left", ("_x", "_y"), typed=True)


def merge_report(merged: DataFrame) -> dict:
    """What a merge of volume tables kept and lost: its years, and those both tables had, which no feature uses."""
    return {"years": volume_years(merged.columns), "lost_years": lost_years(merged.columns)}


def typed_stations(merged: DataFrame, prefer: str = "serving") -> DataFrame:
    """Coordinates chosen by ``prefer``; year and factor columns as numbers."""
    columns = merged.columns
    lat = coordinate_name(columns, LATITUDE_NAMES, prefer)
    lon = coordinate_name(columns, LONGITUDE_NAMES, prefer)
    if lat is None or lon is None:
        raise ValueError("No coordinate columns found.")
    numbers = [f"AADT_{y}" for y in volume_years(columns)] + [f"TRUCK_{y}" for y in truck_years(columns)]
    numbers += [c for c in ("KFACTOR", "DFACTOR") if c in columns]
    typed = {c: number_column(merged, c) for c in numbers}
    return merged.withColumns(typed | {"LAT": number_column(merged, lat), "LON": number_column(merged, lon)})


def yearly_features(typed: DataFrame) -> DataFrame:
    years, trucks = volume_years(typed.columns), truck_years(typed.columns)
    latest = years[-1]
    rolling = [F.col(f"AADT_{y}") for y in years[-ROLLING_YEARS:]]
    sloped = [F.col(f"AADT_{y}") for y in years[-SLOPE_YEARS:]]
    # counted from the first year, for accuracy
    offsets = [F.when(v.isNotNull(), float(y - years[0])) for v, y in zip(sloped, years[-SLOPE_YEARS:])]
    truck_latest = F.col(f"TRUCK_{latest}") if latest in trucks else F.lit(None).cast("double")
    means = typed.withColumns(
        {
            "AADT_LATEST": F.col(f"AADT_{latest}"),
            "AADT_MEAN_3YR": row_mean(rolling),
            "TRUCK_PCT_MEAN": row_mean([F.col(f"TRUCK_{y}") for y in trucks]),
            "TRUCK_PCT_LATEST": truck_latest,
            "_mean": row_mean(sloped),
            "_mean_year": row_mean(offsets),
        }
    )
    return means.withColumns(
        {
            "AADT_STD_3YR": row_std(rolling, F.col("AADT_MEAN_3YR")),
            "AADT_TREND_SLOPE": row_slope(sloped, offsets, F.col("_mean"), F.col("_mean_year")),
        }
    ).drop("_mean", "_mean_year")


def station_table(old: DataFrame, new: DataFrame, annual: DataFrame, prefer: str = "serving") -> DataFrame:
    """All stations with features. Training uses this table as it is."""
    return yearly_features(typed_stations(merge_stations(old, new, annual), prefer))


def located(stations: DataFrame) -> DataFrame:
    """Stations with coordinates, the ones trips can be scored against."""
    return stations.dropna(subset=["LAT", "LON"])


def feature_contract(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Contract columns in order, absent ones as null; ``keep`` columns come first."""

    def feature(name: str, kind: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)

    return df.select(
        *(keep or []),
        *[feature(c, "double") for c in NUMERIC_FEATURES],
        *[feature(c, "string") for c in CATEGORICAL_FEATURES],
    )
