"""Wide station tables: untyped CSV scan, header clean-up, column discovery."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripflow.functions.coerce import to_number

# Year columns, the truck prefix of the older table, coordinate names.
VOLUME_YEAR = re.compile(r"^AADT_\d{4}$")
TRUCK_YEAR = re.compile(r"^TRUCK_\d{4}$")
OLD_TRUCK_PREFIX = "TRUCKPCT_"
TRUCK_PREFIX = "TRUCK_"
HEADER_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
LATITUDE_NAMES = ["LAT", "LATITUDE"]
LONGITUDE_NAMES = ["LON", "LONG", "LONGITUDE"]


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; headers cleaned. Types are applied later, per column."""
    return clean_headers(spark.read.option("header", True).option("escape", '"').csv(path))


def clean_header(name: str) -> str:
    """Capital letters, digits and underscores; blanks between other characters become underscores."""
    joined = "_".join(name.strip().split(" "))
    return "".join(c for c in joined.upper() if c in HEADER_CHARACTERS)


def clean_headers(df: DataFrame) -> DataFrame:
    names = [clean_header(c) for c in df.columns]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"headers collide after clean-up: {repeated}")
    return df.toDF(*names)


def rename_truck_columns(df: DataFrame) -> DataFrame:
    """The older table's truck columns under the prefix of the newer one."""
    for column in df.columns:
        year = column.removeprefix(OLD_TRUCK_PREFIX)
        if year != column:
            df = df.withColumnRenamed(column, TRUCK_PREFIX + year)
    return df


def number_column(df: DataFrame, name: str):
    """The column as a double with NaN as null, whatever type it arrived in."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return to_number(F.col(name))
    number = F.col(name).cast("double")
    return F.when(~F.isnan(number), number)


def coordinate_name(columns: list[str], names: list[str], prefer: str) -> str | None:
    """Which of the candidate columns supplies the coordinate.

    ``serving`` takes the first listed name that exists. ``training`` does the
    same for longitude, but lets the long latitude name override the short one.
    """
    if prefer not in ("serving", "training"):
        raise ValueError(f"unknown preference {prefer}")
    present = [n for n in names if n in columns]
    if not present:
        return None
    if prefer == "training" and names is LATITUDE_NAMES:
        return present[-1]
    return present[0]


def volume_years(columns: list[str]) -> list[int]:
    years = sorted(int(c[-4:]) for c in columns if VOLUME_YEAR.match(c))
    if not years:
        raise ValueError("the table has no yearly volume column")
    return years


def truck_years(columns: list[str]) -> list[int]:
    return sorted(int(c[-4:]) for c in columns if TRUCK_YEAR.match(c))


def lost_years(columns: list[str]) -> list[int]:
    """Years present in both volume tables: suffixed by the merge, then unused."""
    return sorted({int(c[5:9]) for c in columns if re.match(r"^AADT_\d{4}_(OLD|NEW)$", c)})
