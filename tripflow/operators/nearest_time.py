"""Nearest-in-time lookup of a log row for every point in time, both directions.

As with stations, the log is turned once into an index: time cells with the few
moments that can be nearest to some instant in the cell (those inside, the last
one before, the first one after). Days with few moments are one cell; busy days
are cut into hours, minutes or seconds until the lists are short. A point looks
up its one cell, so a third of all points at the same instant is no problem:
points are neither sorted nor grouped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripflow.session import cut_lineage

MICROS = 1_000_000
DAY = 86_400 * MICROS
HOUR = 3_600 * MICROS
CELL_WIDTHS = [DAY, HOUR, 60 * MICROS, MICROS]  # each divides the one before


@dataclass(frozen=True)
class TimeIndex:
    cells: DataFrame  # width, cell, near: array<struct<at, row>>
    days: DataFrame  # day, width of the cells on that day
    first: int | None  # earliest and latest moment, null for an empty log
    last: int | None
    broadcast_cells: bool


def _floor_div(micros: Column, width: Column | int) -> Column:
    """Integer division rounding down, exact for any microsecond count."""
    width = F.lit(width) if isinstance(width, int) else width
    return ((micros - F.pmod(micros, width)) / width).cast("long")


def distinct_moments(log: DataFrame, ts: Column, newest: Column, payload: list[Column]) -> DataFrame:
    """One row per moment: of rows logged for the same moment the newest one.

    A plain aggregate, so the copies a forecast leaves in every snapshot are
    merged before anything is shuffled.
    """
    return (
        log.where(ts.isNotNull())
        .groupBy(F.unix_micros(ts).alias("at"))
        .agg(F.max(F.struct(newest.alias("_newest"), *payload)).alias("row"))
    )


def _with_neighbours(moments: DataFrame) -> DataFrame:
    """Each moment with the one before and after it.

    Sorting happens hour by hour; only one summary row per hour of the log is
    ordered as a whole.
    """
    hourly = moments.withColumn("hour", _floor_div(F.col("at"), HOUR))
    hours = hourly.groupBy("hour").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    across = W.orderBy("hour")
    carried = hours.select(
        "hour",
        F.lag("last").over(across).alias("before_hour"),
        F.lead("first").over(across).alias("after_hour"),
    )
    within = W.partitionBy("hour").orderBy("at")
    return hourly.join(carried, "hour").select(
        "at",
        "row",
        F.coalesce(F.lag("at").over(within), "before_hour").alias("before"),
        F.coalesce(F.lead("at").over(within), "after_hour").alias("after"),
    )


def _day_widths(moments: DataFrame, first: int, last: int, list_target: int) -> DataFrame:
    """Cell width for every day of the log: the widest whose cells are all short enough."""
    spark = moments.sparkSession
    days = spark.range(first // DAY, last // DAY + 1).withColumnRenamed("id", "day")
    counts = moments.groupBy(_floor_div(F.col("at"), CELL_WIDTHS[-1]).alias("cell")).count()
    fullest = []
    for width in CELL_WIDTHS[:-1]:
        per_cell = counts.groupBy(_floor_div(F.col("cell"), width // MICROS).alias("cell")).agg(
            F.sum("count").alias("n")
        )
        fullest.append(
            per_cell.groupBy(_floor_div(F.col("cell"), DAY // width).alias("day")).agg(
                F.max("n").alias("n")
            ).where(F.col("n") <= list_target).select("day", F.lit(width).alias("width"))
        )
    fitting = reduce(DataFrame.union, fullest).groupBy("day").agg(F.max("width").alias("width"))
    occupied = counts.select(_floor_div(F.col("cell"), 86_400).alias("day"), F.lit(True).alias("occupied")).distinct()
    return (
        days.join(occupied, "day", "left")
        .join(fitting, "day", "left")
        .select(
            "day",
            F.when(F.col("occupied").isNull(), DAY)
            .otherwise(F.coalesce("width", F.lit(CELL_WIDTHS[-1])))
            .alias("width"),
        )
    )


def build_time_index(
    moments: DataFrame, list_target: int = 32, broadcast_bytes: int = 64 << 20
) -> TimeIndex:
    """Index over the result of ``distinct_moments``."""
    moments = cut_lineage(moments)
    ends = moments.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    first, last = ends["first"], ends["last"]
    if first is None:
        return TimeIndex(moments, moments, None, None, True)
    days = cut_lineage(_day_widths(moments, first, last, list_target))
    # a moment matters to every cell between its two neighbours, their cells included
    spans = _with_neighbours(moments).select(
        "at",
        "row",
        F.coalesce("before", "at").alias("from"),
        F.coalesce("after", "at").alias("to"),
    )
    per_day = (
        spans.withColumn(
            "day", F.explode(F.sequence(_floor_div(F.col("from"), DAY), _floor_div(F.col("to"), DAY)))
        )
        .join(F.broadcast(days), "day")  # one row per day of the log: bounded
        .withColumns(
            {
                "from": F.greatest("from", F.col("day") * DAY),
                "to": F.least("to", (F.col("day") + 1) * DAY - 1),
            }
        )
    )
    cells = (
        per_day.withColumn(
            "cell",
            F.explode(F.sequence(_floor_div(F.col("from"), F.col("width")), _floor_div(F.col("to"), F.col("width")))),
        )
        .groupBy("width", "cell")
        .agg(F.collect_list(F.struct("at", "row")).alias("near"))
    )
    cells = cut_lineage(cells)
    size = cells.agg(F.count("*").alias("cells"), F.sum(F.size("near")).alias("entries")).first()
    return TimeIndex(cells, days, first, last, size["cells"] * 64 + size["entries"] * 128 <= broadcast_bytes)


def nearest_in_time(points: DataFrame, index: TimeIndex, ts: Column) -> DataFrame:
    """``points`` plus ``nearest``: struct of ``at`` (microseconds) and ``row``, null for an empty log.

    Of two equally near moments the earlier one is taken.
    """
    if index.first is None:
        kind = index.cells.select(F.struct("at", "row").alias("s")).schema["s"].dataType
        return points.withColumn("nearest", F.lit(None).cast(kind))
    cells = index.cells.withColumnsRenamed({"width": "_width", "cell": "_cell", "near": "_near"})
    days = index.days.withColumnsRenamed({"day": "_day", "width": "_width"})
    if index.broadcast_cells:
        cells = F.broadcast(cells)
    at = F.col("_at")
    nearest = F.array_min(
        F.transform(
            "_near", lambda m: F.struct(F.abs(m["at"] - at).alias("gap"), m["at"].alias("at"), m["row"].alias("row"))
        )
    )
    return (
        points.withColumn("_at", F.unix_micros(ts))
        # before the first and after the last moment the end cells decide
        .withColumn("_inside", F.when(at.isNotNull(), F.greatest(F.lit(index.first), F.least(F.lit(index.last), at))))
        .withColumn("_day", _floor_div(F.col("_inside"), DAY))
        .join(F.broadcast(days), "_day", "left")
        .withColumn("_cell", _floor_div(F.col("_inside"), F.col("_width")))
        .join(cells, ["_width", "_cell"], "left")
        .withColumn("_best", nearest)
        .withColumn("nearest", F.when(F.col("_best").isNotNull(), F.struct("_best.at", "_best.row")))
        .select(*points.columns, "nearest")
    )
