"""Running totals, exact quantiles and modes over tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripflow.session import cut_lineage


def running_totals(df: DataFrame, group: list[str], order: str, values: list[str]) -> DataFrame:
    """Adds ``<value>_before`` and ``<value>_total``: sums of the rows ranked lower, and of the group.

    (group, order) must be unique; aggregate first. The rows are range
    partitioned, summed per range, and the per-range sums are added on: no task
    ever holds a whole group, however few groups there are.
    """
    ranges = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in [*group, order]]).withColumn("_range", F.spark_partition_id())
    )
    sums = ranges.groupBy(*group, "_range").agg(*[F.sum(v).alias(v) for v in values])
    whole = W.partitionBy(*group)
    lower = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *group,
        "_range",
        *[F.coalesce(F.sum(v).over(lower), F.lit(0)).alias(f"{v}_offset") for v in values],
        *[F.sum(v).over(whole).alias(f"{v}_total") for v in values],
    )
    inside = W.partitionBy(*group, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    # one row per group and partition, a size fixed by the partition count
    return ranges.join(F.broadcast(offsets), [*group, "_range"]).select(
        *df.columns,
        *[
            (F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"{v}_offset")).alias(f"{v}_before")
            for v in values
        ],
        *[f"{v}_total" for v in values],
    )


def exact_quantiles(df: DataFrame, columns: list[str], p: float) -> DataFrame:
    """(name, quantile) per column: exact, linear between neighbours, nulls ignored.

    Values are first counted, so copies cost nothing; a column without values
    has no row.
    """
    values = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "name", "value")
    counts = (
        values.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("name", "value").agg(F.count("*").alias("n"))
    )
    ranked = running_totals(counts, ["name"], "value", ["n"])
    position = p * (F.col("n_total") - 1)
    upto = F.col("n_before") + F.col("n")
    return (
        ranked.groupBy("name")
        .agg(
            F.min(F.when(upto > F.floor(position), F.col("value"))).alias("low"),
            F.min(F.when(upto > F.ceil(position), F.col("value"))).alias("high"),
            F.max(position - F.floor(position)).alias("part"),
        )
        .select("name", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("quantile"))
    )


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, mode) per column: the most frequent value, the smallest on ties, nulls ignored."""
    values = df.unpivot([], columns, "name", "value").where(F.col("value").isNotNull())
    counts = values.groupBy("name", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))
