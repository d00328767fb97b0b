"""Seeded, stratified train/test split with exact sizes per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_DIGITS = 4  # hexadecimal digits of the hash: 65,536 buckets per class


def test_sizes(df: DataFrame, label: str, test_size: float) -> DataFrame:
    """(label, n_test): the test set is ceil(test_size * n), shared in proportion.

    Each class gives the training set its proportional share rounded down; the
    rows then missing go to the classes with the largest remainders.
    """
    classes = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = W.partitionBy()  # one row per class
    total = F.sum("n").over(everything)
    n_train = total - F.ceil(total * F.lit(test_size))
    share = F.col("n") * n_train / total
    shares = classes.withColumns(
        {"n_train": n_train, "base": F.floor(share), "remainder": share - F.floor(share)}
    )
    missing = F.col("n_train") - F.sum("base").over(everything)
    by_remainder = W.orderBy(F.desc("remainder"), label)
    extra = F.when(F.row_number().over(by_remainder) <= missing, 1).otherwise(0)
    return shares.select(label, (F.col("n") - F.col("base") - extra).alias("n_test"))


def stratified_split(
    df: DataFrame, label: str, id_columns: list[str], test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """``df`` plus ``is_test``. ``id_columns`` must identify a row.

    Rows are ordered by a seeded hash within their class and the first n_test
    are the test set. Only the hash at which to cut is computed, from counts per
    hash bucket and the rows of the one bucket the cut falls in; the table
    itself is neither shuffled nor sorted.
    """
    hashed = df.withColumn("_hash", row_hash(id_columns, seed))
    counts = hashed.groupBy(label, F.left("_hash", F.lit(BUCKET_DIGITS)).alias("_bucket")).agg(
        F.count("*").alias("n")
    )
    upto = W.partitionBy(label).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    cut_buckets = (
        counts.withColumn("upto", F.sum("n").over(upto))
        .join(F.broadcast(test_sizes(df, label, test_size)), label)
        .where((F.col("upto") >= F.col("n_test")) & (F.col("upto") - F.col("n") < F.col("n_test")))
        .select(label, F.col("_bucket").alias("cut_bucket"), (F.col("n_test") - F.col("upto") + F.col("n")).alias("take"))
    )
    in_order = W.partitionBy(label).orderBy("_hash")
    cuts = (
        hashed.select(label, "_hash")
        .join(F.broadcast(cut_buckets), label)  # one row per class
        .where(F.left("_hash", F.lit(BUCKET_DIGITS)) == F.col("cut_bucket"))
        .withColumn("rank", F.row_number().over(in_order))
        .where(F.col("rank") == F.col("take"))
        .select(label, F.col("_hash").alias("_cut"))
    )
    return (
        hashed.join(F.broadcast(cuts), label, "left")  # one row per class
        .withColumn("is_test", F.coalesce(F.col("_hash") <= F.col("_cut"), F.lit(False)))
        .drop("_hash", "_cut")
    )


def row_hash(id_columns: list[str], seed: int) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
