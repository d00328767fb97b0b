"""Helpers shared by the operators: numbered tables, words, seeded hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.session import new_folder

#: row ids hold the number of the partition that wrote a row above this bit, its place there below
PART_BITS = 33

#: bytes between words become spaces, A-Z become a-z; every byte of a non-ASCII character belongs to a word
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def numbered(df: DataFrame, doc: list[str] | None = None, **columns: Column) -> DataFrame:
    """``df`` written to the shared folder as (doc, row_id, *columns) and read back.

    ``doc`` holds the named columns of ``df`` (all by default) as one struct, so
    that no name can clash. ``row_id`` is unique and stored with the row: later
    scans see the same ids however the files are split and whoever is lost.
    """
    spark = df.sparkSession
    path = new_folder(spark, "numbered")
    kept = [df[c] for c in (df.columns if doc is None else doc)]
    df.select(
        (F.struct(*kept) if kept else F.lit(None).cast("boolean")).alias("doc"),
        F.monotonically_increasing_id().alias("row_id"),
        *[c.alias(name) for name, c in columns.items()],
    ).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def with_columns(df: DataFrame, doc: str, **columns: Column) -> DataFrame:
    """The fields of the struct ``doc`` and the given columns, which replace fields of their name."""
    fields = [f for f in df.schema[doc].dataType.fieldNames() if f not in columns]
    return df.select(*[F.col(doc)[f].alias(f) for f in fields], *[c.alias(n) for n, c in columns.items()])


def words(text: str | None) -> list[bytes]:
    """Lower-cased words, each a run of digits, letters a-z and non-ASCII characters; none for null."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def mix64(x: np.ndarray | int) -> np.ndarray:
    """Scatters 64-bit integers; equal inputs give equal outputs on every machine."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
