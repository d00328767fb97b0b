"""Equi-joins in which null keys match null keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.operators.kinds import as_kind, column_kinds
from tripflow.session import cut_lineage

#: rows of one key and side that are brought together at most
CROWDED = 100_000


def null_safe_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    suffixes: tuple[str, str] = ("_OLD", "_NEW"),
    typed: bool = False,
    crowded: int = CROWDED,
) -> DataFrame:
    """``left`` or ``full`` outer join; shared non-key columns get the suffixes.

    Both sides are read once, into one table of tagged rows, which is grouped by
    key: matches and rows without a match come out of the same pass. The rows of
    a crowded key are dealt over parts, left rows by one number and right rows
    by another, so each pair meets in one part.

    With ``typed`` the keys are text whose kind is decided over both sides:
    ``007`` is ``7`` in a column of whole numbers, and words for missing values
    are null.
    """
    if how not in ("left", "full"):
        raise ValueError(f"unsupported join type {how}")
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})

    def side(rows: DataFrame) -> Column:
        return F.struct(F.lit(True).alias("_is"), *[F.col(c) for c in rows.columns if c not in keys])

    tagged = left.select(*keys, side(left).alias("_l")).unionByName(right.select(*keys, side(right).alias("_r")), allowMissingColumns=True)
    rows = cut_lineage(tagged.withColumn("_at", F.monotonically_increasing_id()))
    if typed:
        kinds = column_kinds(rows, keys)
        rows = rows.withColumns({k: as_kind(k, kinds[k]) for k in keys})
    rows = _dealt(rows, keys, crowded)
    groups = rows.groupBy(*keys, "_lp", "_rp").agg(
        F.collect_list("_l").alias("_ls"), F.collect_list("_r").alias("_rs"), F.bool_and("_alone").alias("_alone")
    )
    # a part of a crowded key may have one side only though the key has both
    met = groups.where(((F.size("_ls") > 0) & (F.size("_rs") > 0)) | F.col("_alone"))
    if how == "left":
        met = met.where(F.size("_ls") > 0)
    opened = met.select(*keys, "_rs", F.explode_outer("_ls").alias("_l")).select(*keys, "_l", F.explode_outer("_rs").alias("_r"))
    return opened.select(
        *[F.col(c) if c in keys else F.col(f"_l.{c}").alias(c) for c in left.columns],
        *[F.col(f"_r.{c}").alias(c) for c in right.columns if c not in keys],
    )


def _dealt(rows: DataFrame, keys: list[str], crowded: int) -> DataFrame:
    """Adds the parts ``_lp`` and ``_rp``, and ``_alone``: whether a side that is missing there is missing altogether."""
    sides = rows.groupBy(*keys).agg(F.count("_l").alias("_nl"), F.count("_r").alias("_nr"))
    hot = cut_lineage(sides.where((F.col("_nl") > crowded) | (F.col("_nr") > crowded)))
    if hot.isEmpty():
        return rows.withColumns({"_lp": F.lit(0).cast("long"), "_rp": F.lit(0).cast("long"), "_alone": F.lit(True)})
    hot = hot.withColumnsRenamed({k: f"{k}__hot" for k in keys})
    found = rows.join(hot, reduce(and_, [rows[k].eqNullSafe(hot[f"{k}__hot"]) for k in keys]), "left")
    parts = {n: F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce(n, F.lit(1)) / crowded)) for n in ("_nl", "_nr")}

    def dealt(own: str, n: str) -> Column:
        return F.when(F.col(own).isNotNull(), F.array(F.pmod("_at", parts[n]))).otherwise(F.sequence(F.lit(0).cast("long"), parts[n] - 1))

    alone = F.coalesce((F.col("_nl") == 0) | (F.col("_nr") == 0), F.lit(True))
    spread = found.select(*keys, "_l", "_r", alone.alias("_alone"), dealt("_r", "_nr").alias("_rps"), F.explode(dealt("_l", "_nl")).alias("_lp"))
    return spread.select(*keys, "_l", "_r", "_alone", "_lp", F.explode("_rps").alias("_rp"))
