"""Mixing sources to target weights by the cube method.

A source whose target is r times its size takes each document floor(r) times and
once more with probability r - floor(r). Which documents get the extra copy is a
balanced sample: probabilities move through the null-space of two constraints,
the source's expected words and its expected documents, so each step settles a
document at 0 or 1 and leaves both totals as they were. At most two documents of
a group stay open, its smallest; the groups' open documents are merged and moved
on, until one group a source is left and its last document is drawn.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripflow.llm.common import documents, numbered, stored, with_columns

#: probabilities this near to 0 or 1 are settled
SETTLED = 1e-9
#: open documents that share in one move
WINDOW = 32
#: documents a group starts with, and groups merged at each further level
GROUP_ROWS = 1 << 14
FAN_IN = 1 << 10


def size_of(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, repeats: int) -> DataFrame:
    """(source, place, source_size, n_docs, target) for rows (source, size).

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share the
    sum of all sizes; a target stops at ``repeats`` times its source's size and
    the rest is shared again. With caps sorted by cap / weight, the ones below
    the common level are the ones that stop, so the level is found in one pass.
    Both windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", F.col("place") % 3 + 1)
    cap = repeats * F.col("source_size")
    by_ratio = W.orderBy(cap / F.col("weight"), "place")
    lower, everything = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(lower), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(lower), F.lit(0))
    )
    levels = ranked.withColumn("level", F.when(cap / F.col("weight") >= level, level))
    # above the first source that does not stop, every source shares that source's level
    common = F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.currentRow))
    return levels.select(
        "source", "place", "source_size", "n_docs", F.coalesce(common * F.col("weight"), cap).cast("double").alias("target")
    )


def null_direction(head: float, others: np.ndarray) -> np.ndarray:
    """How ``others`` move per unit that the head moves, so that count and words stay.

    The smallest such move; all of one size move alike.
    """
    n, mean = len(others), others.mean()
    spread = ((others - mean) ** 2).sum()
    if spread > 0:
        return -1 / n - (others - mean) * (head - mean) / spread
    return np.full(n, -1 / n)


def flight(size: np.ndarray, prob: np.ndarray, seed: int, land: bool) -> np.ndarray:
    """Settled probabilities, all but two at most; with ``land`` those too.

    Documents are settled from the largest to the smallest. The head moves along
    the null-space of the constraints over itself, the next ``WINDOW`` open
    documents and the smallest one until one of them reaches 0 or 1; which way is drawn so that every
    probability keeps its mean. The last open document is the smallest, so its
    draw hardly changes a total. A larger one after which all others are of one
    size is drawn alone, or without ``land`` left open.
    """
    order = np.argsort(-size, kind="stable")
    sizes, out = size[order].astype(float), prob[order].astype(float)
    coins = np.random.default_rng(seed).random(2 * len(out) + 1).tolist()
    left = int(((out > 0) & (out < 1)).sum())

    last = len(out) - 1

    def following(at: int) -> np.ndarray:
        """The next open documents, from those that directly follow to any later one, and the last."""
        nonlocal last
        while last > at and not 0 < out[last] < 1:
            last -= 1
        reach = 2 * WINDOW
        while True:
            near = np.arange(at + 1, min(at + 1 + reach, last + 1))
            near = near[(out[near] > 0) & (out[near] < 1)][:WINDOW]
            if len(near) or at + reach >= last:
                return np.append(near, last) if len(near) and near[-1] != last else near
            reach *= 2

    for head in range(len(out)):
        if left <= (0 if land else 2):
            break
        if not 0 < out[head] < 1:
            continue
        while 0 < out[head] < 1 and len(rest := following(head)):
            if sizes[rest[0]] == sizes[rest[-1]] != sizes[head]:
                break  # all others are of one size, so no move keeps both totals
            group = np.concatenate([[head], rest])
            direction = np.concatenate([[1.0], null_direction(sizes[head], sizes[rest])])
            speed = np.maximum(np.abs(direction), 1e-300)
            up, down = (1 - out[group]) / speed, out[group] / speed
            ahead = np.where(direction > 0, up, down).min()
            back = np.where(direction > 0, down, up).min()
            step = ahead if coins.pop() * (ahead + back) < back else -back
            moved = out[group] + step * direction
            done = (moved < SETTLED) | (moved > 1 - SETTLED)
            done[np.argmin(np.minimum(moved, 1 - moved))] = True
            out[group] = np.where(done, np.round(moved), moved)
            left -= int(done.sum())
        if 0 < out[head] < 1 and (land or not len(following(head))):
            out[head] = float(coins.pop() < out[head])
            left -= 1
    settled = np.empty(len(out))
    settled[order] = out
    return settled


def copies(sizes: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """(row_id, copies) for rows (row_id, key, source, size); ``targets`` from ``source_targets``.

    Draws follow ``key``, so they do not depend on how rows are dealt over files
    and tasks; rows of one key are interchangeable.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = targets.select(F.col("source").alias("name"), "place", ratio.alias("ratio"), "n_docs")
    units = sizes.join(goal, sizes["source"].eqNullSafe(goal["name"])).select(
        "row_id",
        "key",
        "size",
        "place",
        F.floor("ratio").cast("int").alias("whole"),
        (F.col("ratio") - F.floor("ratio")).alias("prob"),
        F.pmod(F.xxhash64("key", F.lit(seed)), F.ceil(F.col("n_docs") / GROUP_ROWS)).alias("grp"),
    )
    schema = "row_id long, key long, size long, place int, whole int, prob double, grp long"

    def settle(land: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            key = zlib.crc32(f"{seed}/{pdf['place'].iat[0]}/{pdf['grp'].iat[0]}/{land}".encode())
            pdf = pdf.sort_values(["key", "row_id"], kind="stable")
            return pdf.assign(prob=flight(pdf["size"].to_numpy(), pdf["prob"].to_numpy(), key, land))

        return run

    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    groups = math.ceil(largest / GROUP_ROWS)
    settled = None
    while True:
        last = groups <= 1
        level = stored(units.groupBy("place", "grp").applyInPandas(settle(last), schema), "flight")
        done = level if last else level.where("prob in (0.0, 1.0)")
        done = done.select("row_id", (F.col("whole") + F.col("prob")).cast("int").alias("copies"))
        settled = done if settled is None else settled.unionByName(done)
        if last:
            return settled
        units = level.where("prob not in (0.0, 1.0)").withColumn("grp", F.floor(F.col("grp") / FAN_IN))
        groups = math.ceil(groups / FAN_IN)


def _sized(docs: DataFrame, keep: list[str] | None) -> DataFrame:
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    doc_id = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long")
    # rows without an id are told apart by their place, lest one key holds many of them
    key = F.xxhash64(doc_id, "text", F.when(doc_id.isNull(), F.monotonically_increasing_id()))
    return numbered(docs, keep, source=source, key=key, size=size_of(F.col("text")))


def mix(docs: DataFrame, repeats: int = 3, seed: int = 0) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as it is taken, columns unchanged.

    A null source is a source of its own; a null or empty text has no words and
    is balanced by its count alone, in a source without words it is not taken.
    Ties and repeated rows are drawn one by one. The draw follows the rows' ids
    and texts, so it is the same however the table is dealt over tasks; only rows
    without an id are drawn by position.
    An empty table stays empty.
    """
    table = _sized(docs, None)
    narrow = table.select("row_id", "key", "source", "size")
    targets = stored(source_targets(narrow, repeats), "targets")
    drawn = copies(narrow, targets, seed).where("copies > 0")
    rows = table.select("row_id", "doc").join(drawn.hint("shuffle_hash"), "row_id")
    return with_columns(rows.select("doc", F.explode(F.expr("sequence(1, copies)")).alias("nth")), "doc")


def op2_mixing(spark, sf_dir):
    table = _sized(documents(spark, sf_dir), ["doc_id"])
    narrow = table.select("row_id", "key", "source", "size")
    targets = stored(source_targets(narrow, 3), "targets")
    drawn = copies(narrow, targets, 0)
    goal = targets.select(F.col("source").alias("name"), "source_size", "target")
    rows = table.join(drawn, "row_id").join(goal, table["source"].eqNullSafe(goal["name"]))
    return rows.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
