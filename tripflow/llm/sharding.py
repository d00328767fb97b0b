"""Sharding by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first, so that
the sums are the exact partition and shard sizes and every outcome of a uniform
shuffle keeps its probability. Each partition then deals its own rows out in a
random order, the rows are exchanged, and each receiver permutes what it got.

The matrix is never held whole. Partitions are the leaves of a binary tree; what
a subtree sends to each shard is a multivariate hypergeometric draw from what its
parent sends, seeded by the node. A task walks from the root to its own leaf and
so gets its row of the one matrix that all tasks agree on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripflow.llm.common import PART_BITS, documents, numbered, with_columns

#: numpy's draws want fewer items than this
NUMPY_ITEMS = 10**9


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """How many of ``taken`` items drawn without replacement are good.

    Beyond numpy's range a ratio-of-uniforms rejection on log-gamma is used; its
    outcome is an exact count whose law is right to floating-point accuracy.
    """
    total = good + bad
    if total < NUMPY_ITEMS:
        return int(rng.hypergeometric(good, bad, taken)) if total else 0
    low, high = max(0, taken - bad), min(good, taken)
    if low == high:
        return low

    def log_weight(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(taken - k + 1) + math.lgamma(bad - taken + k + 1))

    mode = min(high, max(low, (taken + 1) * (good + 1) // (total + 2)))
    top = log_weight(mode)
    centre = taken * good / total + 0.5
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(
        taken * (good / total) * (bad / total) * max(0.0, (total - taken) / (total - 1)) + 0.5
    ) + (3 - 2 * math.sqrt(3 / math.e))
    while True:
        u = 1.0 - rng.random()
        k = math.floor(centre + width * (rng.random() - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_weight(k) - top:
            return k


def draw_counts(rng: np.random.Generator, colours: np.ndarray, taken: int) -> np.ndarray:
    """How many items of each colour are among ``taken`` drawn without replacement."""
    total = int(colours.sum())
    if total < NUMPY_ITEMS:
        return rng.multivariate_hypergeometric(colours, taken, method="marginals").astype(np.int64)
    out = np.zeros(len(colours), dtype=np.int64)
    for i, have in enumerate(map(int, colours)):
        if not taken:
            break
        out[i] = draw_hypergeometric(rng, have, total - have, taken)
        total, taken = total - have, taken - int(out[i])
    return out


def matrix_row(leaf: int, before: np.ndarray, receivers: np.ndarray, seed: int) -> np.ndarray:
    """Rows that partition ``leaf`` sends to each receiver.

    ``before`` are the running totals of partition sizes, from 0; ``receivers``
    the receivers' sizes, with the same sum.
    """
    lo, hi, share = 0, len(before) - 1, receivers.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw_counts(np.random.default_rng([seed, lo, hi]), share, int(before[mid] - before[lo]))
        if leaf < mid:
            hi, share = mid, left
        else:
            lo, share = mid, share - left
    return share


def receivers(rows: int, shards: int, block_rows: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, rows) of each receiver: shards in blocks of at most ``block_rows``, sizes exact."""
    out = []
    for shard in range(shards):
        size = rows // shards + (shard < rows % shards)
        out += [(shard, at, min(block_rows, size - at)) for at in range(0, size, block_rows)]
    return out


def shard(docs: DataFrame, shards: int, seed: int = 0, block_rows: int = 1 << 16) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0 up, without gaps in a shard).

    Every assignment of rows to slots is equally likely, and shard sizes differ
    by one row at most. A shard is received in blocks of at most ``block_rows``
    rows, each permuted by one task, so no task holds a large shard. What tasks
    are given besides their rows are partition counts and block sizes.

    Rows are dealt by position only, so nulls, empty or long texts, ties and
    repeated rows are rows like others. An empty table gives an empty result.
    Columns named ``shard`` or ``slot`` are replaced.
    """
    table = numbered(docs)
    part = F.shiftrightunsigned("row_id", PART_BITS)
    counts = dict(sorted(table.groupBy(part.alias("part")).count().collect()))
    place = {p: i for i, p in enumerate(counts)}
    before = np.concatenate([[0], np.cumsum(list(counts.values()), dtype=np.int64)]).astype(np.int64)
    blocks = receivers(int(before[-1]), shards, block_rows)
    sizes = np.array([b[2] for b in blocks], dtype=np.int64)

    @F.pandas_udf("int")
    def block(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        @lru_cache(maxsize=2)
        def dealt(p: int) -> np.ndarray:
            row = matrix_row(place[p], before, sizes, seed)
            labels = np.repeat(np.arange(len(sizes), dtype=np.int32), row)
            np.random.default_rng([seed, p, 1]).shuffle(labels)
            return labels

        for batch in ids:
            rows = batch.to_numpy()
            owner, at = rows >> PART_BITS, rows & ((1 << PART_BITS) - 1)
            out = np.empty(len(rows), dtype=np.int32)
            for p in np.unique(owner):
                mine = owner == p
                out[mine] = dealt(int(p))[at[mine]]
            yield pd.Series(out)

    shuffled = W.partitionBy("block").orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id")
    where = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(a).cast("long").alias("first")) for s, a, _ in blocks] or [
        F.struct(F.lit(0).alias("shard"), F.lit(0).cast("long").alias("first"))
    ])
    placed = table.withColumn("block", block("row_id")).withColumn("rank", F.row_number().over(shuffled))
    spot = where[F.col("block")]
    return with_columns(placed, "doc", shard=spot["shard"], slot=spot["first"] + F.col("rank") - 1)


def op3_sharding(spark, sf_dir):
    """Each document's place in 40 shards; a null text has no bytes."""
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")
    )
    return shard(rows, 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
