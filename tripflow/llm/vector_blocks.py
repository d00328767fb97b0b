"""Helpers for searches among vectors: checked rows, centres, packed blocks and pairs of blocks.

A block is one row that holds a bounded number of vectors as packed binary
columns, so a join moves few large rows and a task holds one pair at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows and values of the sample that centres are fitted on, at most
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 4_000_000
#: bytes of packed rows in a tile, and tiles at least
TILE_BYTES, TILES = 16 << 20, 32


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    inside = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & inside, F.lit(False))


def padded(vector: str, length: int) -> Column:
    """Components as doubles; a vector shorter than the longest one counts as ending in zeros."""
    own = F.transform(vector, lambda x: x.cast("double"))
    return F.concat(own, F.array_repeat(F.lit(0.0), F.lit(length) - F.size(vector)))


def matrix(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    """One row of doubles for each list of ``length`` components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def sample(rows: DataFrame, n: int, length: int) -> np.ndarray:
    """Vectors of about SAMPLE_ROWS of the ``n`` rows (vec_id, v), chosen by a hash of the id; all of a small table."""
    most = min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // max(1, length)))
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int((1 << 30) * most / n)).limit(2 * most)
    got = rows.select("v").toArrow()
    return matrix(got.column("v"), length) if got.num_rows else np.zeros((0, length))


def centres(x: np.ndarray, most: int, rounds: int = 8) -> np.ndarray:
    """At most ``most`` centres by Lloyd's rounds from evenly spaced distinct rows of ``x``."""
    x = np.unique(x, axis=0)
    order = np.random.default_rng(7).permutation(len(x))
    c = x[order[:most]].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        order = np.argsort(at, kind="stable")
        owned, starts = np.unique(at[order], return_index=True)
        c[owned] = np.add.reduceat(x[order], starts) / np.diff([*starts, len(x)])[:, None]
    return c


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres, less the rows' own squares."""
    return (c * c).sum(1)[None, :] - 2 * (x @ c.T)


def nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([squares(x[at : at + step], c).argmin(1) for at in range(0, len(x), step)] or [np.zeros(0, int)])


def packs(rows: DataFrame, cell: str, most: int, fields: list[str]) -> DataFrame:
    """(cell, part, n, *fields): the rows of each cell in parts of about ``most``, each field packed into one binary.

    A crowded cell is split by row, so no task holds a cell of unbounded size.
    ``cell`` must have few values: their counts are broadcast. Longs, ints and
    doubles are packed as 8-byte numbers, lists of doubles one after the other.
    """
    counts = rows.groupBy(cell).agg(F.count("*").alias("rows_of_cell"))
    parts = F.ceil(F.col("rows_of_cell") / most).cast("long")
    dealt = rows.join(F.broadcast(counts), cell).select(
        F.col(cell).cast("long").alias("cell"), F.pmod(F.xxhash64("row_id"), parts).cast("long").alias("part"), *fields
    )

    def pack(table: pa.Table) -> pa.Table:
        out = {"cell": table.column("cell")[:1], "part": table.column("part")[:1], "n": pa.array([table.num_rows], pa.int64())}
        for f in fields:
            column = table.column(f).combine_chunks()
            column = column.flatten() if pa.types.is_list(column.type) else column
            values = column.to_numpy(zero_copy_only=False)
            out[f] = pa.array([values.astype(np.int64 if values.dtype.kind in "iu" else np.float64).tobytes()], pa.binary())
        return pa.table(out)

    schema = "cell long, part long, n long, " + ", ".join(f"{f} binary" for f in fields)
    return dealt.groupBy("cell", "part").applyInArrow(pack, schema)


def paired(queries: DataFrame, blocks: DataFrame, bytes_of_blocks: int) -> DataFrame:
    """Each block of queries beside each block of rows, whose columns get the prefix ``x_``.

    Blocks are dealt over tiles and the queries are sent to every tile, so each
    shuffled row is a bounded block and tiles are alike in size. The number of
    partitions is given, for it follows the work of the pairs, not their bytes.
    """
    tiles = max(TILES, math.ceil(bytes_of_blocks / TILE_BYTES))
    right = blocks.select(F.pmod(F.xxhash64("cell", "part"), F.lit(tiles)).cast("int").alias("tile"), *[F.col(c).alias(f"x_{c}") for c in blocks.columns])
    left = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    return left.repartition(tiles, "tile").join(right.repartition(tiles, "tile"), "tile")


def unpacked(value: pa.Scalar, dtype: type, length: int | None = None) -> np.ndarray:
    out = np.frombuffer(value.as_buffer(), dtype)
    return out if length is None else out.reshape(-1, length)


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of each group by score descending, then id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(start, np.diff([*start, len(g)]))
    return order[rank < k]
