"""Approximate nearest neighbours by an adaptive dimension scan of inverted lists.

Vectors are scaled and get one more component that gives all of them the same
length, so that the largest inner product is the smallest distance. A random
rotation spreads each distance evenly over the components; the index keeps the
rotated vectors of each list in blocks of columns. A query scans its nearest
lists block by block: after t of D columns the partial square, scaled by D/t,
estimates the whole, and a candidate whose estimate is beyond the query's radius
by more than chance allows is abandoned. What is left is scored exactly.

The radius is that of the k-th best in the query's own list, so it is known
before the other lists are read and does not depend on what a task sees first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripflow.llm.common import numbered, stored
from tripflow.llm.vector_blocks import centres, finite, first_of_each, matrix, nearest, packs, padded, paired, sample, squares, unpacked

#: share of the lists that a query scans, and how many it scans at least
PROBED, PROBED_LISTS = 0.6, 64
#: columns in a block; width of the test in standard errors
COLUMNS, WIDTH = 16, 2.1
#: vectors of a list in one block, queries in one block
BLOCK, QUERIES = 2048, 512
#: sampled vectors for each list at least
PER_LIST = 16

_HITS = "query_row long, query_id long, vec_id long, score double"


@dataclass
class Space:
    """What places a vector: the longest length, scale, largest square, rotation and the centres of the lists."""

    length: int
    scale: float
    square: float
    rotation: np.ndarray
    centres: np.ndarray

    def rotated(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Scaled vectors with their further component, rotated; that component of a query is 0."""
        x = x / self.scale
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.square - (x * x).sum(1)))
        return np.column_stack([x, rest]) @ self.rotation


@dataclass
class Index:
    """``rows`` (row_id, vec_id, query, v) and their ``blocks`` by list."""

    space: Space
    n: int
    rows: DataFrame
    blocks: DataFrame


def vector_rows(df: DataFrame, query: Column, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(row_id, vec_id, v, query) of the rows that take part: with an id and a finite vector other than zero."""
    used = df.withColumn("_query", F.coalesce(query, F.lit(False))).where(
        finite(vector) & F.exists(vector, lambda x: x != 0) & F.col(vec_id).isNotNull()
    )
    own = F.transform(vector, lambda x: x.cast("double"))
    return numbered(used, [], vec_id=F.col(vec_id).cast("long"), v=own, query=F.col("_query")).drop("doc")


def build_index(rows: DataFrame) -> Index | None:
    """The index of all stored rows; its centres come from a sample of at most SAMPLE_ROWS rows. None without rows."""
    n, length, scale = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return None
    rows = rows.withColumn("v", padded("v", length))
    square = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale)))).first()[0]
    rotation = np.linalg.qr(np.random.default_rng(11).standard_normal((length + 1, length + 1)))[0]
    space = Space(length, scale, square, rotation, np.zeros((1, length + 1)))
    drawn = space.rotated(sample(rows, n, length), False)
    if len(drawn):
        space.centres = centres(drawn, max(1, min(round(math.sqrt(n)), len(drawn) // PER_LIST)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = nearest(space.rotated(matrix(batch.column("v"), length), False), space.centres)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("vec_id"), batch.column("v"), pa.array(at, pa.int64())], ["row_id", "vec_id", "v", "list"])

    def by_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v"):
                r = space.rotated(unpacked(v, np.float64, length), False).astype(np.float32)
                out.append(b"".join(np.ascontiguousarray(r[:, c : c + COLUMNS]).tobytes() for c in range(0, length + 1, COLUMNS)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "rotated"])

    listed = rows.mapInArrow(place, "row_id long, vec_id long, v array<double>, list long")
    packed = packs(stored(listed, "listed"), "list", BLOCK, ["row_id", "vec_id", "v"])
    schema = "cell long, part long, n long, row_id binary, vec_id binary, v binary, rotated binary"
    return Index(space, n, rows, stored(packed.mapInArrow(by_columns, schema), "lists"))


def query_rows(index: Index) -> DataFrame:
    """(row_id, vec_id, v, list, reach): each query with its nearest list and the distance of the last list it scans."""
    space = index.space
    probes = min(len(space.centres), max(PROBED_LISTS, math.ceil(PROBED * len(space.centres))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = squares(space.rotated(matrix(batch.column("v"), space.length), True), space.centres)
            reach = np.partition(away, probes - 1, axis=1)[:, probes - 1]
            arrays = [batch.column(c) for c in ("row_id", "vec_id", "v")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(away.argmin(1), pa.int64()), pa.array(reach)], ["row_id", "vec_id", "v", "list", "reach"])

    found = index.rows.where("query").select("row_id", "vec_id", "v")
    return stored(found.mapInArrow(place, "row_id long, vec_id long, v array<double>, list long, reach double"), "queries")


def _radii(space: Space, k: int) -> Callable:
    """For pairs of queries and a block of their own list: (row_id, radius), the square within which k others lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                get = lambda c, t=np.int64, n=None: unpacked(batch.column(c)[at], t, n)  # noqa: E731, B023
                q, x = get("v", np.float64, space.length) / space.scale, get("x_v", np.float64, space.length) / space.scale
                s = q @ x.T
                s[get("row_id")[:, None] == get("x_row_id")[None, :]] = -np.inf
                best = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(get("row_id")), pa.array((q * q).sum(1) + space.square - 2 * best)], ["row_id", "radius"])

    return run


def survivors(q: np.ndarray, blocks: list[np.ndarray], radius: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) positions that no test abandons.

    ``q`` holds rotated queries, ``blocks`` the column blocks of the vectors,
    ``ask`` whether a query scans this list at all. While most pairs are alive
    a block is one matrix product; later only the pairs that are left are taken.
    """
    own = np.flatnonzero(ask)
    q, radius = q[own], radius[own]
    length, t = q.shape[1], 0
    limit = lambda t: radius * (1.0 if t == length else (1 + WIDTH / math.sqrt(t)) ** 2 * t / length) * (1 + 1e-5) + 1e-6
    partial, a, b = None, None, None
    for block in blocks:
        part = q[:, t : t + block.shape[1]]
        t += block.shape[1]
        if a is None:
            step = (part * part).sum(1)[:, None] + (block * block).sum(1)[None, :] - 2 * (part @ block.T)
            partial = step if partial is None else partial + step
            alive = partial <= limit(t)[:, None]
            if 4 * alive.sum() < alive.size or t == length or not alive.size:
                a, b = np.nonzero(alive)
                partial = partial[a, b]
        else:
            d = part[a] - block[b]
            partial = partial + np.einsum("ij,ij->i", d, d)
            alive = partial <= limit(t)[a]
            a, b, partial = a[alive], b[alive], partial[alive]
    return own[a], b


def _scan(space: Space, k: int) -> Callable:
    """For pairs of query block and list block: the k best hits of each query that scans the list."""
    widths = [min(COLUMNS, space.length + 1 - c) for c in range(0, space.length + 1, COLUMNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                get = lambda c, t=np.int64, n=None: unpacked(batch.column(c)[at], t, n)  # noqa: E731, B023
                q, n = get("v", np.float64, space.length), batch.column("x_n")[at].as_py()
                turned = space.rotated(q, True).astype(np.float32)
                centre = space.centres[batch.column("x_cell")[at].as_py()]
                ask = squares(space.rotated(q, True), centre[None, :])[:, 0] <= get("reach", np.float64) + 1e-9
                flat, blocks, start = get("x_rotated", np.float32), [], 0
                for w in widths:
                    blocks.append(flat[start : start + n * w].reshape(n, w))
                    start += n * w
                a, b = survivors(turned, blocks, get("radius", np.float64).astype(np.float32), ask)
                rows, ids = get("row_id"), get("x_vec_id")
                other = rows[a] != get("x_row_id")[b]
                a, b = a[other], b[other]
                score = np.empty(len(a))
                x = get("x_v", np.float64, space.length)
                for s in range(0, len(a), 1 << 16):
                    score[s : s + (1 << 16)] = (q[a[s : s + (1 << 16)]] * x[b[s : s + (1 << 16)]]).sum(1)
                best = first_of_each(a, score, ids[b], k)
                a, b = a[best], b[best]
                yield pa.RecordBatch.from_arrays([pa.array(rows[a]), pa.array(get("vec_id")[a]), pa.array(ids[b]), pa.array(score[best])], ["query_row", "query_id", "vec_id", "score"])

    return run


def search(index: Index, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best found for each row marked as a query, itself left out."""
    space = index.space
    bytes_of_row = 12 * (space.length + 1) + 16
    asked = query_rows(index)
    near = packs(asked, "list", QUERIES, ["row_id", "v"]).select("cell", "row_id", "v")
    firsts = index.blocks.where("part = 0").select("cell", F.col("row_id").alias("x_row_id"), F.col("v").alias("x_v"))
    radii = near.join(firsts, "cell").mapInArrow(_radii(space, k), "row_id long, radius double")
    # a list of crowded cells has queries in several packs but one first block, so a query has one radius
    ready = asked.join(radii, "row_id", "left").select("row_id", "vec_id", "v", "reach", F.coalesce("radius", F.lit(float("inf"))).alias("radius"), F.lit(0).alias("all"))
    blocks = packs(stored(ready, "asked"), "all", QUERIES, ["row_id", "vec_id", "v", "reach", "radius"]).drop("cell", "part", "n")
    hits = paired(blocks, index.blocks, index.n * bytes_of_row).mapInArrow(_scan(space, k), _HITS)
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_vectors(df: DataFrame, query: Column, k: int, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``query`` holds, the ``k`` rows of the largest inner product found.

    Every row is indexed. A query scans 0.6 of the lists (PROBED), 64 or all of
    fewer at least; ties go to the smaller id. Rows without an id, and vectors that are null, zero or empty
    or hold a null or non-finite component take no part. Vectors of different
    lengths are compared as if the shorter ended in zeros. Repeated rows are
    rows of their own: each is a candidate for the others, and a query if
    ``query`` holds, under the same id. Other columns are not read. Without
    rows the result is empty.
    """
    index = build_index(vector_rows(df, query, vector, vec_id))
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, k)


def op11_nearest_vectors(spark, sf_dir):
    """The 20 nearest found of each embedding whose id is divisible by 20, by largest inner product."""
    return nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)
