"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction. If all anchors of a cluster are within an
angle B of its centre and a candidate of length r is at the angle t from the
centre, no anchor a of the cluster scores it above |a| r cos(max(0, t - B)).
The candidates are sorted by that bound once per cluster, and every anchor walks
the list from the top until the bound is below what it still wants: then no
candidate further down can matter, and the result is exact.

The list lies in blocks of a bounded number of candidates, each sorted by the
bound. An anchor first walks a block of its own cell; the k-th best there is a
floor that lets it leave, or skip, all other blocks early.

First the positives are found so, then the negatives: each pair of anchor and
positive is a window of scores for candidates of other labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripflow.llm.common import numbered, stored
from tripflow.llm.vector_blocks import centres, finite, first_of_each, matrix, nearest, packs, padded, paired, sample, unpacked

POSITIVES, NEGATIVES = 5, 3
#: a negative's score is between these hundredths of the positive's
LOWEST, HIGHEST = 50, 95
#: candidates in a block, windows in a block, candidates scored at a time
BLOCK, WINDOWS, STEP = 2048, 512, 256
#: clusters at most, anchors for each at least
CLUSTERS, PER_CLUSTER = 512, 64
#: a score beyond any that is reached
BEYOND = 1 << 62

_WINDOW = ["row_id", "vec_id", "label", "v", "nth", "low", "high"]


def _directions(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: as doubles where sums stay below 2**53, else as 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def walk(anchors: dict[str, np.ndarray], block: dict[str, np.ndarray], k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, candidate, score): the ``k`` best candidates of each window (low <= score <= high), all in one block.

    Windows of one anchor share its products. ``same`` asks for candidates of
    the anchor's label, else for those of others; an anchor's own row is left out.
    """
    _, first, member = np.unique(anchors["row_id"], return_index=True, return_inverse=True)
    a, x = anchors["v"][first], block["v"]
    centre = _directions(_directions(a).mean(0, keepdims=True))[0]
    spread = np.arccos(np.clip(_directions(a) @ centre, -1, 1)).max()
    lengths = np.linalg.norm(x, axis=1)
    angle = np.arccos(np.clip(_directions(x) @ centre, -1, 1))
    bound = lengths * np.cos(np.maximum(0, angle - spread)) + 1e-6 * (lengths + 1)
    order = np.argsort(-bound, kind="stable")
    reach = np.linalg.norm(a, axis=1)[member]

    low, high = anchors["low"], anchors["high"]
    best = np.full((len(low), k), -BEYOND, dtype=np.int64)
    found = []
    for start in range(0, len(order), STEP):
        at = order[start : start + STEP]
        # a negative bound allows less the longer the anchor is
        certain = reach * bound[at[0]] + 1e-6 * np.abs(reach)
        need = np.maximum(low, best[:, 0])
        live = np.flatnonzero((certain >= need) & (low <= high))
        if not len(live):
            break
        asked, back = np.unique(member[live], return_inverse=True)
        s = _product(a[asked], x[at])[back]
        alike = anchors["label"][live][:, None] == block["label"][at][None, :]
        fits = (s >= need[live, None]) & (s <= high[live, None]) & (alike == same)
        if same:
            fits &= anchors["row_id"][live][:, None] != block["row_id"][at][None, :]
        w, c = np.nonzero(fits)
        if len(w):
            found.append((live[w], at[c], s[w, c]))
            hit = np.unique(w)
            pool = np.concatenate([best[live[hit]], np.where(fits[hit], s[hit], -BEYOND)], axis=1)
            best[live[hit]] = np.sort(np.partition(pool, -k, axis=1)[:, -k:], axis=1)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    w, c, s = (np.concatenate(f) for f in zip(*found))
    kept = s >= best[w, 0]
    w, c, s = w[kept], c[kept], s[kept]
    first = first_of_each(w, s, block["vec_id"][c], k)
    return w[first], c[first], s[first]


def _walker(length: int, k: int, same: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                read = lambda c, double=False: unpacked(batch.column(c)[at], np.float64 if double else np.int64, length if double else None)  # noqa: E731, B023
                anchors = {c: read(c, c == "v") for c in _WINDOW}
                block = {c: read(f"x_{c}", c == "v") for c in ("row_id", "vec_id", "label", "v")}
                w, c, s = walk(anchors, block, k, same)
                columns = [anchors["row_id"][w], anchors["vec_id"][w], anchors["nth"][w], block["vec_id"][c], s]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row_id", "anchor_id", "nth", "vec_id", "score"])

    return run


_HITS = "row_id long, anchor_id long, nth long, vec_id long, score long"


def best_of_windows(windows: DataFrame, blocks: DataFrame, length: int, size: int, k: int, same: bool) -> DataFrame:
    """(row_id, anchor_id, nth, vec_id, score, rank): the ``k`` best candidates of each window (row_id, nth), over all blocks."""
    run = _walker(length, k, same)
    firsts = blocks.where("part = 0").select("cell", *[F.col(c).alias(f"x_{c}") for c in ("row_id", "vec_id", "label", "v")])
    near = packs(windows, "cell", WINDOWS, _WINDOW).join(firsts, "cell").mapInArrow(run, _HITS)
    floors = near.groupBy("row_id", "nth").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).drop("n")
    floored = windows.join(floors, ["row_id", "nth"], "left").withColumn("low", F.greatest("low", F.coalesce("floor", "low"))).drop("floor")
    asked = packs(stored(floored, "windows"), "cell", WINDOWS, _WINDOW)
    hits = paired(asked.drop("part", "n", "cell"), blocks, size).mapInArrow(run, _HITS)
    order = W.partitionBy("row_id", "nth").orderBy(F.col("score").desc(), "vec_id")
    return stored(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")


def whole_vectors(vector: str, scale: float, length: int) -> Column:
    """floor(scale * x) of each component, held to the range in which no score of two vectors passes 64 bits."""
    most = float(1 << (61 - max(1, length).bit_length()) // 2)
    return F.transform(padded(vector, length), lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x * scale).cast("double"))))


def hard_negatives(df: DataFrame, anchor: Column, label: Column, vector: str = "embedding", vec_id: str = "vec_id", scale: float = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    Vectors become whole numbers, floor(scale * x); a score is their inner
    product. The positives of an anchor are its first 5 other rows of its label,
    by score, then id; the negatives of each are the first 3 rows of other
    labels whose score is between 0.50 and 0.95 of the positive's. All rows are
    candidates and the result is exact.

    Rows without an id or label, and vectors that are null or hold a null or
    non-finite component take no part; an empty or zero vector scores 0. A
    vector shorter than the longest counts as ending in zeros; components so
    large that a score could pass 64 bits (2**27 for 64 components) count as
    that bound. Repeated rows are rows of their own: one may be the positive of
    another, and results under one id may repeat. An anchor without positives,
    or a positive without negatives, gives no rows. Other columns are not read.
    Without rows the result is empty.
    """
    kept = df.withColumns({"_label": label, "_anchor": F.coalesce(anchor, F.lit(False))}).where(
        finite(vector) & F.col("_label").isNotNull() & F.col(vec_id).isNotNull()
    )
    n, length, anchors = kept.agg(F.count("*"), F.max(F.size(vector)), F.count_if("_anchor")).first()
    if not anchors:
        return df.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    length = max(1, length)
    rows = numbered(
        kept, [], vec_id=F.col(vec_id).cast("long"), label=F.col("_label").cast("long"), anchor=F.col("_anchor"), v=whole_vectors(vector, scale, length)
    ).drop("doc")
    drawn = _directions(sample(rows.where("anchor"), anchors, length))
    cells = _directions(centres(drawn, max(1, min(CLUSTERS, len(drawn) // PER_CLUSTER)))) if len(drawn) else np.zeros((1, length))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = nearest(_directions(matrix(batch.column("v"), length)), cells)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "cell"])

    placed = stored(rows.mapInArrow(place, "row_id long, vec_id long, label long, anchor boolean, v array<double>, cell long"), "placed")
    blocks = stored(packs(placed, "cell", BLOCK, ["row_id", "vec_id", "label", "v"]), "blocks")
    size = n * 8 * (length + 3)

    own = placed.where("anchor").drop("anchor")
    whole = own.select("*", F.lit(0).cast("long").alias("nth"), F.lit(-BEYOND).cast("long").alias("low"), F.lit(BEYOND).cast("long").alias("high"))
    positives = best_of_windows(whole, blocks, length, size, POSITIVES, True)
    wide = F.col("score").cast("decimal(38,0)")
    pairs = positives.select(
        "row_id", F.col("rank").cast("long").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.ceil(wide * LOWEST / 100).cast("long").alias("low"), F.floor(wide * HIGHEST / 100).cast("long").alias("high"),
    )
    windows = pairs.where("low <= high").select("row_id", "nth", "low", "high").join(own, "row_id")
    negatives = best_of_windows(windows, blocks, length, size, NEGATIVES, False)
    named = pairs.select("row_id", "nth", "positive_id", "positive_score")
    return negatives.join(named, ["row_id", "nth"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op13_hard_negatives(spark, sf_dir):
    """Three hard negatives for each of the five positives of every embedding whose id is divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label)


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.alike
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""
