import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripflow.llm import hard_negatives as hn

from .conftest import SF

COLUMNS = "vec_id long, embedding array<double>, label int, row_id string, low string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "own", "own", "own") for i, v, y in rows], COLUMNS)


def brute(rows, anchor, scale=256):
    """The result's rows over (id, vector, label); a place in the list is a row of its own."""
    rows = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows]
    out = []
    for at, (a, v, y) in enumerate(rows):
        if not anchor(a):
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), i, z) for n, (i, w, z) in enumerate(rows) if n != at]
        for s, p, _ in sorted(x for x in scored if x[2] == y)[:5]:
            fits = sorted(x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_matches_brute_force(spark):
    t = pd.read_parquet(f"{SF}/embeddings.parquet")
    rows = [(int(i), [float(x) for x in v], (int(y) + 1) % 10 if i % 7 == 0 else int(y)) for i, v, y in zip(t.vec_id, t.embedding, t.label)]
    assert found(hn.op13_hard_negatives(spark, SF)) == brute(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("spread", [0.02, 0.5, 5.0])
def test_clustered_rows_of_any_length(spark, spread):
    rng = np.random.default_rng(5)
    middle = rng.standard_normal((40, 12))
    x = (middle[rng.integers(0, 40, 3000)] + spread * rng.standard_normal((3000, 12))) * rng.uniform(0.2, 3, (3000, 1))
    rows = [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]
    got = hn.hard_negatives(table(spark, rows), F.col("vec_id") % 60 == 0, F.col("label"))
    assert found(got) == brute(rows, lambda i: i % 60 == 0)


def test_walk_ends_early():
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.standard_normal((4096, 16)))
    x[:64] = np.floor(2560 * (np.eye(1, 16) + 0.01 * rng.standard_normal((64, 16))))
    anchors = {"row_id": np.arange(4), "vec_id": np.arange(4), "label": np.zeros(4, int), "v": x[:4], "nth": np.zeros(4, int)}
    anchors |= {"low": np.full(4, -hn.BEYOND), "high": np.full(4, hn.BEYOND)}
    block = {"row_id": np.arange(4096), "vec_id": np.arange(4096), "label": np.zeros(4096, int), "v": x}
    scored, product = [], hn._product
    hn._product = lambda a, b: scored.append(len(b)) or product(a, b)
    try:
        w, c, s = hn.walk(anchors, block, 5, True)
    finally:
        hn._product = product
    assert sum(scored) <= 512  # the rest of the list is certified, not scored
    for i in range(4):
        others = sorted((-(x[i] @ x[j]), j) for j in range(4096) if j != i)[:5]
        assert [(-a, b) for a, b in others] == list(zip(s[w == i], c[w == i]))


def test_scores_beyond_doubles_are_exact(spark):
    big = 2.0**18
    rows = [(0, [big, 1.0, 0.0], 1), (1, [big, 3 / 256, 0.0], 1), (2, [big, 2 / 256, 0.0], 1), (3, [0.9 * big, 0.0, 1.0], 2), (4, [0.9 * big, 1 / 256, 0.0], 2)]
    got = found(hn.hard_negatives(table(spark, rows), F.col("vec_id") == 0, F.col("label")))
    assert got == brute(rows, lambda i: i == 0) and got[0][4] == 2**52 + 768


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.8, 0.1], 2), (3, [0.8, 0.1], 2), (4, [0.0, 0.0], 1), (5, [0.7], 3), (6, [], 1)]
    whole = [(i, v + [0.0] * (2 - len(v)), y) for i, v, y in rows]
    odd = [(7, None, 1), (8, [1.0, None], 2), (9, [nan, 0.0], 2), (10, [inf, 0.0], 1), (11, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (50, None, 1), (100, [1.0, 1.0], None), (150, [-1.0, 0.0], 9)]
    got = found(hn.hard_negatives(table(spark, rows + odd), F.col("vec_id") % 50 == 0, F.col("label")))
    assert got == brute([*whole, odd[-1]], lambda i: i % 50 == 0)
    # a positive of score 0 takes negatives of score 0
    zero = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 2), (3, [0.5, 0.0], 2)]
    assert found(hn.hard_negatives(table(spark, zero), F.col("vec_id") == 0, F.col("label"))) == [(0, 1, 1, 2, 0, 0)]
    empty = hn.hard_negatives(table(spark, []), F.col("vec_id") == 0, F.col("label"))
    assert empty.count() == 0 and len(empty.columns) == 6


def test_crowded_cell_and_label(spark):
    rows = [(i, [1.0, 0.01 * (i % 3)], 1) for i in range(2600)] + [(3000 + i, [0.7, 0.1 * i], 2) for i in range(10)]
    got = hn.hard_negatives(table(spark, rows), F.col("vec_id") % 500 == 0, F.col("label"))
    assert found(got) == brute(rows, lambda i: i % 500 == 0)
