import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripflow.llm import nearest_vectors as nv

from .conftest import SF

COLUMNS = "vec_id long, embedding array<float>, label int, row_id string, list string, query string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "own", "own", "own") for i, v in rows], COLUMNS)


def brute(vectors, queries, k):
    """{query: [(id, score)]} over the rows (id, vector), rows of the same place left out."""
    out = {}
    for at in queries:
        q, x = vectors[at]
        scored = [(-float(np.dot(np.float64(x), np.float64(y))), i) for n, (i, y) in enumerate(vectors) if n != at]
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def found(frame):
    return {q: list(zip(g.vec_id, g.score)) for q, g in frame.toPandas().sort_values("rank").groupby("query_id")}


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_query_recall(spark):
    rows = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    vectors = list(zip(rows.vec_id, rows.embedding))
    want = brute(vectors, [i for i, (q, _) in enumerate(vectors) if q % 20 == 0], 20)
    frame = nv.op11_nearest_vectors(spark, SF)
    got = found(frame)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    assert recall(got, want) >= 0.9
    by_id = dict(vectors)
    for q, hits in got.items():
        for i, s in hits:
            assert s == pytest.approx(float(np.dot(np.float64(by_id[q]), np.float64(by_id[i]))), abs=1e-12)
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0])) and q not in {i for i, _ in hits}


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_clustered_vectors_of_any_length(spark, spread):
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((30, 24))
    x = (middle[rng.integers(0, 30, 3000)] + spread * rng.standard_normal((3000, 24))) * rng.uniform(0.1, 4, (3000, 1))
    vectors = [(i, [float(c) for c in v.astype(np.float32)]) for i, v in enumerate(x)]
    want = brute(vectors, range(0, 3000, 100), 10)
    got = found(nv.nearest_vectors(table(spark, vectors), F.col("vec_id") % 100 == 0, 10))
    assert recall(got, want) >= 0.9


def test_survivors_keep_what_is_within_the_radius():
    rng = np.random.default_rng(4)
    q, x = rng.standard_normal((40, 64)).astype(np.float32), rng.standard_normal((3000, 64)).astype(np.float32)
    away = ((q[:, None, :] - x[None, :, :]) ** 2).sum(2)
    radius = np.partition(away, 20, axis=1)[:, 20]
    ask = np.arange(40) % 4 != 0
    a, b = nv.survivors(q, [x[:, c : c + 16] for c in range(0, 64, 16)], radius, ask)
    kept, want = set(zip(a, b)), {(i, j) for i, j in zip(*np.nonzero(away <= radius[:, None])) if ask[i]}
    assert len(kept & want) >= 0.98 * len(want)
    # at the end the partial square is the whole one: nothing far is left
    assert all(away[i, j] <= radius[i] * 1.001 + 1e-3 for i, j in kept)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0])]
    rows += [(20, [0.0, 1.0]), (20, [0.0, 1.0]), (None, [5.0, 5.0]), (40, [1.0]), (60, [0.5, 0.5, 0.5]), (80, None)]
    got = nv.nearest_vectors(table(spark, rows), F.col("vec_id") % 20 == 0, 20).toPandas().sort_values(["query_id", "rank"])
    assert set(got.query_id) == {0, 20, 40, 60} and set(got.vec_id) == {0, 1, 2, 20, 40, 60}
    zero = got[got.query_id == 0]
    assert zero.vec_id.tolist() == [1, 2, 40, 60, 20, 20] and zero.score.tolist() == [2, 2, 1, 0.5, 0, 0] and zero["rank"].tolist() == [1, 2, 3, 4, 5, 6]
    # both rows of id 20 are queries, each finds the other
    assert (got[got.query_id == 20].groupby("vec_id").size()[20]) == 2
    empty = nv.nearest_vectors(table(spark, []), F.col("vec_id") % 20 == 0, 20)
    assert empty.count() == 0 and empty.columns == got.columns.tolist()
    alone = nv.nearest_vectors(table(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 20 == 0, 20)
    assert alone.count() == 0


def test_crowded_list(spark):
    # far more equal vectors than a block holds, and one that is nearer to the query
    rows = [(i, [1.0, 0.001 * (i % 2), 0.0]) for i in range(1, 5000)] + [(0, [1.0, 0.0, 0.0]), (9000, [1.5, 0.0, 0.0])]
    got = found(nv.nearest_vectors(table(spark, rows), F.col("vec_id") == 0, 20))
    assert [i for i, _ in got[0]] == [9000, *range(1, 20)]
