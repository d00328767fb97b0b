import math
from collections import Counter

import numpy as np

from tripflow.llm.common import PART_BITS
from tripflow.llm.sharding import draw_counts, draw_hypergeometric, matrix_row, op3_sharding, receivers, shard

from .conftest import ODD_ROWS, SF


def test_matrix_has_exact_sums():
    before = np.array([0, 5, 5, 40, 47, 100])
    sizes = np.array([b[2] for b in receivers(100, 7, 9)])
    rows = [matrix_row(i, before, sizes, 3) for i in range(5)]
    assert [r.sum() for r in rows] == np.diff(before).tolist()
    assert (np.sum(rows, axis=0) == sizes).all() and sizes.sum() == 100


def test_receivers_are_near_equal_shards():
    got = Counter()
    for shard_no, first, size in receivers(103, 10, 4):
        assert first == got[shard_no] and 0 < size <= 4
        got[shard_no] += size
    assert sorted(got.values()) == [10] * 7 + [11] * 3


def test_hypergeometric_law():
    rng = np.random.default_rng(0)
    mean, sd = 1000 * 0.3, math.sqrt(1000 * 0.3 * 0.7)
    big = [draw_hypergeometric(rng, 3 * 10**10, 7 * 10**10, 1000) for _ in range(2000)]
    assert abs(np.mean(big) - mean) < 5 * sd / math.sqrt(2000) and 0.9 < np.std(big) / sd < 1.1
    assert draw_hypergeometric(rng, 5, 0, 3) == 3
    parts = draw_counts(rng, np.array([2 * 10**9, 0, 10**9]), 10**9)
    assert parts.sum() == 10**9 and parts[1] == 0


def test_every_place_is_equally_likely(spark):
    rows = spark.range(4).toDF("doc_id")
    seen = Counter(
        tuple(r["doc_id"] for r in sorted(shard(rows, 2, seed).collect(), key=lambda r: (r["shard"], r["slot"])))
        for seed in range(40)
    )
    assert len(seen) > 12


def test_query_fills_all_slots(spark, small):
    got = op3_sharding(spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(small["documents"].doc_id)
    counts = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(counts) == 40 and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()
    again = op3_sharding(spark, SF).toPandas()
    assert dict(zip(got.doc_id, zip(got.shard, got.slot))) == dict(zip(again.doc_id, zip(again.shard, again.slot)))


def test_blocks_make_one_gapless_shard(spark):
    got = shard(spark.range(1000).toDF("doc_id"), 3, block_rows=50).toPandas()
    assert sorted(got.doc_id) == list(range(1000))
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_odd_rows(odd, none):
    got = shard(odd, 4).collect()
    assert len(got) == len(ODD_ROWS) and got[0]["row_id"] == "own row_id"
    assert Counter(r["shard"] for r in got) == {0: 4, 1: 4, 2: 4, 3: 3}
    assert shard(none, 4).count() == 0
    assert PART_BITS == 33
