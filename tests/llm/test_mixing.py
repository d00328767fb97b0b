import re
from collections import Counter

import numpy as np
import pytest

from tripflow.llm.mixing import flight, mix, op2_mixing, source_targets

from .conftest import SF


def water_fill(sizes: dict, repeats: int) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, open_, out = sum(sizes.values()), list(names), {}
    while open_:
        level = (total - sum(out.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > repeats * sizes[s]]
        if not full:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: repeats * sizes[s] for s in full}
        open_ = [s for s in open_ if s not in full]
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_flight_keeps_totals(n):
    rng = np.random.default_rng(n)
    size, prob = np.round(rng.lognormal(5, 1, n)), rng.random(n)
    got = flight(size, prob, 1, True)
    assert set(got) <= {0.0, 1.0}
    if n >= 50:
        assert abs(got.sum() - prob.sum()) <= 2
        assert abs((got * size).sum() - (prob * size).sum()) <= np.median(size)
    left = flight(size, prob, 1, False)
    assert ((left > 0) & (left < 1)).sum() <= 2


@pytest.mark.parametrize("seed", range(5))
def test_an_outsized_document_leaves_the_count(seed):
    size, prob = np.append(np.random.default_rng(seed).integers(80, 120, 3000), 100_000), np.full(3001, 0.51)
    got = flight(size, prob, seed, True)
    assert abs(got.sum() - prob.sum()) <= 2 and abs((got * size).sum() - (prob * size).sum()) <= size.max()


def test_draws_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    draws = [Counter(r["doc_id"] for r in mix(d).select("doc_id").collect()) for d in (docs, docs.repartition(7), docs.repartition(3, "source"))]
    assert draws[0] == draws[1] == draws[2]


def test_flight_keeps_probabilities():
    size, prob = np.array([100.0, 50, 50, 20, 10, 0]), np.array([0.3, 0.5, 0.2, 0.7, 0.4, 0.6])
    mean = sum(flight(size, prob, k, True) for k in range(3000)) / 3000
    assert np.abs(mean - prob).max() < 0.035


def test_targets_match_repeated_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 500, "e": 0, None: 70}
    df = spark.createDataFrame([(s, v) for s, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(df, 3).collect()}
    assert got == pytest.approx(water_fill(sizes, 3))


def test_query_is_near_its_targets(spark, small):
    docs = small["documents"].set_index("doc_id")
    got = op2_mixing(spark, SF).toPandas().set_index("doc_id")
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs.text.items()}
    assert got["size"].to_dict() == size
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    totals = Counter()
    for i, s in docs.source.items():
        totals[s] += size[i]
    want = water_fill(dict(totals), 3)
    for s, part in got.groupby(docs.source):
        assert part.target.iat[0] == pytest.approx(want[s]) and part.source_size.iat[0] == totals[s]
        assert abs(part.taken.sum() - want[s]) <= part["size"].max()
    again = op2_mixing(spark, SF).toPandas().set_index("doc_id")
    assert got.taken.to_dict() == again.taken.to_dict()


def test_odd_rows(odd, none):
    got = mix(odd).collect()
    assert got and all(r["size"] == "own size" and r["copies"] == "own copies" for r in got)
    times = Counter((r["doc_id"], r["text"]) for r in got)
    held = Counter((r["doc_id"], r["text"]) for r in odd.collect())
    assert all(n <= 3 * held[k] for k, n in times.items())
    assert mix(odd).columns == odd.columns
    assert mix(none).count() == 0 and mix(none).columns == none.columns
