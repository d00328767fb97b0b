import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripflow.operators import impute, metrics, ranking, split
from tripflow.operators.split import stratified_split
from tripflow.plans import training
from tripflow.schemas import LABEL


def test_running_totals(spark):
    rows = [(g, i * 7 % 50, i) for g in "ab" for i in range(50)]
    got = ranking.running_totals(spark.createDataFrame(rows, "g string, o int, v long"), ["g"], "o", ["v"]).collect()
    for r in got:
        assert r["v_before"] == sum(v for g, o, v in rows if g == r["g"] and o < r["o"])
        assert r["v_total"] == sum(range(50))


def test_quantiles_match_linear_interpolation(spark):
    rnd = random.Random(5)
    values = [rnd.choice([1.0, 2.0, rnd.random() * 100]) for _ in range(333)]
    frame = spark.createDataFrame([(v, None if v == 1.0 else v) for v in values] + [(float("nan"), None)], "a double, b double")
    for p in (0.5, 0.75, 0.0, 1.0):
        got = {r["name"]: r["quantile"] for r in ranking.exact_quantiles(frame, ["a", "b"], p).collect()}
        assert got["a"] == pytest.approx(np.percentile(values, p * 100))
        assert got["b"] == pytest.approx(np.percentile([v for v in values if v != 1.0], p * 100))


def test_mode_takes_smallest_on_ties(spark):
    frame = spark.createDataFrame([("b", None), ("a", "z"), ("b", None), ("a", None), ("c", None)], "x string, y string")
    assert {r["name"]: r["mode"] for r in ranking.modes(frame, ["x", "y"]).collect()} == {"x": "a", "y": "z"}


def test_imputation_uses_the_fitted_table(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, None), (None, "a")], "n double, c string")
    values = impute.fit_fill_values(train, ["n"], ["c"])
    other = spark.createDataFrame([(None, None), (9.0, "q")], "n double, c string")
    assert [tuple(r) for r in impute.fill(other, values).collect()] == [(2.0, "a"), (9.0, "q")]


def test_split_is_exact_seeded_and_stable(spark):
    rows = spark.range(1003).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    first = stratified_split(rows, "label", ["id"])
    sizes = {(r["label"], r["is_test"]): r["count"] for r in first.groupBy("label", "is_test").count().collect()}
    assert sizes[(0, True)] + sizes[(1, True)] == 201  # ceil(0.2 * 1003)
    assert sizes[(1, True)] in (50, 51)
    again = {r["id"] for r in stratified_split(rows.repartition(7), "label", ["id"]).where("is_test").collect()}
    assert again == {r["id"] for r in first.where("is_test").collect()}
    other = {r["id"] for r in stratified_split(rows, "label", ["id"], seed=1).where("is_test").collect()}
    assert other != again


def test_split_sizes_share_the_remainder(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)] * 3 + [("c",)] * 1, "label string")
    got = {r["label"]: r["n_test"] for r in split.test_sizes(rows, "label", 0.2).collect()}
    assert sum(got.values()) == 2


def test_metrics_against_brute_force(spark):
    rnd = random.Random(6)
    rows = [(rnd.random() < 0.3, round(rnd.random(), 1)) for _ in range(200)]
    rows = [(int(a), s) for a, s in rows]
    frame = spark.createDataFrame(rows, "label int, score double")
    pos, neg = [s for a, s in rows if a], [s for a, s in rows if not a]
    pairs = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    assert metrics.roc_auc(frame, "label", "score").first()[0] == pytest.approx(pairs / len(pos) / len(neg))
    points = [(0.0, 1.0)]
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        points.append((tp / len(pos), tp / (tp + fp)))
    area = sum((b[0] - a[0]) * (b[1] + a[1]) / 2 for a, b in zip(points, points[1:]))
    assert metrics.pr_auc(frame, "label", "score").first()[0] == pytest.approx(area)
    report = {r["row"]: r for r in metrics.classification_report(frame, "label", "score").collect()}
    tp = sum(s >= 0.5 for s in pos)
    assert report["1"]["recall"] == pytest.approx(tp / len(pos)) and report["0"]["support"] == len(neg)


def test_label_over_nulls_and_nans(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "AADT_LATEST double")
    got = [r[LABEL] for r in training.labelled(rows).orderBy(F.asc_nulls_last("AADT_LATEST")).collect()]
    assert got == [0, 0, 0, 1, 0]
