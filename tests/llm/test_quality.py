import pytest
from pyspark.sql import functions as F

from tripflow.llm import quality as q

from .conftest import ODD_ROWS, SF


def test_paths_of_printed_trees():
    printed = """Model
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 3 <= 2.0)
      Predict: 0.0
     Else (feature 3 > 2.0)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 1 <= 1.0E-4)
     Predict: 0.0
    Else (feature 1 > 1.0E-4)
     Predict: 1.0
"""
    a, b, c = q.STATISTICS[0], q.STATISTICS[3], q.STATISTICS[1]
    assert q.tree_paths(printed) == [
        ((a, True, 0.5),),
        ((a, True, 0.5), (b, True, 2.0)),
        ((a, True, 0.5), (b, False, 2.0)),
        ((a, False, 0.5),),
        ((c, True, 1e-4),),
        ((c, False, 1e-4),),
    ]
    assert q.simplify(((a, True, 3.0), (b, False, 1.0), (a, True, 2.0))) == ((a, True, 2.0), (b, False, 1.0))


def test_rules_compile_to_the_same_score(spark):
    model = q.RuleEnsemble(0.25, [((("log_bytes", True, 2.0), ("upper_share", False, 0.5)), 1.5), ((("log_words", False, 1.0),), -2.0)])
    rows = [(1.0, 0.9, 3.0), (5.0, 0.9, 0.0), (2.0, 0.4, 1.0)]
    df = spark.createDataFrame(rows, "log_bytes double, upper_share double, log_words double").select(F.struct("*").alias("s"))
    import math

    for r in df.select("s.*", model.score(F.col("s")).alias("p")).collect():
        z = 0.25 + 1.5 * (r.log_bytes <= 2 and r.upper_share > 0.5) - 2 * (r.log_words > 1)
        assert r.p == pytest.approx(1 / (1 + math.exp(-z)))


def test_held_out_accuracy(spark):
    got = q.op8_quality(spark, "/root/testdata/sf0.01").toPandas().merge(
        __import__("pandas").read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id"
    )
    rest = got[got.held_out]
    assert len(rest) > 50 and (rest.predicted == rest.quality).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (5, 1), (5, 0), (6, 1), (9, 0), (None, 1), (8, None), (99, 0)], "doc_id long, quality int"
    )
    kept = q.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert q.keep_good(none, labels).count() == 0
    # without labels nothing is known, and nothing goes
    assert q.keep_good(odd, labels.limit(0)).count() == len(ODD_ROWS)
    one = q.fit(odd, labels.where("quality = 1"))
    assert one.rules == [] and one.intercept > 0


def test_statistics_of_empty_texts():
    assert q.text_statistics(None) == q.text_statistics("") == [0.0] * len(q.STATISTICS)
    assert q.text_statistics(" \n ")[q.STATISTICS.index("distinct_line_share")] == 0


def test_query_has_a_row_for_each_document(spark, small):
    got = q.op8_quality(spark, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(small["documents"].doc_id)
