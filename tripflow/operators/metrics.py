"""Classifier quality from (label, score) tables, all by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.operators.ranking import running_totals


def _score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    positive = (F.col(label) == 1).cast("long")
    return df.groupBy(F.col(score).alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties counting half; null with one class only."""
    ranked = running_totals(_score_counts(df, label, score), [], "score", ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return ranked.agg(F.try_divide(won, F.sum("pos") * F.max("neg_total")).alias("roc_auc"))


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall at every distinct score, from the highest down.

    ``precision_before`` and ``recall_before`` are the point before; ahead of
    the first score that is recall 0, precision 1. Without positives recall is null.
    """
    counts = _score_counts(df, label, score).withColumn("rank", -F.col("score"))
    ranked = running_totals(counts, [], "rank", ["pos", "neg"])
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    before = F.col("pos_before") + F.col("neg_before")
    return ranked.select(
        "score",
        (tp / (tp + fp)).alias("precision"),
        F.try_divide(tp, F.col("pos_total")).alias("recall"),
        F.when(before > 0, F.col("pos_before") / before).otherwise(1.0).alias("precision_before"),
        F.try_divide(F.col("pos_before"), F.col("pos_total")).alias("recall_before"),
    )


def pr_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Trapezoid area under the precision-recall curve."""
    strip = (F.col("recall") - F.col("recall_before")) * (F.col("precision") + F.col("precision_before")) / 2
    return pr_curve(df, label, score).agg(F.sum(strip).alias("pr_auc"))


def classification_report(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Rows ``0``, ``1``, ``accuracy``, ``macro avg``, ``weighted avg``; undefined ratios are 0."""
    actual, predicted = F.col(label) == 1, F.col(score) >= threshold
    cells = df.agg(
        F.count_if(~actual & ~predicted).alias("tn"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(actual & predicted).alias("tp"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    def one_class(right: str, wrong: str, missed: str) -> list[Column]:
        precision = ratio(F.col(right), F.col(right) + F.col(wrong))
        recall = ratio(F.col(right), F.col(right) + F.col(missed))
        f1 = ratio(2.0 * F.col(right), 2 * F.col(right) + F.col(wrong) + F.col(missed))
        return [precision, recall, f1, F.col(right) + F.col(missed)]

    names = ["precision", "recall", "f1", "support"]
    negative, positive = one_class("tn", "fn", "fp"), one_class("tp", "fp", "fn")
    total = negative[3] + positive[3]
    accuracy = ratio(F.col("tn") + F.col("tp"), total)
    macro = [(a + b) / 2 for a, b in zip(negative[:3], positive[:3])]
    weighted = [ratio(a * negative[3] + b * positive[3], total) for a, b in zip(negative[:3], positive[:3])]
    rows = {
        "0": negative,
        "1": positive,
        "accuracy": [accuracy, accuracy, accuracy, total],
        "macro avg": [*macro, total],
        "weighted avg": [*weighted, total],
    }
    lines = [
        F.struct(F.lit(row).alias("row"), *[v.alias(n) for v, n in zip(values, names)])
        for row, values in rows.items()
    ]
    return cells.select(F.inline(F.array(*lines)))
