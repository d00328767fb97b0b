"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on a bounded sample of labelled documents. Every path
from a root is a rule, a conjunction of comparisons; a logistic regression with
an L1 penalty weighs the rules and drops most. What is left is compiled into one
column expression, so scoring a table is a projection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tripflow.llm.common import documents, stored, with_columns

#: statistics of a text; shares are of bytes, words or lines
STATISTICS = [
    "log_bytes",
    "log_words",
    "bytes_per_word",
    "upper_share",
    "digit_share",
    "stop_share",
    "symbol_share",
    "accent_share",
    "newline_share",
    "symbol_word_share",
    "distinct_word_share",
    "distinct_line_share",
    "short_word_share",
    "longest_word",
]
#: (feature, is upper bound, threshold)
Condition = tuple[str, bool, float]


def text_statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; a null or empty text has zeros."""
    data = text.encode("utf-8", "replace") if text else b""
    if not data:
        return [0.0] * len(STATISTICS)
    n = len(data)
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    upper, lower, digits = int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[48:58].sum())
    accents, spaces = int(seen[128:].sum()), int(seen[9:14].sum() + seen[32])
    stops = int(seen[44] + seen[46])  # comma and full stop
    symbols = n - upper - lower - digits - accents - spaces - stops
    tokens = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    count = max(1, len(tokens))
    marked = sum(1 for t in tokens if t[-1] in b"!#$%&*+/<=>@^_|~")
    return [
        np.log1p(n),
        np.log1p(len(tokens)),
        n / count,
        upper / n,
        digits / n,
        stops / n,
        symbols / n,
        accents / n,
        int(seen[10]) / n,
        marked / count,
        len(set(tokens)) / count,
        len(set(lines)) / max(1, len(lines)),
        sum(1 for t in tokens if len(t) < 4) / count,
        float(max(map(len, tokens), default=0)),
    ]


@F.pandas_udf(StructType([StructField(name, DoubleType()) for name in STATISTICS]))
def statistics(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([text_statistics(t) for t in batch], columns=STATISTICS, dtype=float)


def condition_column(c: Condition, of: Column) -> Column:
    name, upper, threshold = c
    return of[name] <= threshold if upper else of[name] > threshold


def rule_column(rule: tuple[Condition, ...], of: Column) -> Column:
    """Whether all conditions hold, as 0.0 or 1.0."""
    out = condition_column(rule[0], of)
    for c in rule[1:]:
        out = out & condition_column(c, of)
    return out.cast("double")


@dataclass
class RuleEnsemble:
    """An intercept and weighted rules."""

    intercept: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self, of: Column) -> Column:
        """The probability of label 1, from the struct of statistics ``of``."""
        logit = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            logit = logit + F.lit(float(weight)) * rule_column(rule, of)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def tree_paths(description: str) -> list[tuple[Condition, ...]]:
    """All root paths of the trees in a model's printed form, each as its conditions from the root down."""
    paths: list[tuple[Condition, ...]] = []
    above: list[tuple[int, Condition]] = []
    for line in description.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            if line.strip().startswith("Tree"):
                above = []
            continue
        depth = len(m[1])
        above = [a for a in above if a[0] < depth]
        above.append((depth, (STATISTICS[int(m[2])], m[3] == "<=", float(m[4]))))
        paths.append(tuple(c for _, c in above))
    return paths


def simplify(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One bound per feature and side, in a fixed order."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, upper, threshold in rule:
        old = bounds.get((name, upper), threshold)
        bounds[name, upper] = min(old, threshold) if upper else max(old, threshold)
    return tuple(sorted((n, u, t) for (n, u), t in bounds.items()))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    sample_rows: int = 20_000,
    trees: int = 24,
    depth: int = 3,
    penalty: float = 1e-3,
    seed: int = 7,
) -> RuleEnsemble:
    """Rules learned from at most ``sample_rows`` labelled documents, chosen by a hash of their id.

    ``labels`` has doc_id and ``label``; null ids and labels are left out, and of
    several labels of one id the most frequent counts, the higher one on ties.
    Without labelled documents, or with one label only, the ensemble has no
    rules: scores are 0.5, or that label's share with one added on either side.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    votes = known.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("share"))
    chosen = (
        votes.select("doc_id", (F.col("share") >= 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(sample_rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # sample_rows rows of 16 bytes
    table = stored(texts.select("label", statistics("text").alias("s")).select("label", "s.*"), "statistics")
    count, ones = table.agg(F.count("*"), F.sum("label")).first()
    if not count or ones in (0, count):
        return RuleEnsemble(float(np.log(((ones or 0) + 1) / (count - (ones or 0) + 1))))
    data = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(table)
    forest = RandomForestClassifier(
        labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.7
    ).fit(data)
    rules = sorted(set(map(simplify, tree_paths(forest.toDebugString))))
    values = F.struct(*STATISTICS)
    marks = table.select("label", *[rule_column(r, values).alias(f"r{i}") for i, r in enumerate(rules)])
    matrix = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(marks)
    lasso = LogisticRegression(
        labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False
    ).fit(stored(matrix.select("label", "features"), "rules"))
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w])


def _fold(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents scored at least ``threshold``, columns unchanged; learns from all labelled documents."""
    model = fit(docs, labels)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), statistics("text").alias("s"))
    return with_columns(rows.where(model.score(F.col("s")) >= threshold), "doc")


def op8_quality(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_fold(3) != 1)
    model = fit(docs, labels)
    scored = docs.select("doc_id", statistics("text").alias("s")).select("doc_id", model.score(F.col("s")).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
