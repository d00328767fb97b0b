"""Imputation fitted on one table and applied to another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.operators.ranking import exact_quantiles, modes


def fit_fill_values(train: DataFrame, numeric: list[str], categorical: list[str]) -> dict:
    """Median per numeric and mode per categorical column; one small row comes back."""
    medians = exact_quantiles(train, numeric, 0.5).collect() if numeric else []
    frequent = modes(train, categorical).collect() if categorical else []
    return {r["name"]: r["quantile"] for r in medians} | {r["name"]: r["mode"] for r in frequent}


def fill(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if c in df.columns})
