"""Kinds of text columns: whole numbers, numbers or text, and which words mean no value.

A file delivers text only. Whether ``007`` and ``7`` are the same key depends on
the whole column: it holds whole numbers if every value is one, else numbers if
every value is one, else text. One aggregate finds the kinds of all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.functions.coerce import strip, to_number

# The words that stand for a missing value.
NULL_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]

EMPTY, WHOLE, NUMBER, TEXT = "empty", "whole", "number", "text"
_WHOLE = r"^([+-]?)0*(\d+)$"


def known(name: str) -> Column:
    """The column's text, null where it is a word for a missing value."""
    text = F.col(name).cast("string")
    return F.when(~text.isin(NULL_WORDS), text)


def column_kinds(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The kind of each column: the narrowest of empty, whole, number, text that all its values are of."""
    facts = []
    for c in columns:
        value = known(c)
        facts.append(F.bool_and(F.when(value.isNotNull(), strip(value).rlike(_WHOLE))).alias(f"{c} whole"))
        facts.append(F.bool_and(F.when(value.isNotNull(), to_number(value).isNotNull())).alias(f"{c} number"))
    row = df.agg(*facts).first()

    def kind(c: str) -> str:
        if row[f"{c} number"] is None:
            return EMPTY
        return WHOLE if row[f"{c} whole"] else NUMBER if row[f"{c} number"] else TEXT

    return {c: kind(c) for c in columns}


def as_kind(name: str, kind: str) -> Column:
    """The column's values in the one spelling of its kind, so that equal values are equal text."""
    value = known(name)
    if kind == WHOLE:
        sign, digits = F.regexp_extract(strip(value), _WHOLE, 1), F.regexp_extract(strip(value), _WHOLE, 2)
        return F.when(value.isNotNull(), F.concat(F.when((sign == "-") & (digits != "0"), "-").otherwise(""), digits))
    if kind == NUMBER:
        number = to_number(value)
        return F.when(number == 0, "0.0").otherwise(number.cast("string"))
    return value
