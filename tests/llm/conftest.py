from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"

#: names that operators use inside, with values no operator may read
CLASHES = ["row_id", "shard", "slot", "size", "copies", "score", "doc", "spans", "items", "n_words", "s", "nth", "block"]

LONG = " ".join(f"wort{i % 977} langer{i}" for i in range(60_000))

#: (doc_id, text, lang, source)
ODD_ROWS = [
    (None, None, None, None),
    (None, "a text without an id", "en", "src1"),
    (1, None, "en", "src1"),
    (2, "", "en", None),
    (3, " \t\n ", "en", "src2"),
    (4, "word", None, "src2"),
    (5, "same words here in this line again and again and so on", "en", "src2"),
    (5, "same words here in this line again and again and so on", "en", "src2"),
    (5, "same words here in this line again and again and so on", "en", "src2"),
    (5, "another text of the same id", "en", "src3"),
    (6, LONG, "de", "src3"),
    (7, "x" * 200_000, "en", "src4"),
    (8, "<|im_end|><|im_start|> \\ | \\| ü日本 😀 \x00 nul", "fr", "src4"),
    (9, "!!! $$$ ### %%% &&& !!!", "en", "src4"),
    (-3, "a@b.c +49 30 1234567 10.0.0.1 4111 1111 1111 1111", "en", "src4"),
]


@pytest.fixture(scope="session")
def docs_like(spark):
    """Makes a documents table from rows (doc_id, text, lang, source), with extra columns."""
    from pyspark.sql import functions as F

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        df = df.withColumn("n_chars", F.length("text").cast("long"))
        return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])

    return make


@pytest.fixture(scope="session")
def odd(docs_like):
    return docs_like(ODD_ROWS).cache()


@pytest.fixture(scope="session")
def none(docs_like):
    return docs_like([])


@pytest.fixture(scope="session")
def small():
    """The smallest provided tables as pandas frames."""
    import pandas as pd

    return {p.stem: pd.read_parquet(p) for p in Path(SF).glob("*.parquet") if p.stem in ("documents", "benchmark", "labels")}
