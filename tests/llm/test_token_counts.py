import random

import pytest
from pyspark.sql import functions as F

from tripflow.llm.token_counts import PieceCounter, TokenTree, edited_counts, op4_token_counts, sample_edits

from .conftest import ODD_ROWS, SF

BITS = ["a", "'", "r", "e", " ", "  ", "\n", "\t", "1", "é", "!", " the", "'re", "'ll", "<|im_end|>", "日"]


@pytest.fixture(scope="module")
def counter():
    return PieceCounter()


def test_pattern_is_the_vocabularys(counter):
    import public_tokenizers as public
    import regex

    text = "we're 12 it's'd  x\n\n y'll !?'t 'tis"
    assert counter.cut.findall(text) == regex.findall(public.PATTERN, text)


@pytest.mark.parametrize("seed", range(150))
def test_edits_equal_a_full_count(counter, seed):
    rng = random.Random(seed)

    def some(n):
        return "".join(rng.choice(BITS) for _ in range(n))

    text = some(rng.choice([0, 1, 5, 60, 900, 4000]))
    tree = TokenTree(text, counter)
    for _ in range(6):
        assert tree.text() == text and tree.total == len(counter.encode(text))
        a = rng.randint(0, len(text))
        b = min(len(text), a + rng.choice([0, 0, 1, 3, 50, 500]))
        new = some(rng.choice([0, 1, 2, 8, 200]))
        text = text[:a] + new + text[b:]
        tree.edit(a, b, new)
    assert tree.text() == text and tree.total == len(counter.encode(text))


def test_long_documents_are_encoded_in_part(counter):
    text = " ".join(f"word{i % 50}" for i in range(50_000))
    tree = TokenTree(text, counter)
    tree.edit(len(text) // 2, len(text) // 2 + 3, "new words")
    assert tree.encoded < 1000 < tree.pieces


def test_leaves_split_and_merge(counter):
    text = " ".join(f"word{i % 50}" for i in range(3000))
    tree = TokenTree(text, counter)
    leaves = len(tree.texts)
    added = " " + " ".join(f"more{i % 70}" for i in range(100_000)) + " "
    tree.edit(7000, 7000, added)
    text = text[:7000] + added + text[7000:]
    assert tree.text() == text and tree.total == len(counter.encode(text)) and len(tree.texts) > 1000
    for at in (7000, 7000 + len(added) // 2, 7000 + len(added), 100):
        before = tree.encoded
        tree.edit(at, at + 1, "x")
        text = text[:at] + "x" + text[at + 1 :]
        assert tree.encoded - before < 1000
    assert tree.text() == text and tree.total == len(counter.encode(text))
    tree.edit(7000, 7000 + len(added), "")
    text = text[:7000] + text[7000 + len(added) :]
    assert tree.text() == text and tree.total == len(counter.encode(text)) and len(tree.texts) <= 2 * leaves
    tree.edit(0, len(text), "")
    assert tree.text() == "" and tree.total == 0 and len(tree.texts) <= 4


def apply(text, edits):
    for start, stop, new in edits:
        start = max(0, min(start, len(text)))
        text = text[:start] + new + text[max(start, min(stop, len(text))) :]
    return text


def test_query_equals_a_full_count(spark, small, counter):
    got = op4_token_counts(spark, SF).toPandas().set_index("doc_id")
    text = F.coalesce("text", F.lit(""))
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", text.alias("text"), sample_edits(text).alias("edits"))
    for r in rows.collect():
        new = apply(r["text"], r["edits"])
        assert got.n_tokens[r["doc_id"]] == len(counter.encode(r["text"]))
        assert got.edited_tokens[r["doc_id"]] == len(counter.encode(new))
    assert len(got) == len(small["documents"])


def test_odd_rows(odd, none):
    edits = F.array(
        F.struct(F.lit(-5).alias("start"), F.lit(10**9).alias("stop"), F.lit(None).cast("string").alias("replacement")),
        F.lit(None).cast("struct<start:int,stop:int,replacement:string>"),
        F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"), F.lit("x").alias("replacement")),
    )
    got = edited_counts(odd.withColumn("edits", edits), ["doc_id", "doc"]).collect()
    assert len(got) == len(ODD_ROWS) and {r["edited_tokens"] for r in got} == {1}
    assert got[0]["doc"]["doc"] == "own doc"
    nothing = edited_counts(odd.withColumn("edits", F.lit(None)), ["doc_id"]).collect()
    assert all(r["n_tokens"] == r["edited_tokens"] for r in nothing)
    assert edited_counts(none.withColumn("edits", edits), []).count() == 0
