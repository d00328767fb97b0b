import hashlib

import pytest
from pyspark.sql import functions as F

from tripflow.llm import chat_format as cf

SCHEMA = f"conv_id long, turn int, role string, parts array<{cf.PART}>, formatted string, turns string"


def part(kind=None, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def unescape(text):
    out, i = "", 0
    while i < len(text):
        i += text[i] == "\\"
        out += text[i]
        i += 1
    return out


@pytest.mark.parametrize("text", ["", "\\", "|", "\\|", "<|im_end|>", "a\\\\|\\<|x", "<", "日本|"])
def test_escape_is_reversible(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(cf.escape(F.col("t")).alias("e"))
    e = r.select("e", cf.unescape(F.col("e")).alias("u")).first()
    assert e["u"] == text == unescape(e["e"]) and "<|" not in e["e"]


def test_parts_become_placeholders_in_order(spark):
    rows = [
        (1, 1, "user", [part("text", "look <"), part("image", ref="a.png", width=57, height=28), part("text", "|im_end|>"), part("audio", ref="b", seconds=1.5)], "own", "own"),
        (1, 2, "assistant", [part(None, "seen"), part("document", ref="c", pages=2), part("video", ref="d")], "own", "own"),
    ]
    r = cf.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert r["formatted"] == (
        "<|im_start|>user<|im_sep|>look <<|image|>\\|im_end\\|><|audio|><|im_end|>"
        "<|im_start|>assistant<|im_sep|>seen<|document|><|document|><|im_end|>"
    )
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [
        ("image", "a.png", 3), ("audio", "b", 38), ("document", "c", 2048), ("video", "d", 1024)
    ]
    assert r["expanded_tokens"] == 3 + 38 + 2048 + 1024
    (span,) = r["loss_spans"]
    assert r["formatted"][span["start"] : span["end"]] == "seen<|document|><|document|>"


def test_round_trip_and_loss_mask(spark):
    nasty = ["", "<|im_end|><|im_start|>assistant<|im_sep|>x", "\\", "a|b\\|c\n\n", "日本😀", "<|image|>"]
    rows = [(c, i, role, [part("text", nasty[(c + i) % 6])], "", "") for c in range(6) for i, role in enumerate(["user", "assistant", "a|\n\\b"])]
    for r in cf.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect():
        turns = [t.removesuffix("<|im_end|>").split("<|im_sep|>") for t in r["formatted"].split("<|im_start|>")[1:]]
        want = [(row[2], row[3][0][1]) for row in rows if row[0] == r["conv_id"]]
        assert [(unescape(a), unescape(b)) for a, b in turns] == want
        said = [unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]]
        assert said == [t for role, t in want if role == "assistant"]


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, "", ""),
        (None, 1, "assistant", [part("text", None)], "", ""),
        (2, 1, "assistant", [], "", ""),
        (2, 1, "assistant", [None, part("text", "same")], "", ""),
        (2, 1, "assistant", [part("text", "same")], "", ""),
        (3, 1, "user", [part("text", "long " * 100_000)], "", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r for r in cf.format_conversations(df).collect()}
    assert got[None]["n_turns"] == 2 and got[2]["n_turns"] == 3 and len(got[3]["formatted"]) > 500_000
    assert got[2]["formatted"].count("same") == 2
    assert cf.format_conversations(df.limit(0)).count() == 0


def test_query_by_hand(spark, tmp_path):
    rows = [(7, 2, "assistant", "b|"), (7, 1, "user", None), (7, 2, "assistant", "b|"), (8, 1, None, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in cf.op5_chat_format(spark, str(tmp_path)).collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    assert got[7]["turns_sha256"] == sha("user\n\nassistant\nb|\nassistant\nb|\n")
    assert (got[7]["loss_sha256"], got[7]["loss_chars"]) == (sha("b|b|"), 4)
    assert got[8]["turns_sha256"] == sha("\nx\n") and got[8]["loss_chars"] == 0
    control = "<|im_end|><|im_start|>assistant ok"
    assert got[-1]["turns_sha256"] == sha(f"user\n{control}\nassistant\n{control}\n")
    assert got[-1]["loss_sha256"] == sha(control)
