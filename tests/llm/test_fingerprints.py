import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tripflow.llm import fingerprints as fp

from .conftest import ODD_ROWS, SF


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def likeness(a, b):
    if a == b:
        return 1.0
    (ka, a1, a2), (kb, b1, b2) = a.split(":"), b.split(":")
    ka, kb = int(ka), int(kb)

    def alike(x, y):
        return 1 - distance(x, y) / max(len(x), len(y)) if x or y else 1.0

    if ka == kb:
        return max(alike(a1, b1), alike(a2, b2))
    return alike(a1, b2) if ka == 2 * kb else alike(a2, b1) if kb == 2 * ka else 0.0


def test_an_edit_moves_few_characters():
    rng = random.Random(3)
    text = " ".join(f"word{rng.randrange(10**5)}" for _ in range(1000))
    other = " ".join(f"word{rng.randrange(10**5)}" for _ in range(1000))
    a, b = fp.fingerprint(text), fp.fingerprint(text[:3000] + " inserted words " + text[3000:])
    assert likeness(a, b) > 0.9 and likeness(a, fp.fingerprint(other)) < 0.35
    assert fp.fingerprint(text) == a and 40 < len(a.split(":")[1]) < 260


@pytest.mark.parametrize("text", ["a", "ab", "x" * 100_000, "ab" * 50_000, "a b c. " * 9000])
def test_repetitive_texts_have_bounded_signatures(text):
    assert len(fp.fingerprint(text)) < 2500


def test_texts_of_one_repeated_line_are_like_their_edits():
    rng = random.Random(4)
    other = " ".join(f"word{rng.randrange(10**5)}" for _ in range(120_000))
    letters = "abcdefghijklmnopqrstuvwxyz "
    lines = ["na ", "x", *("".join(rng.choice(letters) for _ in range(n)) for n in (41, 41, 41, 57, 57, 57, 120))]
    for line in lines:
        text = line * (20_000 if len(line) > 2 else 90_000)
        near = likeness(fp.fingerprint(text[:600_000]), fp.fingerprint(fp.edited(text[:600_000], other)))
        # of the signatures' characters those of the repeated two thirds are shared
        assert near > 0.2
        assert likeness(fp.fingerprint(text[:600_000]), fp.fingerprint(other[:600_000])) < near


def test_signatures_use_whole_texts():
    text = "abc def ghi " * 2000
    assert fp.fingerprint(text + "x") != fp.fingerprint(text + "y")


def test_likeness_column(spark):
    prints = [fp.fingerprint(t) for t in ("", "a", "hello world", "hello worlds", "hello " * 50, "hello " * 90, "other " * 40)]
    rows = [(a, b) for a in prints for b in prints]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", fp.likeness(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r["n"] for r in got] == pytest.approx([likeness(a, b) for a, b in rows])


def expected(rows):
    """By brute force over rows (id, text) that are already in order."""
    out = []
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        new = text[: len(text) - k] + following[:k]
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), fp.fingerprint(text), fp.fingerprint(new), fp.fingerprint(following)))
    return out


def test_query_matches_brute_force(spark, small):
    rows = sorted(zip(small["documents"].doc_id, small["documents"].text), reverse=True)
    want = {e[0]: e for e in expected(rows)}
    got = fp.op7_fingerprints(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        _, n, sha, own, new, following = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, sha, own, new)
        assert r["near_edited"] == pytest.approx(likeness(own, new)) and r["near_next"] == pytest.approx(likeness(own, following))


def test_odd_rows(odd, none):
    got = fp.fingerprints(odd).collect()
    assert len(got) == len(ODD_ROWS)
    order = odd.select("doc_id", "text").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).collect()
    want = expected([tuple(r) for r in order])
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert fp.fingerprints(none).count() == 0
    assert fp.fingerprints(odd.where("doc_id = 4")).first()["next_fingerprint"] == fp.fingerprint("word")
