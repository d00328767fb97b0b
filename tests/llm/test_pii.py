import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tripflow.llm import pii

from .conftest import ODD_ROWS, SF

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = [int(c) for c in value if "0" <= c <= "9"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        doubled = (d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find_pii(df, ["doc_id"]).select("doc.doc_id", pii.listed(F.col("base")).alias("base"), "added").collect()
    return [r["base"] for r in sorted(rows, key=lambda r: r["doc_id"])], [r["added"] for r in sorted(rows, key=lambda r: r["doc_id"])]


NASTY = [
    "a@b.c@d.e a@b.c_x@d.e @x.y a@@b.c a@b. a@b.c.d-.e. é@b.c+d@e.f",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 0255.1.1.1 1..2.3.4 99999999999999999999.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111112 4111111111111111",
    "+1 (743) 555-3824 + 1 234 +49 30 1234567 +1234567 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 +1() ++12345678",
    "😀 ü mail a.b@c.de, 10.0.0.1 日本 +4930123456 4111111111111111",
    None,
    "",
    "x" * 100_000,
    "1 " * 30_000,
    "a@b." + "c." * 20_000,
    "+1" * 5_000,
]


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(5)
    bits = ["a", "@", ".", "b", "1", "25", "4111", " ", "-", "+", "(", ")", "_", "é", "3"]
    texts = NASTY + ["".join(rng.choice(bits) for _ in range(60)) for _ in range(400)]
    got, _ = found(spark, texts)
    assert got == [",".join(base(t)) for t in texts]


def test_reliabilities_find_the_better_labeler():
    rows = []
    for truth, n in ((1, 300), (-1, 700)):
        for good, weak, third in [(truth, truth, truth)] * 6 + [(truth, -truth, truth)] * 3 + [(-truth, truth, truth)]:
            rows.append({"kind": 0, "strict": 0, "gazetteer": good, "context": weak, "shape": third, "n": n // 10})
    prior, chances = pii.fit_reliabilities(rows)[0]
    assert chances["gazetteer"][1][2] > chances["context"][1][2] > 0.5
    assert -1.3 < prior < -0.4


def test_spelled_out_addresses_are_added(spark):
    rng = random.Random(2)
    texts = [f"please write e-mail to user{i}@mail{i % 7}.example.com or call +1 (212) 555-{1000 + i}" for i in range(60)]
    texts += [f"contact name{i} (at) mail{i} (dot) com today" for i in range(20)] + [f"order {rng.randrange(10**12)} shipped" for _ in range(40)]
    got, added = found(spark, texts)
    assert got == [",".join(base(t)) for t in texts]
    for t, spans in zip(texts, added):
        for s in spans:
            assert t.startswith("contact") and t[s["start"] : s["end"]] == t[8:].removesuffix(" today")
    assert sum(map(len, added)) == 20


def test_added_spans_keep_clear_of_others(spark):
    _, added = found(spark, NASTY + ["call 212 555 1234 and 212-555-1234-99 card 4111 1111 1111 1112"] * 5)
    for spans in added:
        places = sorted((s["start"], s["end"]) for s in spans)
        assert all(a[1] <= b[0] for a, b in zip(places, places[1:]))


def test_query_base_columns(spark, small):
    got = pii.op9_pii(spark, SF).toPandas().set_index("doc_id")
    for i, text in zip(small["documents"].doc_id, small["documents"].text):
        spans = base(text)
        assert got.base_sha256[i] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(got.spans[i].split(","))
        for k in PLAIN:
            assert got[f"n_{k}"][i] == sum(s.startswith(k) for s in spans)


def test_odd_rows(odd, none):
    got = pii.find_pii(odd, ["doc_id", "spans"]).collect()
    assert len(got) == len(ODD_ROWS) and got[0]["doc"]["spans"] == "own spans"
    assert pii.find_pii(none, []).count() == 0


@pytest.mark.parametrize("number", ["4111111111111111", "4111111111111112", "0", "18", "", "79927398713"])
def test_luhn(spark, number):
    want = bool(number) and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, number[::-1]))) % 10 == 0
    assert spark.createDataFrame([(number,)], "n string").select(pii.luhn(F.col("n"))).first()[0] == want
