import re

import pytest

from tripflow.llm import decontamination as dc

from .conftest import ODD_ROWS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, length):
    """{doc row: (words, hit words, items)} by comparing every window with every place."""
    windows = []
    for item, text in items:
        w = WORD.findall(lower(text))
        if w:
            windows += [(tuple(w[i : i + length]), item) for i in range(max(1, len(w) - length + 1))]
    out = []
    for text in docs:
        w = WORD.findall(lower(text))
        hit, names = set(), set()
        for win, item in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    if item is not None:
                        names.add(str(item))
        out.append((len(w), len(hit), sorted(names)))
    return out


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"),
    (2, "short one"),
    (10, "the"),
    (3, None),
    (4, "... !!"),
    (None, "no id has this item of words"),
    (5, "One two three four five six seven eight nine ten"),
    (6, "à é 日本語 ü\x7fx 123"),
    (7, "aa aa aa aa aa aa aa aa aa aa aa aa"),
    (1, "one two three four five six seven eight nine ten eleven twelve"),
]
TEXTS = [
    "zero ONE two, three four five six seven eight nine ten eleven thirteen",
    "a short one. Short-one; shorter one",
    "athe the other",
    None,
    "",
    "à É 日本語 ü x 123 à é 日本語 ü x 123",
    "aa " * 25,
    "one two three four five six seven eight nine",
    "no id has this item of words",
]


def result(found):
    rows = found.select("doc.text", "n_words", dc.hit_words("spans").alias("hit"), "items").collect()
    return {r["text"]: (r["n_words"], r["hit"], r["items"] or []) for r in rows}


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 150])
def test_matches_brute_force(spark, docs_like, monkeypatch, block_bytes):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block_bytes)  # small blocks mean several passes
    docs = docs_like([(i, t, None, None) for i, t in enumerate(TEXTS)])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert result(dc.contamination(docs, items)) == dict(zip(TEXTS, brute(TEXTS, ITEMS, 10)))


def test_clean_documents_stay_as_they_are(spark, odd, none):
    items = spark.createDataFrame([(1, "another text of the same id"), (2, "x" * 200_000)], "item_id long, text string")
    kept = dc.decontaminate(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ODD_ROWS) - 2
    assert {r["spans"] for r in kept.collect()} == {"own spans"}
    assert dc.decontaminate(none, items).count() == 0
    assert dc.decontaminate(odd, items.limit(0)).count() == len(ODD_ROWS)


def test_passes_write_no_texts(spark, docs_like, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 150)
    written, store = [], dc.stored
    monkeypatch.setattr(dc, "stored", lambda df, name: written.append((name, df.columns)) or store(df, name))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_like([(i, t, None, None) for i, t in enumerate(TEXTS)])
    assert dc.contamination(docs, items).count() == len(TEXTS)
    assert [n for n, _ in written[1:]] == ["hits"] * len(written[1:]) and len(written) > 3
    assert all(columns == ["row_id", "n_words", "spans", "items"] for _, columns in written[1:])


def test_items_without_an_id_hit(spark, docs_like):
    ten = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(None, ten)], "item_id long, text string")
    docs = docs_like([(1, f"zero {ten} eleven", "en", "s"), (2, "clean", "en", "s")])
    assert result(dc.contamination(docs, items)) == {f"zero {ten} eleven": (12, 10, []), "clean": (1, 0, [])}
    assert [r["doc_id"] for r in dc.decontaminate(docs, items).collect()] == [2]


def test_search_reports_every_occurrence():
    strings = [b" ab ", b" abc abc ", b" x y ", b" y x "]
    text = b" ab abc abc abc x y x ab "
    found = [hit for c in dc.Searcher([(s, "1") for s in strings]).classes for hit in c.search(text)]
    want = [(i, s) for s in strings for i in range(len(text)) if text.startswith(s, i)]
    assert sorted(found) == sorted(want)
