import random
import re
from collections import Counter

import pytest

from tripflow.llm import collocations as co

from .conftest import LONG, ODD_ROWS


def pieces(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", text)]


def brute(rows, first=2000):
    """Result rows over (lang, text), by counting every phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            f.update((lang, *p[i : i + m]) for m in range(1, 5) for i in range(len(p) - m + 1))
    candidates = [p for p, c in f.items() if len(p) > 2 and c >= 30]
    within = Counter()
    for lang, *w in candidates:
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    within[(lang, *w[i:j])] = max(within[(lang, *w[i:j])], f[(lang, *w)])
    by_lang = {}
    for p in candidates:
        lang, *w = p
        if 100 * within[p] >= 80 * f[p]:
            continue
        cuts = [(f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, left, right = min((2000000 * f[p] // (a + b), k, a, b) for k, (a, b) in enumerate(cuts))
        by_lang.setdefault(lang, []).append((-score, -f[p], " ".join(w).encode(), left, right))
    return sorted(
        (lang, r, w.decode(), -a, left, right, n[lang], -s)
        for lang, found in by_lang.items()
        for r, (s, a, w, left, right) in enumerate(sorted(found)[:first], 1)
    )


def found(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n, size):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "über", "x-y", "日本", "(see", "end\x85mid", "no break"] + [f"w{i}" for i in range(12)]
    ends = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", " ; ", "?!"]
    fixed = ["the quick brown fox jumps over", "New York City", "a a a a a"]
    out = []
    for _ in range(n):
        text = "".join((rng.choice(fixed) if rng.random() < 0.1 else rng.choice(words)) + rng.choice(ends) for _ in range(rng.randrange(size)))
        out.append((rng.choice(["en", "en", "en", "de", None]), text))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_matches_brute_force(spark, docs_like, seed):
    rows = texts(seed, 150, 120)
    got = found(co.collocations(docs_like([(i, t, lang, "src") for i, (lang, t) in enumerate(rows)])))
    assert got and got == brute(rows)


def test_first_of_each_language(spark, docs_like):
    rows = texts(9, 120, 120)
    got = found(co.collocations(docs_like([(i, t, lang, "src") for i, (lang, t) in enumerate(rows)]), 7))
    assert got == brute(rows, 7) and {r[0] for r in got} == {"en", "de", "und"}


def test_parts_of_long_texts_join(spark, docs_like, monkeypatch):
    text = "one two three four five. " * 40 + "six seven eight " * 50
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(co, "CHUNK", size)
        for m in range(4):
            grams = Counter()
            for tokens in co.chunks(text.encode(), m):
                grams.update(tuple(tokens[i : i + m + 1]) for i in range(len(tokens) - m) if co.END not in tokens[i : i + m + 1])
            want = Counter(tuple(w.encode() for w in p[i : i + m + 1]) for p in pieces(text) for i in range(len(p) - m))
            assert grams == want


def test_filter_has_no_false_negatives(spark):
    phrases = [("en", f"w{i} über{i % 7}".encode()) for i in range(3000)]
    bitmap = co.membership(spark.createDataFrame(phrases, "lang string, phrase binary"))

    def hashed(lang, phrase):
        h = co.np.full(1, co._seed(lang))
        for w in phrase.split(b" "):
            h = co._extended(h, co._word_hashes([w]))
        return h[0]

    inside = co.np.array([hashed(*p) for p in phrases])
    outside = co.np.array([hashed("en", f"v{i} x".encode()) for i in range(3000)])
    assert co._passes(inside, bitmap).all() and co._passes(outside, bitmap).mean() < 0.05


@pytest.mark.parametrize("bits, crowded", [(64, 20_000), (1 << 20, 30), (64, 30)])
def test_full_filters_and_parted_stripes_change_nothing(spark, docs_like, monkeypatch, bits, crowded):
    rows = texts(3, 80, 100)
    monkeypatch.setattr(co, "MOST_BITS", bits)
    monkeypatch.setattr(co, "CROWDED", crowded)
    got = found(co.collocations(docs_like([(i, t, lang, "src") for i, (lang, t) in enumerate(rows)])))
    assert got == brute(rows)


def test_rows_that_are_shuffled_follow_texts_not_phrases(spark):
    rng = random.Random(6)
    tokens = [f"w{rng.randrange(3000)}".encode() for _ in range(60_000)]
    full = co.np.full(16, -1, dtype=co.np.int64).view(co.np.uint64)
    empty = co.np.zeros(16, dtype=co.np.uint64)
    for m, crowded in ((1, empty), (2, empty), (1, full)):
        made = co.count(tokens, "en", m, full, crowded)
        assert len(made) <= co.BUNDLES
        grams = Counter()
        for stripes in made.column("stripes").to_pylist():
            for line in stripes.split(b"\n"):
                prefix, entries = line.split(b"\t")
                entries = entries.split(b" ")
                for word, n in zip(entries[::2], entries[1::2]):
                    grams[(*prefix.split(b" "), word)] += int(n)
        assert grams == Counter(tuple(tokens[i : i + m + 1]) for i in range(len(tokens) - m))


def test_odd_rows(spark, odd, none, docs_like):
    assert found(co.collocations(odd)) == brute([(lang, t) for _, t, lang, _ in ODD_ROWS])
    assert co.collocations(none).count() == 0
    repeated = [(1, "same old words", "en", "s")] * 40 + [(2, LONG, "de", "s"), (3, "", "fr", "s")]
    got = found(co.collocations(docs_like(repeated)))
    assert got == brute([(r[2], r[1]) for r in repeated]) and ("en", 1, "same old words", 40, 40, 40, 120, 1000000) in got
