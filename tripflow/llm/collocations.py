"""Phrase collocations by stripes.

A stripe belongs to a prefix of 0 to 3 words and counts the words that follow
it. Each task makes stripes of the texts it reads; they are shuffled in bundles
and merged elementwise. The entries of the merged stripes are the counts of all
extensions, a prefix's total is its own entry in the stripe one word shorter, and
the largest entry that extends a phrase by a word, before or after, decides
whether it is subsumed. A longer phrase that subsumes a shorter one has a part
one word longer than the shorter one that subsumes it, too, so one word is enough.

Stripes are made one length after the other. A phrase as frequent as asked has
frequent parts only, so a task counts a word after a prefix only where the prefix
and what follows its first word passed before. They are told by a filter of
bounded size without false negatives: what it lets through wrongly is counted
and dropped, so results are exact at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tripflow.llm.common import documents, mix64, stored

FREQUENT, LONGEST, FIRST = 30, 4, 2000
#: a phrase goes if a longer one has this many hundredths of its count
SUBSUMED = 80
#: a prefix of this count or more has its stripe in parts, by the next word; parts of it and of the empty prefix's
CROWDED, PARTS, VOCABULARY_PARTS = 20_000, 64, 256
#: bundles in which the stripes of a language are shuffled
BUNDLES = 256
#: bits of the filter for each phrase, at most altogether; probes
BITS, MOST_BITS, PROBES = 12, 1 << 27, 4
#: bytes of text that a task counts at once
CHUNK = 10 << 20

#: in place of what ends a piece; no byte of UTF-8
END = b"\xff"
#: pieces end at . , ; : ! ? and line breaks, a tab is a blank, A-Z become a-z
_LETTERS = bytes(
    END[0] if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def chunks(data: bytes, overlap: int) -> Iterator[list[bytes]]:
    """Words and ends of a text in parts of bounded size; each begins with the last ``overlap`` words of the one before."""
    data = data.translate(_LETTERS)
    kept: list[bytes] = []
    at = 0
    while at < len(data):
        to = data.find(b" ", at + CHUNK)
        to = len(data) if to < 0 else to
        tokens = data[at:to].replace(END, b" \xff ").split()
        yield kept + tokens
        kept = (kept + tokens)[-overlap:] if overlap else []
        at = to


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [mix64(h + np.uint64(i) * _BASE) & np.uint64(bits - 1) for i in range(PROBES)]


def _passes(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), dtype=bool)
    for p in _probes(h, len(bitmap) * 64):
        out &= (bitmap[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def _extended(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    with np.errstate(over="ignore"):
        return mix64(h * _BASE + word)


def _seed(lang: str) -> np.ndarray:
    return np.uint64(xxhash.xxh64_intdigest(lang))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def count(tokens: list[bytes], lang: str, m: int, bitmap: np.ndarray | None, crowded: np.ndarray | None) -> pa.RecordBatch:
    """Bundles (lang, bundle, stripes) of stripes of prefixes of ``m`` words, those that ``crowded`` passes in parts.

    A stripe is a line: the prefix, a tab, and each next word and its count, all
    with a blank between. No word holds a tab or a line break. A bundle has the
    stripes of many prefixes, so rows follow texts, not phrases.
    """
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    hashes, v = _word_hashes(words), len(words)
    inside = (codes != words.index(END)) if END in words else np.ones(len(codes), bool)
    n = max(0, len(codes) - m)
    alive = np.ones(n, dtype=bool)
    for i in range(m + 1):
        alive &= inside[i : n + i]
    if m:
        # prefixes that passed; the last m words must be one, too
        own = _extended(np.full(v, _seed(lang)), hashes)
        if m == 1:
            good = _passes(own, bitmap)[codes]
        else:
            good = np.zeros(n + 1, dtype=bool)
            at = np.flatnonzero(np.concatenate([alive, [False]]) | np.concatenate([[False], alive]))
            h = own[codes[at]]
            for i in range(1, m):
                h = _extended(h, hashes[codes[at + i]])
            good[at] = _passes(h, bitmap)
        alive &= good[:n] & good[1 : n + 1]
    at = np.flatnonzero(alive)
    group = np.zeros(len(at), dtype=np.int64)
    for i in range(m):
        group = pd.factorize(group * v + codes[at + i])[0].astype(np.int64)
    nth, pairs = pd.factorize(group * v + codes[at + m])
    counts = np.bincount(nth, minlength=len(pairs)).astype(np.int64)
    first = np.empty(len(pairs), dtype=np.int64)
    first[nth[::-1]] = at[::-1]
    prefix, after = pairs // v, (pairs % v).astype(np.int64)
    if m:
        h = own[codes[first]]
        for i in range(1, m):
            h = _extended(h, hashes[codes[first + i]])
        parts = np.where(_passes(h, crowded), np.uint64(PARTS), np.uint64(1))
        bundle = _extended(h, mix64(hashes[after]) % parts) % np.uint64(BUNDLES)
    else:
        bundle = mix64(hashes[after]) % np.uint64(VOCABULARY_PARTS)
    bundle = bundle.astype(np.int64)
    order = np.lexsort((prefix, bundle))
    prefix, after, bundle, counts, first = (x[order] for x in (prefix, after, bundle, counts, first))
    starts = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (bundle[1:] != bundle[:-1])])) if len(prefix) else np.zeros(0, int)
    numbers, count_at = np.unique(counts, return_inverse=True)
    told = pa.concat_arrays([coded.dictionary, pa.array([b"%d" % c for c in numbers.tolist()], pa.binary())])
    entries = told.take(pa.array(np.column_stack([after, v + count_at]).ravel()))
    entries = pa.ListArray.from_arrays(pa.array(2 * np.append(starts, len(prefix)), pa.int32()), entries)
    named = codes[first[starts][:, None] + np.arange(m)].tolist() if len(starts) else []
    prefixes = pa.array([b" ".join([words[c] for c in p]) for p in named], pa.binary())
    lines = pc.binary_join_element_wise(prefixes, pc.binary_join(entries, b" "), b"\t")
    held = bundle[starts]
    heads = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, int)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(heads), pa.string()),
            pa.array(held[heads], pa.int32()),
            pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(heads, len(held)), pa.int32()), lines), b"\n"),
        ],
        ["lang", "bundle", "stripes"],
    )


def _counter(m: int, bitmap: np.ndarray | None, crowded: np.ndarray | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                data = text.as_py()
                for tokens in chunks(data, m):
                    own = held.setdefault(lang, [])
                    own += tokens
                    own.append(END)
                size += len(data)
                if size >= CHUNK:
                    yield from (count(t, k, m, bitmap, crowded) for k, t in held.items() if t)
                    held, size = {}, 0
        yield from (count(t, k, m, bitmap, crowded) for k, t in held.items() if t)

    return run


def stripes(texts: DataFrame, m: int, known: DataFrame | None = None) -> DataFrame:
    """(lang, prefix, next, f): entries of the merged stripes of prefixes of ``m`` words, over rows (lang, text binary).

    ``known`` are the frequent phrases of ``m`` words. A prefix is of one bundle,
    but for a crowded one, whose parts are dealt over bundles so that it is not
    one task's; merging needs no further exchange.
    """
    filters = (None, None) if known is None else (membership(known), membership(known.where(F.col("f") >= CROWDED)))
    made = texts.mapInArrow(_counter(m, *filters), "lang string, bundle int, stripes binary")
    dealt = made.repartition("lang", "bundle")

    def entries(stripe: Column) -> Column:
        own = stripe["own"]
        places = F.sequence(F.lit(0), F.size(own) - 2, F.lit(2))
        return F.transform(places, lambda i: F.struct(stripe["prefix"].alias("prefix"), own[i].alias("next"), own[i + 1].cast("long").alias("n")))

    # each line is split once, and so is what follows its tab
    lines = F.transform(F.split(F.col("stripes").cast("string"), "\n"), lambda line: F.split(line, "\t"))
    held = F.transform(lines, lambda line: F.struct(line[0].alias("prefix"), F.split(line[1], " ").alias("own")))
    told = dealt.select("lang", "bundle", F.inline(F.flatten(F.transform(held, entries))))
    merged = told.groupBy("lang", "bundle", "prefix", "next").agg(F.sum("n").alias("f"))
    return merged.select("lang", F.col("prefix").cast("binary").alias("prefix"), "next", "f")


def membership(phrases: DataFrame) -> np.ndarray:
    """The filter of the rows (lang, phrase): a bitmap whose size follows their number up to MOST_BITS."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (BITS * phrases.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, split = batch.column("lang").to_pylist(), [p.split(b" ") for p in batch.column("phrase").to_pylist()]
            h = np.fromiter((_seed(x) for x in langs), np.uint64, len(langs))
            for i in range(len(split[0]) if split else 0):
                h = _extended(h, _word_hashes([p[i] for p in split]))
            at = np.concatenate(_probes(h, bits)) if len(h) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64))], ["at", "bit"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, dtype=np.uint64)
    bitmap[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bitmap


def frequent_phrases(texts: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Stored rows (lang, phrase, f) of the phrases of 1 to 4 words with f >= 30, by length, and (lang, n) with all words."""
    entries = stripes(texts, 0)
    # words below the bound count under null, for the total only
    word = F.when(F.col("f") >= FREQUENT, F.col("next").cast("binary"))
    words = stored(entries.groupBy("lang", word.alias("phrase")).agg(F.sum("f").alias("f")), "words")
    levels = [words.where("phrase is not null")]
    for m in range(1, LONGEST):
        found = stripes(texts, m, levels[-1]).where(F.col("f") >= FREQUENT)
        phrase = F.concat("prefix", F.lit(b" "), F.col("next").cast("binary")).alias("phrase")
        levels.append(stored(found.select("lang", phrase, "f"), f"phrases{m + 1}"))
    return levels, words.groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases of 2 to 4 words.

    A-Z are lower-cased; pieces end at . , ; : ! ? and line breaks, words at
    blanks and tabs. ``a`` counts the phrase, ``n`` all words; of the ways to cut
    it in two, ``l`` and ``r`` are the counts of both parts where
    floor(2000000 a / (l + r)) is least, at the first such cut. Phrases with
    a < 30 and those of which a longer phrase has 0.8 of the count are left out.

    A null language is ``und``, a null text empty; a text without words adds
    nothing. Texts of any length are counted whole, in parts. Repeated rows count
    each time; equal scores go by count, then by the bytes of the phrase. Other
    columns are not read. An empty table gives no rows.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where(F.length("text") > 0)
    levels, total = frequent_phrases(texts)
    named = [x.select("lang", F.col("phrase").cast("string").alias("phrase"), "f") for x in levels]
    longer = reduce(DataFrame.union, named[2:]).withColumn("words", F.split("phrase", " "))
    size = F.size("words")
    parts = F.array(F.concat_ws(" ", F.slice("words", F.lit(1), size - 1)), F.concat_ws(" ", F.slice("words", F.lit(2), size - 1)))
    largest = longer.select("lang", F.explode(parts).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    found = reduce(DataFrame.union, named[1:]).withColumnRenamed("f", "a").join(largest, ["lang", "phrase"], "left")
    found = found.where(f"within is null or 100 * cast(within as decimal(27,0)) < {SUBSUMED} * cast(a as decimal(27,0))")
    cut = found.withColumn("words", F.split("phrase", " ")).select(
        "lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    )
    sides = cut.select(
        "lang", "phrase", "a", "k",
        F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k"))).alias("left"),
        F.concat_ws(" ", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))).alias("right"),
    )
    counted = reduce(DataFrame.union, named[:-1])
    sides = sides.join(counted.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    sides = sides.join(counted.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("cast((2000000 * cast(a as decimal(27,0))) div (cast(l as decimal(27,0)) + r) as long)")
    least = sides.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    told = least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").join(total, "lang")
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    """The 2000 strongest collocations of each language in all documents."""
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(split) AS text FROM (
    SELECT coalesce(lang, 'und') AS lang, string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS split
    FROM documents)
), words AS (
  SELECT lang, list_filter(string_split_regex(text, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), phrases AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM words, range(1, 5) AS t(m) WHERE len(w) >= m
), counts AS (
  SELECT lang, m, phrase, count(*) AS f FROM phrases GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 30
), inside AS (
  SELECT lang, a AS f, array_to_string(w[i : j], ' ') AS phrase
  FROM candidates, range(1, 5) AS s(i), range(1, 5) AS t(j) WHERE i < j AND j <= m AND j - i + 1 < m
), largest AS (
  SELECT lang, phrase, max(f) AS within FROM inside GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN largest x USING (lang, phrase)
  WHERE x.within IS NULL OR 100::HUGEINT * x.within < 80::HUGEINT * c.a
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : m], ' ') AS y
  FROM kept, range(1, 4) AS t(k) WHERE k < m
), scored AS (
  SELECT c.lang, c.phrase, c.a, p.f AS l, q.f AS r, c.k, ((2000000::HUGEINT * c.a) // (p.f + q.f))::BIGINT AS score
  FROM cuts c JOIN counts p ON p.lang = c.lang AND p.phrase = c.x JOIN counts q ON q.lang = c.lang AND q.phrase = c.y
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least JOIN total USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
