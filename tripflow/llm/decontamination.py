"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test strings are windows of consecutive words of the benchmark items, between
single spaces. They are sorted into length classes, so that a short string does
not shorten the leaps of long ones. Per class a table says, for each block of
bytes, how far the search may leap when a text has that block at its end; where
it may not leap, the block's bucket and the string's first bytes select test
strings, and a direct comparison confirms them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripflow.llm.common import documents, numbered, stored, with_columns, words

#: entries of a leap table, a power of two; blocks that share an entry take the smaller leap
TABLE = 1 << 18
#: bytes of test strings searched for in one pass over the documents
BLOCK_BYTES = 4 << 20


class LengthClass:
    """Leap table and buckets of test strings that are at least ``shortest`` bytes long."""

    def __init__(self, strings: list[bytes]):
        self.shortest = m = min(map(len, strings))
        self.block = b = max(1, min(6, m // 2))
        self.leaps = bytearray([min(m - b + 1, 255)]) * TABLE
        self.buckets: dict[bytes, dict[bytes, list[bytes]]] = {}
        for s in strings:
            for end in range(b, m + 1):
                entry = hash(s[end - b : end]) & (TABLE - 1)
                self.leaps[entry] = min(self.leaps[entry], min(m - end, 255))
            self.buckets.setdefault(s[m - b : m], {}).setdefault(s[:b], []).append(s)

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(position, test string) of every occurrence."""
        m, b, leaps, buckets, mask = self.shortest, self.block, self.leaps, self.buckets, TABLE - 1
        end, last = m, len(text)
        while end <= last:
            suffix = text[end - b : end]
            leap = leaps[hash(suffix) & mask]
            if leap:
                end += leap
                continue
            same = buckets.get(suffix)
            if same:
                start = end - m
                for s in same.get(text[start : start + b], ()):
                    if text.startswith(s, start):
                        yield start, s
            end += 1


class Searcher:
    """All length classes of one block of (test string, item) pairs."""

    def __init__(self, pairs: list[tuple[bytes, str]]):
        self.items: dict[bytes, list[str]] = {}
        for s, item in pairs:
            self.items.setdefault(s, []).append(item)
        classes: dict[int, list[bytes]] = {}
        for s in self.items:
            classes.setdefault(len(s).bit_length(), []).append(s)
        self.classes = [LengthClass(strings) for _, strings in sorted(classes.items())]

    def hits(self, text: list[bytes]) -> tuple[list[list[int]], set[str | None]]:
        """Merged [first, end) word intervals inside occurrences, and the items that occur."""
        line = b" " + b" ".join(text) + b" "
        found: dict[int, int] = {}
        items: set[str | None] = set()
        for kind in self.classes:
            for at, s in kind.search(line):
                found[at] = max(found.get(at, 0), s.count(b" ") - 1)
                items.update(self.items[s])
        spans: list[list[int]] = []
        seen, word = 0, 0
        for at in sorted(found):
            word += line.count(b" ", seen, at)
            seen = at
            add_span(spans, word, word + found[at])
        return spans, items


def add_span(spans: list[list[int]], start: int, end: int) -> None:
    """Appends [start, end), whose start is not before the others, merging where they touch."""
    if spans and start <= spans[-1][1]:
        spans[-1][1] = max(spans[-1][1], end)
    else:
        spans.append([start, end])


def windows(benchmark: DataFrame, length: int) -> DataFrame:
    """Distinct (window, item): runs of ``length`` words of each item; an item of fewer, but not none, is one.

    Items without words have no windows; those of items without an id have a null item.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item"], pdf["text"]):
                w = words(text)
                starts = range(max(1, len(w) - length + 1)) if w else ()
                rows += [(b" " + b" ".join(w[i : i + length]) + b" ", item) for i in starts]
            yield pd.DataFrame(rows, columns=["window", "item"])

    named = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return named.mapInPandas(cut, "window binary, item string").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """(doc, n_words, spans, items): hit word intervals and item ids of each document.

    ``doc`` is the input row as a struct. The test strings are searched for in
    blocks of about ``BLOCK_BYTES``, one pass over the documents each, so any
    number of strings is complete. With several passes the documents are written
    once with a number each, and a pass writes numbers and spans of those it hits.
    Items without an id hit words like others and add no name to ``items``.
    Null and empty texts have no words and no hits. Repeated rows are searched
    one by one. Without test strings nothing is hit.
    """
    tests = stored(windows(benchmark, length), "windows")
    volume = tests.agg(F.sum(F.octet_length("window") + F.octet_length(F.coalesce("item", F.lit(""))))).first()[0] or 0
    passes = int(volume) // BLOCK_BYTES + 1

    def pairs(number: int):
        block = tests.where(F.pmod(F.xxhash64("window", "item"), F.lit(passes)) == number)
        return docs.sparkSession.sparkContext.broadcast([(bytes(r[0]), r[1]) for r in block.collect()])

    if passes == 1:
        whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
        schema = StructType([*whole.schema.fields, *StructType.fromDDL(_FOUND).fields])
        return whole.mapInArrow(_search(pairs(0), "doc", False), schema)
    table = numbered(docs, text=docs["text"])
    texts = table.select("row_id", "text")
    found = [
        stored(texts.mapInArrow(_search(pairs(n), "row_id", n > 0), f"row_id long, {_FOUND}"), "hits") for n in range(passes)
    ]
    every = reduce(DataFrame.union, found).groupBy("row_id")
    joined = every.agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return table.select("row_id", "doc").join(joined.mapInArrow(_merged, joined.schema), "row_id").drop("row_id")


_FOUND = "n_words int, spans array<struct<start:int,end:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _search(pairs, key: str, hits_only: bool):
    """For rows with ``key`` and a text, in it if it is a struct: number of words, spans and items; ``hits_only`` leaves the other rows out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(pairs)
        for batch in batches:
            rows, counts, spans, items = [], [], [], []
            text = batch.column("doc").field("text") if key == "doc" else batch.column("text")
            for row in range(batch.num_rows):
                w = words(text[row].as_py())
                hit, names = searcher.hits(w)
                if hit or not hits_only:
                    rows.append(row)
                    counts.append(len(w))
                    spans.append([{"start": s, "end": e} for s, e in hit])
                    items.append(sorted(n for n in names if n is not None))
            own = batch.column(key)
            own = own if len(rows) == len(own) else own.take(pa.array(rows, pa.int32()))
            arrays = [own, pa.array(counts, pa.int32()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, [key, "n_words", "spans", "items"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with sorted ``spans``, those that touch or overlap put together."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            joined: list[list[int]] = []
            for s in spans:
                add_span(joined, s["start"], s["end"])
            out.append([{"start": s, "end": e} for s, e in joined])
        columns = dict(zip(batch.schema.names, batch.columns)) | {"spans": pa.array(out, _SPANS)}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_CACHE: dict[int, Searcher] = {}


def _searcher(pairs) -> Searcher:
    """The searcher of a broadcast block, built once by each worker."""
    key = hash(tuple(pairs.value))
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Searcher(pairs.value)
    return _CACHE[key]


def hit_words(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """The documents without any window of a benchmark item, columns unchanged."""
    return with_columns(contamination(docs, benchmark, length).where(F.size("spans") == 0), "doc")


def op1_decontamination(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = hit_words("spans")
    return found.select(
        "doc.doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP1_SQL = r"""
with doc_words as materialized (
  select doc_id, regexp_extract_all(lower_text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_text
        from documents)
), item_words as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), item_windows as materialized (
  select distinct cast(item_id as varchar) as item, least(len(w), 10) as n,
    array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item_words where len(w) > 0)
), lengths as (
  select distinct n from item_windows
), doc_windows as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc_words, lengths where len(w) >= n)
), hits as materialized (
  select d.doc_id, d.i, d.n, t.item from doc_windows d join item_windows t on d.n = t.n and d.win = t.win
), hit_words as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id
), hit_items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item from hits where item is not null) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items,
  sha256(coalesce(t.items, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from doc_words d left join hit_words h using (doc_id) left join hit_items t using (doc_id)
"""
