"""Near-duplicate documents by order MinHash.

A document's words become shingles, each labelled with how often it occurred
before. A sketch takes the few labelled shingles with the smallest hashes and
keeps their order in the text, so it changes when passages move; documents of a
high edit similarity share sketches often. Two sketches make a band. Documents
that share a band are candidates, and a banded alignment of their shingles
decides.

Texts with equal words are put together first and only one of each goes on.
Members of a small bucket are compared with each other. In a larger one all are
compared with its leader, the member that shares most places with others: in a
group of edited copies that is the least edited, which most of them are like.
Where a bucket is not of one class then, its members are compared with further
leaders, and once more in finer buckets, which the bands that follow cut out of
it. Up to here a document is compared with a bounded number of others for each
band, so pairs grow with documents however alike they are.

What is left are buckets that are still of several classes. Their members meet
once more by shingles, exactly: two that are similar share most shingles of both,
so they share one of the rarest few of each, and only shingles that occur in
several classes can join two. Classes are therefore those of all similar texts
that share a bucket, however crowded it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tripflow.llm.common import WORD_BYTES, documents, mix64, numbered, stored, with_columns, words
from tripflow.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
#: labelled shingles in a sketch, sketches in a band, bands
PICKS, ROWS, BANDS = 2, 2, 16
#: members of a bucket that are compared with each other; leaders of a larger one
SMALL, LEADERS = 8, 4
#: hashes held at once while a long text is sketched
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as the longest text needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            with np.errstate(over="ignore"):
                steps = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
                steps[0][0] = steps[1][0] = 1
                self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each lower-cased word."""
    data = np.frombuffer(text.encode("utf-8", "replace").translate(WORD_BYTES), dtype=np.uint8) if text else np.empty(0, np.uint8)
    letter = data != 32
    starts = np.flatnonzero(letter & np.concatenate([[True], ~letter[:-1]])) if len(data) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _POWERS.of(len(data))
    with np.errstate(over="ignore"):
        values = np.where(letter, data, 0).astype(np.uint64) * up
        return mix64(np.add.reduceat(values, starts) * down[starts])


def shingles(hashes: np.ndarray, length: int = SHINGLE) -> np.ndarray:
    """A hash of each run of ``length`` words; a shorter text that has words is one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(length, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * np.uint64(_BASE) + hashes[i : n - size + 1 + i]
        return mix64(out + np.uint64(size))


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingle hashes mixed with the number of earlier occurrences."""
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if first.all():
        return s
    at = np.arange(len(s))
    nth = np.empty(len(s), dtype=np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    with np.errstate(over="ignore"):
        return np.where(nth == 0, s, mix64(s + nth * np.uint64(_BASE)))


_SEEDS = mix64(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band from the word hashes of a text that has words."""
    s = labelled(shingles(hashes))
    n = len(s)
    picks = min(PICKS, n)
    keys = np.empty(len(_SEEDS), dtype=np.uint64)
    step = max(1, CHUNK // n)
    with np.errstate(over="ignore"):
        for at in range(0, len(_SEEDS), step):
            seeds = _SEEDS[at : at + step, None]
            h = (s[None, :] ^ seeds) * np.uint64(_BASE)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            lowest = np.argpartition(h, picks - 1, axis=1)[:, :picks] if picks < n else np.tile(np.arange(n), (len(seeds), 1))
            lowest.sort(axis=1)  # text order
            key = np.zeros(len(seeds), dtype=np.uint64)
            for i in range(picks):
                key = mix64(key * np.uint64(_BASE) + s[lowest[:, i]])
            keys[at : at + step] = key
        bands = keys.reshape(BANDS, ROWS)
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            out = mix64(out * np.uint64(_BASE) + bands[:, i])
    return out.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Insertions and deletions that turn ``a`` into ``b``; None if more than ``most``.

    Works outward from the main diagonal and never leaves the band that ``most``
    allows; what is equal at both ends is skipped first.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    if n:
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        tail = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        edits = len(a) + len(b)
        return edits if edits <= most else None
    x, y, la, lb = a.tolist(), b.tolist(), len(a), len(b)
    reach = {1: 0}
    for edits in range(min(most, la + lb) + 1):
        low, high = -edits + 2 * max(0, edits - lb), edits - 2 * max(0, edits - la)
        for k in range(low, high + 1, 2):
            down, right = reach.get(k + 1, -1), reach.get(k - 1, -2) + 1
            i = down if k == -edits or (k != edits and right <= down) else right
            j = i - k
            while i < la and j < lb and x[i] == y[j]:
                i, j = i + 1, j + 1
            reach[k] = i
            if i >= la and j >= lb:
                return edits
    return None


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether shingles aligned in order are ``similarity`` of all shingles of both texts, or more.

    With m aligned shingles the measure is m / (len(a) + len(b) - m).
    """
    total = len(a) + len(b)
    most = int(total - 2 * similarity * total / (1 + similarity) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    # shingles in common, in any order, bound what an alignment can reach
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if total - 2 * int(np.minimum(ca[ia], cb[ib]).sum()) > most:
        return False
    return aligned(a, b, most) is not None


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, words_key, bands) per row (row_id, text): a digest of the words, and band keys.

    A text without words has no bands and the digest of its characters; a null text is an empty one.
    """
    for batch in batches:
        digests, keys = [], []
        for text in batch.column("text").to_pylist():
            hashes = word_hashes(text)
            # a word has no blank at its end, so no text without words meets one with words
            told = b" ".join(words(text)) if len(hashes) else (text or "").encode("utf-8", "replace") + b" "
            digests.append(hashlib.blake2b(told, digest_size=16).digest())
            keys.append(band_keys(hashes) if len(hashes) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["row_id", "words_key", "bands"],
        )


@F.pandas_udf(BooleanType())
def verified(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([similar(shingles(word_hashes(a)), shingles(word_hashes(b))) for a, b in zip(left, right)], dtype=bool)


def _ordered(pairs: DataFrame, one: str, other: str) -> DataFrame:
    return pairs.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def shared_buckets(bands: DataFrame) -> DataFrame:
    """(bucket, finer, row_id, n, met) for the n members of each bucket of two or more, from (row_id, bands).

    ``finer`` tells the members apart that differ in one of the next two bands;
    ``met`` is how many places a row shares with others, over all its buckets.
    """
    own = F.col("bands")
    key = F.transform(own, lambda x, i: F.struct(x.alias("bucket"), F.xxhash64(x, own[(i + 1) % BANDS], own[(i + 2) % BANDS]).alias("finer")))
    buckets = bands.where(own.isNotNull()).select("row_id", F.inline(key))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = stored(buckets.join(sizes, "bucket"), "members_of_buckets")
    met = rows.groupBy("row_id").agg(F.sum("n").alias("met"))
    return rows.join(met, "row_id").select("bucket", "finer", "row_id", "n", "met")


def _each_other(rows: DataFrame, key: str) -> DataFrame:
    """(x, y) of all members of each small bucket, from (key, row_id)."""
    return rows.select(key, F.col("row_id").alias("x")).join(rows.select(key, F.col("row_id").alias("y")), key).where("x < y").select("x", "y")


def _leaders(rows: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """(key, leader): the members of the places ``first`` to ``last`` by what they meet; found before rows are shuffled."""
    order = W.partitionBy(key).orderBy(F.col("met").desc(), F.xxhash64("row_id"), "row_id")
    ranked = rows.select(key, "row_id", F.row_number().over(order).alias("place")).where(F.col("place") <= last)
    return ranked.where(F.col("place") >= first).select(key, F.col("row_id").alias("leader"))


def first_pairs(shared: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: the members of small buckets, and those of larger ones with their leader."""
    small, large = shared.where(F.col("n") <= SMALL), shared.where(F.col("n") > SMALL)
    led = large.select("bucket", "row_id").join(_leaders(large, "bucket", 1, 1), "bucket").where("row_id != leader")
    return _ordered(_each_other(small, "bucket").union(led.select("row_id", "leader")), "x", "y")


def further_pairs(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct (a, b) of different roots in larger buckets: with further leaders, and within finer buckets.

    ``roots`` are (node, root) of the links among ``first_pairs``.
    """
    large = shared.where(F.col("n") > SMALL).join(roots.toDF("row_id", "root"), "row_id", "left")
    large = large.withColumn("root", F.coalesce("root", "row_id"))
    several = large.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    left = stored(large.join(several.select("bucket"), "bucket"), "open")
    root_of = left.select(F.col("row_id").alias("leader"), F.col("root").alias("over")).distinct()

    def led(rows: DataFrame, key: str, first: int, last: int) -> DataFrame:
        leaders = _leaders(rows, key, first, last).join(root_of, "leader")
        return rows.select(key, "row_id", "root").join(leaders, key).where("root != over").select(F.col("row_id").alias("x"), F.col("leader").alias("y"))

    finer = left.groupBy("finer").agg(F.count("*").alias("of_finer"), F.min("root").alias("low"), F.max("root").alias("high"))
    cut = left.join(finer.where("low < high").select("finer", "of_finer"), "finer")
    small = _each_other(cut.where(F.col("of_finer") <= SMALL), "finer")
    pairs = led(left, "bucket", 2, LEADERS).union(small).union(led(cut.where(F.col("of_finer") > SMALL), "finer", 1, LEADERS))
    return _ordered(pairs, "x", "y")


def _needed(n: Column) -> Column:
    """How many of ``n`` shingles a text has in common with any that is similar to it, at least."""
    return F.ceil(n * SIMILARITY - 1e-6)


def _labelled_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, root, shingles) per row (row_id, root, text)."""
    for batch in batches:
        own = [labelled(shingles(word_hashes(text))).view(np.int64) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), batch.column("root"), pa.array(own, pa.list_(pa.int64()))], ["row_id", "root", "shingles"]
        )


def remaining_pairs(shared: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (a, b) of different roots in larger buckets that can be similar; no similar pair is left out.

    ``roots`` are (node, root) of the links so far, ``texts`` (row_id, text) of
    all members. Similar texts have ``_needed`` labelled shingles in common, and
    all of these occur under both roots. So a text with too few that occur under
    several roots is done, and of the others, in one order of all shingles with
    those under one root first, then by frequency, the first n - needed + 1 of
    both have one in common.
    """
    large = shared.where(F.col("n") > SMALL).select("bucket", "row_id").join(roots.toDF("row_id", "root"), "row_id", "left")
    large = large.withColumn("root", F.coalesce("root", "row_id"))
    several = large.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    left = large.join(several.select("bucket"), "bucket").select("row_id", "root").distinct()
    told = texts.join(left, "row_id").select("row_id", "root", "text").mapInArrow(_labelled_shingles, "row_id long, root long, shingles array<long>")
    own = stored(told.select("row_id", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "shingles")
    common = own.groupBy("shingle").agg(F.count("*").alias("f"), F.min("root").alias("low"), F.max("root").alias("high"))
    met = own.join(common.where("low < high").select("shingle", "f"), "shingle")
    in_order = W.partitionBy("row_id").orderBy("f", "shingle")
    met = met.withColumns({"place": F.row_number().over(in_order), "met": F.count("*").over(W.partitionBy("row_id"))})
    # those under one root come first and join nothing
    met = met.withColumn("at", F.col("place") + F.col("n") - F.col("met"))
    first = met.where((F.col("met") >= _needed(F.col("n"))) & (F.col("at") <= F.col("n") - _needed(F.col("n")) + 1))
    first = stored(first.select("shingle", "row_id", "root", "n", "at"), "rarest")
    x, y = (first.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("row_id", "root", "n", "at")]) for side in "xy")
    # where the first shingle in common stands tells how many can be, and both sizes how many must be
    can = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) + 1
    must = F.ceil((F.col("n_x") + F.col("n_y")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6)
    met = x.join(y, "shingle").where("row_id_x < row_id_y and root_x != root_y").where(can >= must)
    return _ordered(met, "row_id_x", "row_id_y")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for links (a, b): the smallest node that each node is joined to by links.

    Every node points to a smaller one it is linked with; pointers are followed
    and links are pulled up to their ends' roots until none joins two roots.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    roots = cut_lineage(nodes.select("node", F.col("node").alias("root")))
    edges = links
    while True:
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).where("low < node")
        hook = cut_lineage(hook)
        if hook.isEmpty():
            return roots
        # follow the pointers among roots to their ends
        while True:
            further = hook.alias("h").join(hook.alias("g"), F.col("h.low") == F.col("g.node"), "left")
            jumped = cut_lineage(
                further.select("h.node", F.coalesce("g.low", "h.low").alias("low"), F.col("g.low").isNotNull().alias("moved"))
            )
            hook = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        new = hook.withColumnRenamed("node", "old")
        roots = cut_lineage(
            roots.join(new, roots["root"] == new["old"], "left").select("node", F.coalesce("low", "root").alias("root"))
        )
        left, right = new.toDF("old_a", "low_a"), new.toDF("old_b", "low_b")
        raised = edges.join(left, edges["a"] == left["old_a"], "left").join(right, edges["b"] == right["old_b"], "left")
        edges = cut_lineage(
            raised.select(F.coalesce("low_a", "a").alias("a"), F.coalesce("low_b", "b").alias("b"))
            .where("a != b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )


def classes(table: DataFrame) -> DataFrame:
    """(row_id, n_links, class_row) for rows (row_id, text) of a stored table.

    ``class_row`` is the smallest row of the group, ``n_links`` the links that
    were found between the row's words and other words. Members of a crowded
    bucket that are known to be of one class are not all compared, so there can
    be more links within a large group, but none between two groups.
    """
    sketched = stored(
        table.select("row_id", "text").mapInArrow(_sketch, "row_id long, words_key binary, bands array<long>"), "sketches"
    )
    heads = sketched.groupBy("words_key").agg(F.min(F.struct("row_id", "bands")).alias("head"))
    heads = stored(heads.select("words_key", "head.*"), "heads")
    shared = stored(shared_buckets(heads), "buckets")
    members = shared.select("row_id").distinct()
    texts = stored(table.select("row_id", "text").join(members.hint("shuffle_hash"), "row_id", "left_semi"), "members")
    a = texts.select(F.col("row_id").alias("a"), F.col("text").alias("left"))
    b = texts.select(F.col("row_id").alias("b"), F.col("text").alias("right"))

    def verify(pairs: DataFrame) -> DataFrame:
        return stored(pairs.join(a, "a").join(b, "b").where(verified("left", "right")).select("a", "b"), "links")

    pairs = stored(first_pairs(shared), "pairs")
    links = verify(pairs)
    roots = components(links)
    further = stored(further_pairs(shared, roots).join(pairs, ["a", "b"], "left_anti"), "further")
    links = links.union(verify(further))
    roots = components(links)
    # the exact way for what leaders do not reach
    rest = verify(remaining_pairs(shared, roots, texts).join(pairs.union(further), ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = links.union(rest)
        roots = components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("head")).groupBy("head").agg(F.count("*").alias("n_links"))
    roots = roots.toDF("head", "class_row")
    told = heads.select("words_key", F.col("row_id").alias("head")).join(ends, "head", "left").join(roots, "head", "left")
    return sketched.select("row_id", "words_key").join(told, "words_key").select(
        "row_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_row", "head").alias("class_row"),
    )


def _table(docs: DataFrame, doc: list[str] | None = None) -> DataFrame:
    doc_id = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long")
    return numbered(docs, doc, doc_id=doc_id, text=F.col("text"))


def _first_of_class(table: DataFrame, told: DataFrame) -> DataFrame:
    """(class_row, doc_id, row_id) of the document that stands for each class: the smallest id, nulls last."""
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_id")
    rows = table.select("row_id", "doc_id").join(told, "row_id")
    return rows.groupBy("class_row").agg(F.min(order).alias("first")).select("class_row", "first.doc_id", "first.row_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; columns unchanged.

    Groups are joined by links: texts with equal words, or with an aligned
    5-word-shingle similarity of 0.8 or more. Texts without words are grouped by
    their characters, null as empty; others by their words alone. Rows with equal
    texts are one group however they differ elsewhere; of rows with the same id,
    or none, one stays. A text of any length is sketched whole; a task holds some
    40 bytes for each of its characters meanwhile. Other columns are kept as they
    are, whatever their names. An empty table stays empty.
    """
    table = _table(docs, [c for c in docs.columns if c != "text"])
    kept = _first_of_class(table, stored(classes(table), "classes")).select("row_id")
    rows = table.join(kept.hint("shuffle_hash"), "row_id", "left_semi")
    return with_columns(rows, "doc", text=F.col("text")).select(*docs.columns)


def op10_near_dedup(spark, sf_dir):
    """Each document's class, named by its smallest doc_id, whether it stands for it, and its links to other texts."""
    table = _table(documents(spark, sf_dir), [])
    told = stored(classes(table), "classes")
    named = _first_of_class(table, told).select(F.col("doc_id").alias("class_id"), F.col("row_id").alias("kept"), "class_row")
    return (
        table.select("row_id", "doc_id")
        .join(told, "row_id")
        .join(named, "class_row")
        .select("doc_id", "class_id", "n_links", (F.col("row_id") == F.col("kept")).alias("kept"))
    )
