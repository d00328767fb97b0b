"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last few bytes says where a chunk ends, so an edit moves
only the ends near it. Each chunk gives one character of a signature. The mean
chunk length follows the text's length in powers of two, and a second signature
is made at twice that length, so texts of somewhat different lengths can still be
compared, by edit distance, at a length they share. Where repetition gives no ends,
chunks end at a fixed length after the last one, so texts that repeat one line are
compared at such a length, too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tripflow.llm.common import documents, mix64, stored
from tripflow.llm.near_dedup import _POWERS

#: characters of signatures
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+-", dtype=np.uint8)
#: fewer chunks than this halve the chunk length; a chunk is at most so many times the mean length
FEW, LONGEST = 32, 4
_ROLL = 0x2C1B3C6D


def _shifted(x: np.ndarray, by: int, factor: int) -> np.ndarray:
    out = x.copy()
    out[by:] += x[:-by] * np.uint32(factor & 0xFFFFFFFF)
    return out


def _rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the eight bytes up to each position, from sums over two, four and eight."""
    with np.errstate(over="ignore"):
        h = data.astype(np.uint32) + np.uint32(1)
        for by in (1, 2, 4):
            if len(h) > by:
                h = _shifted(h, by, pow(_ROLL, by, 1 << 32))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        return h ^ (h >> np.uint32(13))


def _ends(rolled: np.ndarray, bits: int) -> np.ndarray:
    """Where chunks of mean length 2**bits end.

    Ends crowded by repetition are thinned to a quarter of that apart, and
    stretches without ends are cut at ``LONGEST`` times that.
    """
    n = len(rolled)
    if bits:
        ends = np.flatnonzero(rolled >> np.uint32(32 - bits) == (1 << bits) - 1) + 1
    else:
        ends = np.arange(1, n + 1)
    if bits > 2 and len(ends) > 4 * (n >> bits) + 4:
        kept, at = [], 0
        while at < len(ends):
            kept.append(int(ends[at]))
            at = int(np.searchsorted(ends, ends[at] + (1 << bits) // 4))
        ends = np.array(kept)
    ends = ends if len(ends) and ends[-1] == n else np.append(ends, n)
    longest = LONGEST << bits
    starts = np.concatenate([[0], ends[:-1]])
    cuts = (ends - starts - 1) // longest
    if cuts.any():
        nth = np.arange(1, cuts.sum() + 1) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        ends = np.sort(np.concatenate([ends, np.repeat(starts, cuts) + nth * longest]))
    return ends


def _signature(sums: np.ndarray, down: np.ndarray, ends: np.ndarray) -> str:
    starts = np.concatenate([[0], ends[:-1]])
    with np.errstate(over="ignore"):
        h = mix64(np.add.reduceat(sums, starts) * down[starts] + (ends - starts).astype(np.uint64))
    return ALPHABET[h >> np.uint64(58)].tobytes().decode()


def fingerprint(text: str) -> str:
    """``length:signature:signature at twice that length``; an empty text has empty signatures."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = len(data)
    if not n:
        return "1::"
    bits = max(0, n.bit_length() - 7)
    rolled = _rolling(data)
    ends = _ends(rolled, bits)
    while len(ends) < FEW and bits:
        bits -= 1
        ends = _ends(rolled, bits)
    up, down = _POWERS.of(n)
    with np.errstate(over="ignore"):
        sums = (data.astype(np.uint64) + np.uint64(1)) * up
    return f"{1 << bits}:{_signature(sums, down, ends)}:{_signature(sums, down, _ends(rolled, bits + 1))}"


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else 1 - edit distance / longer length of signatures of one chunk length, 0 without one."""

    def part(f: Column, i: int) -> Column:
        return F.split_part(f, F.lit(":"), F.lit(i))

    def alike(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer > 0, 1 - F.levenshtein(x, y) / longer).otherwise(1.0)

    ka, kb = part(a, 1).cast("long"), part(b, 1).cast("long")
    return (
        F.when(a == b, 1.0)
        .when(ka == kb, F.greatest(alike(part(a, 2), part(b, 2)), alike(part(a, 3), part(b, 3))))
        .when(ka == 2 * kb, alike(part(a, 2), part(b, 3)))
        .when(kb == 2 * ka, alike(part(a, 3), part(b, 2)))
        .otherwise(0.0)
    )


def edited(text: str, following: str) -> str:
    """``text`` with its last third of code points replaced by as many first ones of ``following``, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


PASS = "part int, kind int, {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, text string"
#: kinds of rows that a partition writes: done, waiting for the next partition's first text, that first text
DONE, LAST, FIRST = 0, 1, 2


def _finish(doc_id, text: str, own: str, following: str, next_own: str) -> tuple:
    new = edited(text, following)
    digest = hashlib.sha256(new.encode("utf-8", "replace")).hexdigest()
    return (doc_id, len(text), digest, own, own if new == text else fingerprint(new), next_own)


def _walk(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                own = fingerprint(text)
                if held is None:
                    out.append((part, FIRST, doc_id, None, None, own, None, None, text))
                else:
                    out.append((part, DONE, *_finish(*held, text, own), None))
                held = (doc_id, text, own)
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out))), schema=schema) if out else batch_of(schema)
        if held is not None:
            row = (part, LAST, held[0], None, None, held[2], None, None, held[1])
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(schema.names, row)}, schema=schema)

    return run


def batch_of(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: [] for n in schema.names}, schema=schema)


def _join_up(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(0, DONE, *_finish(*r.values()), None) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows))), schema=schema) if rows else batch_of(schema)

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint), one per row of ``docs``.

    The next document is the one with the next smaller doc_id, after the last the
    first; nulls come last, and rows of one id are ordered by a hash of their
    text. A null text is empty. Other columns are ignored. An empty table gives
    no rows; a single row is its own next.

    Documents are sorted once, in ranges. A range's last document waits for the
    first text of the next range, which is written beside the results; there are
    as many such texts as ranges.
    """
    ordered = docs.select("doc_id", "text")
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    ddl = PASS.format(id=f"doc_id {dict(docs.dtypes)['doc_id']}")
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    walked = stored(ordered.mapInArrow(_walk(schema), ddl), "fingerprints")
    first = walked.where(F.col("kind") == FIRST).select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp")
    )
    # one row per range
    parts = walked.where(F.col("kind") == LAST).select("part")
    by_part = W.orderBy("part")
    chain = parts.select(
        "part",
        F.coalesce(F.lead("part").over(by_part), F.min("part").over(W.partitionBy())).alias("next_part"),
    )
    last = walked.where(F.col("kind") == LAST).join(chain, "part").join(first, "next_part")
    ends = last.select("doc_id", "text", "fingerprint", "next_text", "next_fp").mapInArrow(_join_up(schema), ddl)
    return walked.where(F.col("kind") == DONE).unionByName(ends).drop("part", "kind", "text")


def op7_fingerprints(spark, sf_dir):
    return fingerprints(documents(spark, sf_dir)).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
