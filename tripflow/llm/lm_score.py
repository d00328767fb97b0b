"""Language-model scores by online logistic context mixing.

A text is its lower-cased words, single spaces and an end mark, written in 5-bit
symbols: one for each of 31 common bytes, an escape and two half bytes for any
other. Each bit is predicted from several contexts, the last few symbols and the
word so far, hashed into tables of counts that all training documents filled. The
predictions meet in the logistic domain: weights, chosen by how well the long
contexts are known, mix them, and a refinement table maps the mixed prediction to
what came true. Both are learned online while a window of text is read, in steps
of a few symbols, so many windows advance together.

What is learned from the corpus are counts: each task fills its own tables and
sends on the entries it used, packed in blocks, which are summed by block.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import documents, mix64, numbered, stored
from tripflow.llm.near_dedup import _POWERS

END = b"\n"
COMMON = b" abcdefghijklmnopqrstuvwxyz,.\xc3" + END
ESCAPE = 31
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: contexts: symbols looked back on (0: the word so far), and bits of its hashed table's slots
CONTEXTS = [(3, 15), (4, 18), (6, 19), (10, 19), (0, 19)]
LONG, WORD = 3, 4
PAD = max(back for back, _ in CONTEXTS)
#: slots of 32 counts in a block that is summed as one
BLOCK_SLOTS = 1 << 11
#: symbols read before weights start anew, symbols between two updates, windows that advance together
WINDOW, STEP, LANES = 4096, 32, 256
#: symbols prepared at once, and those whose slots are worked out together
CHUNK, BLOCK = 1 << 20, 1 << 14
#: first weights by context: where long contexts are unknown, one is known, both are
FIRST_WEIGHTS = np.array(
    [[0.4, 0.4, 0.4, 0.1, 0.1], [0.2, 0.3, 0.2, 0.4, 0.2], [0.2, 0.3, 0.2, 0.2, 0.4], [0.1, 0.1, 0.15, 0.45, 0.3]],
    dtype=np.float32,
)
WEIGHT_RATE, TABLE_RATE = 0.008, 0.05
#: tables hold log odds in sixteenths
SCALE = 16
#: documents in an Arrow batch at most
BATCH = 1000
#: input splits that one task counts, where that leaves every core a task
SPLITS_PER_TASK = 4
#: tasks whose counts of a block are summed at once
TOGETHER = 64
#: words whose counts every task knows, each of so many bytes at most; the rest is joined
FREQUENT, FREQUENT_BYTES = 1 << 18, 64

_SYMBOL = bytes(COMMON.index(b) if b in COMMON else ESCAPE for b in range(256))
_END_SYMBOL = len(COMMON) - 1
# the path of each symbol through a tree of 31 inner nodes: nodes 1 to 31
_NODES = np.array([[(32 + s) >> (5 - d) for s in range(32)] for d in range(5)], dtype=np.int64)
_UP = np.arange(5, 0, -1, dtype=np.uint8)[:, None, None]
_DOWN = _UP - np.uint8(1)
_GATES = np.arange(len(FIRST_WEIGHTS), dtype=np.uint8)


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return _tokens(text.encode("utf-8", "replace")) if text else []


def _tokens(data: bytes | None) -> list[bytes]:
    return data.translate(LOWER).split() if data else []


def _each(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    """The UTF-8 of a batch's texts, one text at a time: a batch may hold thousands of long ones."""
    return (text.as_py() for text in batch.column("text").cast(pa.binary()))


def symbols(words: list[bytes]) -> np.ndarray:
    """The 5-bit symbols of words, spaces and the end mark."""
    return _escaped(b" ".join(words) + END)[0]


def _escaped(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, bytes that take three of them)."""
    first = np.frombuffer(data.translate(_SYMBOL), dtype=np.uint8)
    rare = np.flatnonzero(first == ESCAPE)
    if not len(rare):
        return first, rare
    at = rare + 2 * np.arange(len(rare))
    out, plain = np.empty(len(first) + 2 * len(rare), dtype=np.uint8), np.ones(len(first) + 2 * len(rare), dtype=bool)
    plain[at + 1] = plain[at + 2] = False
    out[plain] = first
    byte = np.frombuffer(data, dtype=np.uint8)[rare]
    out[at + 1], out[at + 2] = byte >> 4, byte & 15
    return out, rare


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts with a pad of end marks before each, first, end): the pad hides one text from the next."""
    pad = np.full(PAD, _END_SYMBOL, dtype=np.uint8)
    flat = np.concatenate([x for t in texts for x in (pad, t)])
    ends = np.cumsum([len(t) + PAD for t in texts])
    return flat, ends - [len(t) for t in texts], ends


def joined_lines(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``joined`` symbols of texts that are given as words with single spaces, without the end mark."""
    flat, rare = _escaped(b"".join(x for line in lines for x in (END * PAD, line, END)))
    size = np.array([len(line) + 1 for line in lines])
    ends = np.cumsum(size + PAD)
    firsts = ends - size
    return flat, firsts + 2 * np.searchsorted(rare, firsts), ends + 2 * np.searchsorted(rare, ends)


def slots(flat: np.ndarray) -> list[np.ndarray]:
    """For each context the table slot at each position."""
    out = [np.empty(len(flat), dtype=np.int32) for _ in CONTEXTS]
    begins = np.flatnonzero(np.concatenate([[True], (flat[:-1] == 0) | (flat[:-1] == _END_SYMBOL)]))
    a = 0
    while a < len(flat):
        # what a block looks back on: some symbols and the word it begins in; within a long word blocks double
        word = int(begins[np.searchsorted(begins, a, side="right") - 1])
        first = max(min(a - PAD, word), 0)
        b = a + max(BLOCK, a - first)
        for whole, part in zip(out, _slots(flat[first:b])):
            whole[a:b] = part[a - first :]
        a = b
    return out


def _slots(flat: np.ndarray) -> Iterator[np.ndarray]:
    """``slots`` of a short run of symbols."""
    n = len(flat)
    # the last 1, 2, 4, 8 symbols, the latest in the lowest bits
    last = {1: np.zeros(n, dtype=np.uint64)}
    last[1][1:] = flat[:-1]
    k = 1
    while 2 * k <= PAD:
        last[2 * k] = last[k].copy()
        last[2 * k][k:] |= last[k][:-k] << np.uint64(5 * k)
        k *= 2
    with np.errstate(over="ignore"):
        for back, bits in CONTEXTS:
            if back:
                h, done = np.zeros(n, dtype=np.uint64), 0
                for k in last:
                    if back & k:
                        h[done:] |= last[k][: n - done] << np.uint64(5 * done)
                        done += k
                if bits < 5 * back:
                    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            else:
                up, down = _POWERS.of(n + 1)
                sums = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:n])])
                stop = (flat == 0) | (flat == _END_SYMBOL)
                start = np.maximum.accumulate(np.where(np.concatenate([[True], stop[:-1]]), np.arange(n), 0))
                h = mix64((sums[:-1] - sums[start]) * down[start]) >> np.uint64(64 - bits)
            yield h.astype(np.int32)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Scaled log odds of a 1 at each tree node, from symbol counts of shape (slots, 32)."""
    out = np.zeros(counts.shape, dtype=np.int8)
    level = counts.astype(np.float64)
    for depth in range(4, -1, -1):
        zero, one = level[:, 0::2], level[:, 1::2]
        odds = np.log((one + 0.4) / (zero + 0.4)) * SCALE
        out[:, 1 << depth : 2 << depth] = np.clip(np.round(odds), -127, 127)
        level = zero + one
    return out


# ---- learning -------------------------------------------------------------------


class Counts:
    """How often each symbol followed in each slot of a context: 16 bits each, and what those do not hold apart."""

    #: steps in which counts move to ``more``; as many symbols at most are added before counts are looked at
    FULL = 1 << 15

    def __init__(self, bits: int):
        self.table, self.more = np.zeros(32 << bits, dtype=np.uint16), Counter()

    def add(self, cells: np.ndarray) -> None:
        for a in range(0, len(cells), self.FULL):
            some = cells[a : a + self.FULL]
            np.add.at(self.table, some, np.uint16(1))
            full = some[self.table.take(some) >= self.FULL]
            if len(full):
                full = np.unique(full)
                self.table[full] -= np.uint16(self.FULL)
                self.more.update(full.tolist())

    def parts(self) -> Iterator[np.ndarray]:
        """The counts of each block of slots."""
        each = 32 * min(BLOCK_SLOTS, len(self.table) // 32)
        apart = sorted(self.more)
        for a in range(0, len(self.table), each):
            part = self.table[a : a + each].astype(np.uint32)
            for cell in apart[bisect_left(apart, a) : bisect_left(apart, a + each)]:
                part[cell - a] += np.uint32(self.more[cell] * self.FULL)
            yield part


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, block, packed counts, word, n): what a task counted; words are sent whenever many are held."""
    from pyspark import TaskContext

    counts = [Counts(bits) for _, bits in CONTEXTS]
    task, vocabulary, waiting, size = TaskContext.get().partitionId(), Counter(), [], 0
    names = ["task", "block", "packed", "word", "n"]

    def count() -> None:
        flat, firsts, ends = joined_lines(waiting)
        real = np.ones(len(flat), dtype=bool)
        for i in range(1, PAD + 1):
            real[firsts - i] = False
        for own, slot in zip(counts, slots(flat)):
            own.add(((slot << 5) | flat)[real].astype(np.intp))

    def said() -> pa.RecordBatch:
        k = len(vocabulary)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([task] * k, pa.int32()),
                pa.nulls(k, pa.int32()),
                pa.nulls(k, pa.binary()),
                pa.array(list(vocabulary.keys()), pa.binary()),
                pa.array(list(vocabulary.values()), pa.int64()),
            ],
            names,
        )

    _CACHE.clear()  # a model that this worker read with earlier
    for batch in batches:
        for text in _each(batch):
            w = _tokens(text)
            vocabulary.update(w)
            vocabulary[END] += 1
            waiting.append(b" ".join(w))
            size += len(waiting[-1]) + 1
            if size > CHUNK:
                count()
                waiting, size = [], 0
        if len(vocabulary) > 500_000:
            yield said()
            vocabulary.clear()
    if waiting:
        count()
    if vocabulary:
        yield said()
    block = 0
    for own in counts:
        for part in own.parts():
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task], pa.int32()),
                        pa.array([block], pa.int32()),
                        pa.array([packed_counts(part)], pa.binary()),
                        pa.nulls(1, pa.binary()),
                        pa.nulls(1, pa.int64()),
                    ],
                    names,
                )
            block += 1


def blocks_of(bits: int) -> tuple[int, int]:
    """(blocks, slots in each) of a table."""
    each = min(BLOCK_SLOTS, 1 << bits)
    return (1 << bits) // each, each


def packed_counts(part: np.ndarray) -> bytes:
    """The counts of a block, byte by byte of significance, so that the many zeros and small ones pack well."""
    planes = part.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(planes[: max((i + 1 for i in range(4) if planes[i].any()), default=1)].tobytes(), 1)


def _summed(packs) -> np.ndarray:
    """The sum of packed counts, as one block of the largest size."""
    total = np.zeros(32 * BLOCK_SLOTS, dtype=np.uint64)
    for packed in packs:
        planes = np.frombuffer(zlib.decompress(packed), np.uint8)
        for i, plane in enumerate(planes.reshape(-1, len(total))):
            total += plane.astype(np.uint64) << np.uint64(8 * i)
    return total


def _partly(pdf: pd.DataFrame) -> pd.DataFrame:
    # counts beyond 32 bits no longer change a prediction
    total = np.minimum(_summed(pdf["packed"]), 0xFFFFFFFF).astype(np.uint32)
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "packed": [packed_counts(total)]})


def _wholly(pdf: pd.DataFrame) -> pd.DataFrame:
    odds = log_odds(_summed(pdf["packed"]).reshape(-1, 32))
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "packed": [zlib.compress(odds.tobytes(), 1)]})


class Model:
    """Tables of scaled log odds, one per context."""

    def __init__(self, packed: dict[int, bytes]):
        self.tables, block = [], 0
        for _, bits in CONTEXTS:
            count, each = blocks_of(bits)
            # a slot's row of 32 bytes never crosses a cache line
            space = np.zeros((32 << bits) + 64, dtype=np.int8)
            table = space[-space.ctypes.data % 64 :][: 32 << bits].reshape(count, 32 * each)
            for i in range(count):
                if block + i in packed:
                    table[i] = np.frombuffer(zlib.decompress(packed[block + i]), np.int8)[: 32 * each]
            self.tables.append(table.reshape(-1, 32))
            block += count

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural-log probability of each text's symbols."""
        out = np.zeros(len(texts))
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (size < CHUNK or upto == at):
                size += len(texts[upto])
                upto += 1
            out[at:upto] = self.read(*joined(texts[at:upto]))
            at = upto
        return out

    def read(self, flat: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural-log probability of each of the joined texts."""
        out = np.zeros(len(firsts))
        where = slots(flat)
        owner, start, end = [], [], []
        for i, (a, b) in enumerate(zip(firsts.tolist(), ends.tolist())):
            cuts = list(range(a, b, WINDOW))
            owner += [i] * len(cuts)
            start += cuts
            end += [*cuts[1:], b]
        owner, start, end = np.array(owner), np.array(start), np.array(end)
        order = np.argsort(start - end, kind="stable")  # the longest first
        for k in range(0, len(order), LANES):
            lanes = order[k : k + LANES]
            np.add.at(out, owner[lanes], self._read(flat, where, start[lanes], end[lanes]))
        return out

    def _read(self, flat: np.ndarray, where: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log probability of each window, all read side by side; windows come longest first."""
        lanes, c, gates = len(start), len(CONTEXTS), len(FIRST_WEIGHTS)
        # predictions stay in units of 1 / SCALE, which weights and their rate make up for
        weights = np.repeat(FIRST_WEIGHTS[None] / np.float32(SCALE), lanes, axis=0)
        rate = np.float32(WEIGHT_RATE) / np.float32(SCALE * SCALE)
        refine = np.repeat(np.linspace(-8, 8, 33, dtype=np.float32)[None], lanes, axis=0)
        total = np.zeros(lanes)
        length = end - start
        ahead = np.arange(STEP)
        one, half = np.float32(1), np.float32(0.5)
        n = -1
        for t in range(0, int(length[0]), STEP):
            left = int(np.searchsorted(-length, -t, side="left"))  # windows that still have symbols
            if left != n:
                n = left
                x, gain = np.empty((c, 5, n, STEP), dtype=np.float32), np.empty((c, n, STEP), dtype=np.float32)
                z, seen, part, wrong = (np.empty((5, n, STEP), dtype=np.float32) for _ in range(4))
                node, cell = (np.empty((5, n, STEP), dtype=np.int64) for _ in range(2))
                odds, fetched = np.empty((5, n, STEP), dtype=np.int8), np.empty((n, STEP, 32), dtype=np.int8)
                rows = np.arange(0, n * STEP * 32, 32).reshape(n, STEP)
                gate, row = np.arange(0, n * gates, gates)[:, None], np.arange(0, n * 33, 33)[:, None]
            at = start[:n, None] + (t + ahead)[None]
            mask = at < end[:n, None]
            np.minimum(at, len(flat) - 1, out=at)
            symbol = flat.take(at)
            np.add((symbol | 32) >> _UP, rows, out=node)
            # half a 1, the sign that of the bit not taken
            np.subtract(half, (symbol >> _DOWN) & 1, out=wrong)
            met = []
            for i in range(c):
                # the slots' rows first: each is fetched once, not once for every node
                self.tables[i].take(where[i].take(at), axis=0, out=fetched, mode="clip")
                fetched.take(node, out=odds, mode="clip")
                x[i] = odds
                met.append((odds[0] != 0).view(np.uint8))
            known = met[LONG] + 2 * met[WORD]
            own = known + gate
            w = weights[:n].reshape(n * gates, c).T
            np.multiply(x[0], w[0].take(own), out=z)
            for i in range(1, c):
                z += np.multiply(x[i], w[i].take(own), out=part)
            np.clip(z, -8, 8, out=z)
            np.add(z, np.float32(8), out=part)
            part *= np.float32(2)
            np.add(np.rint(part, out=part).astype(np.int64), row, out=cell)
            # a step's symbols see weights and table as they were before the step
            refine[:n].reshape(-1).take(cell, out=seen, mode="clip")
            z += seen
            z *= wrong
            against = np.exp(z, out=z)  # odds of the wrong bit
            np.add(against, one, out=part)
            total[:n] -= (np.log(part, out=seen).sum(axis=0) * mask).sum(axis=1, dtype=np.float64)
            against /= part
            wrong *= np.float32(-2)
            against *= wrong
            error = np.multiply(against, mask, out=against)
            for i in range(c):
                np.multiply(error, x[i], out=part).sum(axis=0, out=gain[i])
            chosen = (known[:, None, :] == _GATES[None, :, None]).astype(np.float32)
            weights[:n] += rate * (chosen @ gain.transpose(1, 2, 0))
            moved = np.bincount(cell.ravel(), error.ravel(), minlength=n * 33)
            refine[:n] += (TABLE_RATE * moved).reshape(n, 33).astype(np.float32)
        return total


# ---- scoring --------------------------------------------------------------------


def held_out() -> Column:
    """crc32 of the id as text, modulo 7, is 2; rows without an id are learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def _apply(model, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, known = _loaded(model, frequent)
        names = ["doc_id", "n_words", "n_frequent", "frequent_log", "rare", "bytes", "score"]

        def scored(ids: pa.Array, rows: list[tuple], lines: list[bytes]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.float64(), pa.map_(pa.binary(), pa.int64()), pa.int64()]
            columns = list(zip(*rows)) or [()] * 5
            scores = pa.array(lm.read(*joined_lines(lines)) / math.log(10) if lines else [], pa.float64())
            return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, types)], scores], names)

        for batch in batches:
            ids, rows, lines, at, size = batch.column("doc_id"), [], [], 0, 0
            for text in _each(batch):
                w = _tokens(text)
                lines.append(b" ".join(w))
                logs = list(map(known.get, w))
                rare = [t for t, log in zip(w, logs) if log is None]
                found, total = len(w) - len(rare), math.fsum(filter(None, logs))
                rows.append((len(w), found, total, list(Counter(rare).items()), len(lines[-1]) + 1))
                size += len(lines[-1]) + 1
                if size >= CHUNK:
                    yield scored(ids.slice(at, len(rows)), rows, lines)
                    at, rows, lines, size = at + len(rows), [], [], 0
            yield scored(ids.slice(at), rows, lines)

    return run


_CACHE: dict[int, tuple] = {}


def _loaded(model, frequent) -> tuple[Model, dict[bytes, float]]:
    key = model.value["digest"]
    if key not in _CACHE:
        _CACHE.clear()
        names, logs = frequent.value
        _CACHE[key] = (Model(model.value["blocks"]), dict(zip(names.split(), logs.tolist())))
    return _CACHE[key]


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The (word, c) that every task knows: the ``most`` most frequent words that are not long."""
    short = (F.col("word") != F.lit(END)) & (F.octet_length("word") <= FREQUENT_BYTES)
    return counts.where(short).orderBy(F.desc("c"), "word").limit(most)


@contextmanager
def _small_batches(spark) -> Iterator[None]:
    """What runs inside sends texts to Python in batches of BATCH rows at most: thousands of long ones fill an executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, before if 0 < int(before) < BATCH else str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score_documents(docs: DataFrame, learn_from: DataFrame, frequent_words: int = FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per row of ``docs``.

    Learns from the texts of all rows of ``learn_from``. Tokens are the words and
    one end. ``base_score`` is the add-one unigram score, exact for every word:
    the ``frequent_words`` most frequent that are not long are known to every task,
    tokens that are not among them are joined with the counts. Null and empty texts are an end
    only; repeated rows are scored one by one and count each in learning. Without
    rows to learn from all counts are 0 and the tables say nothing. The tables
    have a fixed size, whatever the corpus.
    """
    spark = docs.sparkSession
    # a task's tables have one size whatever it reads, so a few splits are counted together
    splits = learn_from.rdd.getNumPartitions()
    together = learn_from.select("text").coalesce(max(spark.sparkContext.defaultParallelism, splits // SPLITS_PER_TASK, 1))
    with _small_batches(spark):
        gathered = stored(
            together.mapInArrow(_gather, "task int, block int, packed binary, word binary, n long"), "counts"
        )
    counts = stored(
        gathered.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "vocabulary"
    )
    v, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    packs = gathered.where("block is not null")
    tasks = packs.agg(F.max("task")).first()[0] or 0
    if tasks >= TOGETHER:
        # two levels, so that a group holds about the square root of the tasks' packs
        salt = (F.col("task") % (math.isqrt(tasks) + 1)).alias("salt")
        packs = packs.groupBy("block", salt).applyInPandas(_partly, "block int, packed binary")
    whole = packs.select("block", "packed").groupBy("block").applyInPandas(_wholly, "block int, packed binary").toArrow()
    blocks = dict(zip(whole["block"].to_pylist(), whole["packed"].to_pylist()))
    digest = zlib.crc32(b"".join(blocks[k] for k in sorted(blocks)))
    top = most_frequent(counts, frequent_words).toArrow()
    model = spark.sparkContext.broadcast({"digest": (digest, v, total), "blocks": blocks})
    # the words in one string, as none holds white space
    frequent = spark.sparkContext.broadcast(
        (b" ".join(top["word"].to_pylist()), np.log10(top["c"].to_numpy().astype(float) + 1))
    )
    id_type = dict(docs.dtypes)["doc_id"]
    read = docs.select("doc_id", "text").mapInArrow(
        _apply(model, frequent),
        f"doc_id {id_type}, n_words long, n_frequent long, frequent_log double, rare map<binary,long>, bytes long, score double",
    )
    with _small_batches(spark):
        rows = numbered(read, ["doc_id"], **{c: F.col(c) for c in read.columns[1:]})
    rare = rows.select("row_id", F.explode("rare").alias("word", "tf"))
    known = (
        rare.join(counts, "word")
        .groupBy("row_id")
        .agg(F.sum("tf").alias("n_rare"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("rare_log"))
    )
    # the end is a token too, with a count of its own
    ends = counts.where(F.col("word") == F.lit(END)).select("c").first()
    end_count = ends[0] if ends else 0
    n_tokens = F.col("n_words") + 1
    return rows.join(known, "row_id", "left").select(
        "doc.doc_id",
        n_tokens.alias("n_tokens"),
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0)) + int(end_count > 0)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (
            F.col("frequent_log")
            + F.coalesce("rare_log", F.lit(0.0))
            + math.log10(end_count + 1)
            - n_tokens * math.log10(total + v + 1)
        ).alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / F.col("bytes")).alias("bits_per_byte"),
    )


def op6_lm_score(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score_documents(docs, docs.where(~held_out()))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )
