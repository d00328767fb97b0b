import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tripflow.llm import lm_score as lm

from .conftest import ODD_ROWS, SF


def base_scores(docs, train):
    """doc -> (tokens, known tokens, add-one unigram score), and the training tokens."""
    counts = Counter()
    for text in train:
        counts.update(lm.tokens(text))
        counts[lm.END] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for text in docs:
        t = [*lm.tokens(text), lm.END]
        out.append((len(t), sum(counts[w] > 0 for w in t), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)))
    return out, n


@pytest.mark.parametrize("text", ["", "a b", "Ä 12 <x>\n\ty", "ABC. abc,"])
def test_symbols_can_be_read_back(text):
    words = lm.tokens(text)
    out, s = bytearray(), lm.symbols(words).tolist()
    while s:
        x = s.pop(0)
        out.append(s.pop(0) << 4 | s.pop(0) if x == lm.ESCAPE else lm.COMMON[x])
    assert bytes(out) == b" ".join(words) + lm.END


def test_log_odds_are_the_trees():
    counts = np.zeros((1, 32))
    counts[0, 5], counts[0, 6], counts[0, 20] = 10, 30, 60
    odds = lm.log_odds(counts)[0] / lm.SCALE
    assert odds[1] == pytest.approx(math.log(60.4 / 40.4), abs=0.04)  # 16 to 31 against 0 to 15
    assert odds[lm._NODES[4, 6]] == pytest.approx(math.log(0.4 / 30.4), abs=0.04)  # 7 against 6


def model_of(texts):
    packed, block = {}, 0
    flat, firsts, ends = lm.joined([lm.symbols(lm.tokens(t)) for t in texts])
    real = np.ones(len(flat), dtype=bool)
    for i in range(1, lm.PAD + 1):
        real[firsts - i] = False
    for (_, bits), slot in zip(lm.CONTEXTS, lm.slots(flat)):
        table = np.zeros(32 << bits, np.uint32)
        np.add.at(table, (slot * 32 + flat)[real], np.uint32(1))
        n, each = lm.blocks_of(bits)
        for i, part in enumerate(table.reshape(n, -1)):
            if part.any():
                odds = np.zeros((lm.BLOCK_SLOTS, 32), np.int8)
                odds[:each] = lm.log_odds(part.reshape(-1, 32))
                packed[block + i] = zlib.compress(odds.tobytes())
        block += n
    return lm.Model(packed)


def test_slots_do_not_depend_on_blocks(monkeypatch):
    lines = [b"the cat", b"", b"x" * 3000, "Ä 12 mats ate the ünlikely dog ".encode() * 40 + b"end"]
    flat, firsts, ends = lm.joined_lines(lines)
    whole = lm.slots(flat)
    read = []
    alone = lm._slots
    monkeypatch.setattr(lm, "_slots", lambda part: read.append(len(part)) or alone(part))
    monkeypatch.setattr(lm, "BLOCK", 64)
    assert all((a == b).all() for a, b in zip(whole, lm.slots(flat)))
    # a word of many blocks is not read anew for each of them
    assert len(read) > 5 and sum(read) < 4 * len(flat)
    apart = lm.joined([lm.symbols(line.split(b" ") if line else []) for line in lines])
    assert all((a == b).all() for a, b in zip((flat, firsts, ends), apart))


def test_counts_of_16_bits_lose_nothing(monkeypatch):
    cells = np.concatenate([np.full(200_000, 7), np.arange(1 << 20), np.full(70_000, (1 << 20) - 1)])
    counts = lm.Counts(15)
    counts.add(cells)
    counts.add(cells[:100])
    want = np.bincount(np.concatenate([cells, cells[:100]]))
    assert (np.concatenate(list(counts.parts())) == want).all()
    # a worker's tables
    assert counts.table.nbytes == 2 * len(want)


def test_a_worker_holds_few_texts(monkeypatch):
    held = []

    class Known(dict):
        def get(self, word, other=None):
            return None

    class Reader:
        def read(self, flat, firsts, ends):
            held.append(len(flat))
            return np.zeros(len(firsts))

    monkeypatch.setattr(lm, "_loaded", lambda model, frequent: (Reader(), Known()))
    monkeypatch.setattr(lm, "CHUNK", 1000)
    texts = ["some words here " * 10, None, "", "a"] * 100
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], ["doc_id", "text"])
    got = pa.Table.from_batches(lm._apply(None, None)([batch, batch.slice(0, 0)]))
    assert got["doc_id"].to_pylist() == list(range(400))
    assert got["n_words"].to_pylist() == [len(lm.tokens(t)) for t in texts]
    assert len(held) > 10 and max(held) < 1500


def test_texts_come_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with lm._small_batches(spark):
        sizes = spark.range(5000).coalesce(1).mapInArrow(
            lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long"
        ).collect()
    assert max(r["n"] for r in sizes) <= lm.BATCH and sum(r["n"] for r in sizes) == 5000
    assert spark.conf.get(name) == before


def test_scores_do_not_depend_on_neighbours():
    model = model_of(["the cat sat on the mat"] * 3)
    texts = [lm.symbols(lm.tokens(t)) for t in ("the cat", "", "a dog ate the mat " * 700, "the mat", "the cat")]
    alone = [model.score([t])[0] for t in texts]
    assert model.score(texts) == pytest.approx(alone, rel=1e-5)
    assert alone[0] == alone[4] and all(a < 0 for a in alone)


def test_a_step_is_a_probability():
    model = model_of(["abab abba baab"] * 5)
    head = lm.symbols(lm.tokens("ab"))[:-1]
    # the first symbols share the same state, so the last one's chances sum to one
    total = sum(math.exp(model.score([np.append(head, np.uint8(s))])[0]) for s in range(32))
    assert total == pytest.approx(math.exp(model.score([head])[0]), rel=1e-3)


def test_matches_brute_force(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    train = [t for i, t in rows.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    want, n = base_scores(rows.values(), train)
    want = dict(zip(rows, want))
    # a few frequent words only, so that the join has work
    got = lm.score_documents(docs, docs.where(~lm.held_out()), frequent_words=50).toPandas().set_index("doc_id")
    assert len(got) == len(rows) and set(got.train_tokens) == {n}
    for i, (tokens, known, base) in want.items():
        assert (got.n_tokens[i], got.n_known[i]) == (tokens, known)
        assert got.base_score[i] == pytest.approx(base, abs=1e-6)
    held = got[[zlib.crc32(str(i).encode()) % 7 == 2 for i in got.index]]
    # with a thousand documents to learn from it is about as good as the base
    assert held.score.sum() > 1.02 * held.base_score.sum()
    assert held.bits_per_byte.mean() < 2.3
    by_model = model_of(train).score([lm.symbols(lm.tokens(rows[i])) for i in held.index[:20]]) / math.log(10)
    assert held.score[:20].tolist() == pytest.approx(by_model.tolist(), rel=1e-4)


def test_beats_the_base_on_held_out_documents():
    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in docs.doc_id]
    train, rest = docs.text[[not h for h in held]].tolist(), docs.text[held].tolist()[:300]
    base = sum(b for _, _, b in base_scores(rest, train)[0])
    score = model_of(train).score([lm.symbols(lm.tokens(t)) for t in rest]).sum() / math.log(10)
    assert score > 0.98 * base


def test_beats_the_base_from_a_thousand_documents():
    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in docs.doc_id]
    train, rest = docs.text[[not h for h in held]].tolist(), docs.text[held].tolist()
    base = sum(b for _, _, b in base_scores(rest, train)[0])
    assert model_of(train).score([lm.symbols(lm.tokens(t)) for t in rest]).sum() / math.log(10) > base


def test_long_words_are_joined_not_sent(spark):
    rows = [(b"x" * 200_000, 9), (b"y" * 65, 9), (b"z" * 64, 8), (b"a", 7), (b"b", 1), (lm.END, 20)]
    top = lm.most_frequent(spark.createDataFrame(rows, "word binary, c long"), 2).collect()
    assert [bytes(r["word"]) for r in top] == [b"z" * 64, b"a"]


def test_odd_rows(odd, none):
    got = lm.score_documents(odd, odd).collect()
    assert len(got) == len(ODD_ROWS) and all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    want, n = base_scores([t for _, t, _, _ in ODD_ROWS], [t for _, t, _, _ in ODD_ROWS])
    assert sorted((r["n_tokens"], r["n_known"]) for r in got) == sorted(w[:2] for w in want)
    assert sorted(r["base_score"] for r in got) == pytest.approx(sorted(w[2] for w in want), rel=1e-9)
    fresh = lm.score_documents(odd, none).collect()
    assert len(fresh) == len(ODD_ROWS) and {r["n_known"] for r in fresh} == {0}
    assert lm.score_documents(none, odd).count() == 0


def test_counts_of_many_tasks_are_summed_in_two_levels(odd, monkeypatch):
    learn = odd.repartition(7)
    plain = sorted(tuple(r) for r in lm.score_documents(odd.where("doc_id > 0"), learn).collect())
    monkeypatch.setattr(lm, "TOGETHER", 0)
    monkeypatch.setattr(lm, "SPLITS_PER_TASK", 1)
    got = sorted(tuple(r) for r in lm.score_documents(odd.where("doc_id > 0"), learn).collect())
    assert np.array(got) == pytest.approx(np.array(plain))


def test_query_has_a_row_for_each_document(spark, small):
    got = lm.op6_lm_score(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(small["documents"].doc_id)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in got)
