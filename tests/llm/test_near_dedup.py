import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tripflow.llm import near_dedup as nd

from .conftest import ODD_ROWS, SF


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(60))
def test_alignment_is_exact(seed):
    rng = random.Random(seed)
    a = [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
    b = [x for x in a if rng.random() > 0.2] if seed % 2 else [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
    for _ in range(rng.randrange(4)):
        b.insert(rng.randrange(len(b) + 1), rng.randrange(6))
    want = len(a) + len(b) - 2 * lcs(a, b)
    x, y = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
    assert nd.aligned(x, y, 1000) == want
    assert nd.aligned(x, y, want) == want
    assert want == 0 or nd.aligned(x, y, want - 1) is None


@pytest.mark.parametrize("seed", range(20))
def test_similarity_is_the_aligned_share(seed):
    rng = random.Random(seed)
    a = [rng.randrange(10**6) for _ in range(200)]
    b = [x for x in a if rng.random() > seed / 100]
    m = lcs(a, b)
    want = m / (len(a) + len(b) - m) >= 0.8
    assert nd.similar(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) == want


def test_word_hashes_follow_words():
    a, b = nd.word_hashes("One two, ÜBER one"), nd.word_hashes(" one/TWO\nÜBER  ONE.")
    assert len(a) == 4 and (a == b).all() and a[0] == a[3] and len(set(a.tolist())) == 3
    assert len(nd.word_hashes(None)) == len(nd.word_hashes("")) == len(nd.word_hashes("..!")) == 0


def test_labels_tell_repeats_apart():
    s = np.array([5, 7, 5, 5, 7], dtype=np.uint64)
    assert len(set(nd.labelled(s).tolist())) == 5 and nd.labelled(s)[0] == 5


def test_sketches_know_order():
    def keys(words):
        return nd.band_keys(nd.word_hashes(" ".join(words)))

    docs = [[f"d{k}w{i}" for i in range(400)] for k in range(40)]
    assert all((keys(w) == keys(w)).all() for w in docs)
    # halves swapped: nearly all shingles stay, but two picks keep their order only within a half
    swapped = np.mean([(keys(w) == keys(w[200:] + w[:200])).mean() for w in docs])
    assert abs(swapped - 0.25) < 0.08
    edited = np.mean([(keys(w) == keys([*w[:100], "new", *w[101:]])).mean() for w in docs])
    assert edited > 0.8


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(100, 140)] + [tuple(sorted(rng.sample(range(60), 2))) for _ in range(40)]
    want = components({n for e in links for n in e}, links)
    got = nd.components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == want


def brute_classes(docs):
    """doc_id -> (class, links to other texts), by comparing all pairs that share a shingle."""
    shingles = {i: nd.shingles(nd.word_hashes(t)) for i, t in docs}
    by_words = {}
    for i, _ in docs:
        by_words.setdefault(shingles[i].tobytes(), []).append(i)
    heads = [min(v) for v in by_words.values()]
    where = {}
    for h in heads:
        for s in set(shingles[h].tolist()):
            where.setdefault(s, []).append(h)
    shared = Counter(p for hs in where.values() for p in combinations(sorted(hs), 2))
    links = [(a, b) for (a, b), n in shared.items() if 3 * n > len(shingles[a]) and nd.similar(shingles[a], shingles[b])]
    same = [(min(v), x) for v in by_words.values() for x in v]
    return components([i for i, _ in docs], links + same), links


def test_query_matches_brute_force(spark, small):
    docs = list(zip(small["documents"].doc_id, small["documents"].text))
    want, links = brute_classes(docs)
    got = nd.op10_near_dedup(spark, SF).toPandas().set_index("doc_id")
    assert got.class_id.to_dict() == want
    assert got[got.kept].index.tolist() == got[got.kept].class_id.tolist() and got.kept.sum() == len(set(want.values()))


def test_near_copies_meet_in_groups_of_any_size(spark, docs_like):
    rng = random.Random(1)
    base = [f"word{rng.randrange(3000)}" for _ in range(300)]
    rows = []
    for i in range(300):
        text = base.copy()
        for _ in range(rng.randrange(3)):
            text[rng.randrange(300)] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(text), "en", "src0"))
    rows += [(1000 + i, " ".join(base[:80] + [f"own{rng.randrange(10**6)}" for _ in range(200)]), "en", "src0") for i in range(100)]
    kept = {r["doc_id"] for r in nd.deduplicate(docs_like(rows)).collect()}
    assert kept == {0, *range(1000, 1100)}


def test_copies_that_are_like_their_base_only(spark, docs_like):
    rng = random.Random(2)
    base = [f"word{i}" for i in range(1000)]
    rows = [(1000, " ".join(base), "en", "src0")]
    for i in range(1000):
        text = base.copy()
        for at in rng.sample(range(200), 19):
            text[5 * at + 2] = f"edit{i}at{at}"
        rows.append((i, " ".join(text), "en", "src0"))
    shingles = [nd.shingles(nd.word_hashes(r[1])) for r in rows[:40]]
    assert all(nd.similar(shingles[0], s) for s in shingles) and not any(nd.similar(*p) for p in combinations(shingles[1:], 2))
    table = nd.numbered(docs_like(rows), ["doc_id"], text=nd.F.col("text"))
    found = table.join(nd.classes(table), "row_id").select("doc.doc_id", "n_links", "class_row").toPandas()
    assert found.class_row.nunique() == 1
    links = found.set_index("doc_id").n_links
    assert links[1000] == 1000 and (links.drop(1000) == 1).all()


def test_links_within_a_small_bucket_are_all_found(spark):
    # rows 0 to 7 share one bucket and each is like the next one only
    shared = spark.createDataFrame([(7, 7, i, 8, 8) for i in range(8)], "bucket long, finer long, row_id long, n long, met long")
    links = nd.first_pairs(shared).where("b = a + 1")
    assert links.count() == 7 and {r["root"] for r in nd.components(links).collect()} == {0}


def in_one_bucket(spark, monkeypatch, docs_like, docs):
    """The classes of texts that all share one bucket, which no finer bucket cuts."""

    def one_bucket(heads):
        n = heads.count()
        return heads.select(nd.F.lit(7).cast("long").alias("bucket"), nd.F.lit(7).cast("long").alias("finer"), "row_id", nd.F.lit(n).cast("long").alias("n"), nd.F.lit(n).cast("long").alias("met"))

    monkeypatch.setattr(nd, "shared_buckets", one_bucket)
    table = nd.numbered(docs_like([(i, t, "en", "src0") for i, t in docs]), ["doc_id"], text=nd.F.col("text"))
    found = table.join(nd.classes(table), "row_id").select("doc.doc_id", "class_row").toPandas().set_index("doc_id").class_row
    first = {}
    return {i: first.setdefault(found[i], i) for i in sorted(found.index)}


def test_links_between_members_of_a_crowded_bucket_that_lead_nothing(spark, monkeypatch, docs_like):
    rng = random.Random(5)
    docs = []
    for k in range(30):
        text = [f"own{k}w{rng.randrange(200)}" for _ in range(100)]
        docs += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text[:50], "edit", *text[51:]]))]
    assert in_one_bucket(spark, monkeypatch, docs_like, docs) == {i: i - i % 2 for i, _ in docs}


@pytest.mark.parametrize("seed", range(2))
def test_classes_of_a_crowded_bucket_are_exact(spark, monkeypatch, docs_like, seed):
    rng = random.Random(seed)
    docs, common = [], [f"common{i}" for i in range(30)]
    for i in range(120):
        if i % 6 == 0:
            base = common + [f"w{rng.randrange(40)}" for _ in range(rng.randrange(10, 120))]
        text = [f"e{rng.randrange(9)}" if rng.random() < 0.02 else w for w in base[: len(base) - rng.randrange(8)]]
        docs.append((i, " ".join(text)))
    want, _ = brute_classes(docs)
    assert 20 < len(set(want.values())) < 110
    assert in_one_bucket(spark, monkeypatch, docs_like, docs) == want


@pytest.mark.parametrize("n", [200, 400])
def test_pairs_grow_with_members(spark, docs_like, n):
    rng = random.Random(4)
    base = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = base.copy()
        for at in rng.sample(range(300), 12):
            text[at] = f"own{i}at{at}"
        rows.append((i, " ".join(text), "en", "src0"))
    bands = [(i, [int(k) for k in nd.band_keys(nd.word_hashes(t))]) for i, t, _, _ in rows]
    shared = nd.stored(nd.shared_buckets(spark.createDataFrame(bands, "row_id long, bands array<long>")), "shared")
    none = spark.createDataFrame([], "node long, root long")
    # as if no pair were a link
    pairs = nd.first_pairs(shared).count() + nd.further_pairs(shared, none).count()
    assert pairs <= 16 * n * (nd.SMALL // 2 + 2 * nd.LEADERS) and pairs < n * 80


def test_recall_of_similar_pairs(spark, small):
    docs = [(i, t) for i, t in zip(small["documents"].doc_id, small["documents"].text)]
    shingles = {i: nd.shingles(nd.word_hashes(t)) for i, t in docs}
    got = nd.op10_near_dedup(spark, SF).toPandas().set_index("doc_id").class_id
    pairs = [(a, b) for a, _ in docs if a % 20 == 0 for b, _ in docs if a != b and len(shingles[a]) and nd.similar(shingles[a], shingles[b])]
    assert pairs and all(got[a] == got[b] for a, b in pairs)


def test_odd_rows(odd, none, docs_like):
    kept = nd.deduplicate(odd)
    assert kept.columns == odd.columns
    texts = Counter(r["text"] for r in kept.collect())
    # texts without words are told apart by their characters, null is empty; repeated rows are one group
    assert len(texts) == len({t or "" for _, t, _, _ in ODD_ROWS}) and set(texts.values()) == {1}
    assert {t for t in texts if not len(nd.word_hashes(t))} in ({"", " \t\n ", "!!! $$$ ### %%% &&& !!!"}, {None, " \t\n ", "!!! $$$ ### %%% &&& !!!"})
    symbols = [(i, t, "en", "s") for i, t in enumerate(["+ - * /", "....", "!!! ???", "....", " ....", None, ""])]
    assert {r["doc_id"] for r in nd.deduplicate(docs_like(symbols)).collect()} == {0, 1, 2, 4, 5}
    assert nd.deduplicate(none).count() == 0
