from collections import Counter

import corpus_pipeline as cp
from tripflow.llm import near_dedup as nd
from tripflow.llm.decontamination import contamination

from .conftest import SF


def write(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_stages_take_effect(spark, small, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, small["labels"].set_index("doc_id").quality
    seen = [docs]
    for name, stage in cp.STAGES:
        seen.append(write(stage(spark, seen[-1], SF), tmp_path / name.replace(" ", "_")))
    raw, good, single, clean, mixed, sharded = seen
    ids = [[r["doc_id"] for r in d.select("doc_id").collect()] for d in seen]
    assert all(d.columns == columns for d in seen[:-1])
    # quality: labelled documents go as they are labelled
    kept = set(ids[1])
    assert sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.97 * len(labels)
    # near duplicates: what stays is not similar to one another, and each that went is like one that stayed
    shingles = {r["doc_id"]: nd.shingles(nd.word_hashes(r["text"])) for r in good.collect()}
    stayed = set(ids[2])
    gone = [i for i in ids[1] if i not in stayed]
    assert gone and len(ids[2]) == len(stayed)
    for i in gone:
        assert any(nd.similar(shingles[i], shingles[j]) for j in ids[1] if j != i)
    for i in stayed:
        assert not any(nd.similar(shingles[i], shingles[j]) for j in stayed if j > i)
    # decontamination
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert contamination(clean, benchmark).where("size(spans) > 0").count() == 0
    hit = {r["doc_id"] for r in contamination(single, benchmark).where("size(spans) > 0").select("doc.doc_id").collect()}
    assert set(ids[2]) - set(ids[3]) == hit
    # mixing: rows as they were, three times at most
    assert set(ids[4]) <= set(ids[3]) and max(Counter(ids[4]).values()) <= 3
    # sharding: all rows, each in a place of its own
    assert sorted(ids[5]) == sorted(ids[4])
    places = [(r["shard"], r["slot"]) for r in sharded.collect()]
    assert len(set(places)) == len(places)
    sizes = Counter(s for s, _ in places)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(cp.SHARDS)) <= 1


def test_run_returns_the_last_stage(spark):
    got = cp.run(spark, SF)
    assert got.columns[-2:] == ["shard", "slot"] and got.count() > 0


def test_stages_survive_odd_and_empty_tables(spark, odd, none, tmp_path):
    for name, start in (("odd", odd), ("none", none)):
        docs = start
        for k, (_, stage) in enumerate(cp.STAGES):
            docs = write(stage(spark, docs, SF), tmp_path / f"{name}{k}")
        assert docs.select("doc_id", "text", "shard", "slot").count() <= 3 * start.count()
