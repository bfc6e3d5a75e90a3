import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from toroid.llm import near_copies
from toroid.llm.near_copies import connect, drop_near_copies, jaccard, minima, near_links, printed_pairs, shingle_set
from toroid.llm.simhash import fingerprint


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def changed(rng, words, n):
    own = list(words)
    for at in rng.sample(range(len(own)), n):
        own[at] = f"new{rng.randrange(10**6)}"
    return own


def families(seed=1):
    rng, texts = random.Random(seed), []
    for size in (100, 300, 1000) * 5:
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts.append(" ".join(base))
        for share in (0.002, 0.008, 0.013, 0.018, 0.021, 0.03):
            texts.append(" ".join(changed(rng, base, max(1, round(share * size)))))
    return texts


def groups(texts):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_sets_and_estimates_follow_the_similarity():
    texts = families()[:14]
    for a in texts:
        for b in texts:
            x, y = shingle_set(a.encode()), shingle_set(b.encode())
            assert jaccard(x, y) == pytest.approx(similar(a, b))
            assert abs((minima(x) == minima(y)).mean() - similar(a, b)) < 0.2
    assert len(shingle_set(None)) == len(shingle_set(b" \n")) == len(shingle_set(b"One two")) == 1


def test_cells_connect_what_links_connect():
    texts = families(2)[:21]
    sets = [shingle_set(t.encode()) for t in texts]
    edges = connect(sets, [str(i) for i in range(21)], [True] * 21, 0.8)
    assert all(similar(texts[i], texts[j]) >= 0.8 for i, j in edges) and len(edges) == 21 - len(set(groups(texts)))
    assert connect(sets, ["a"] * 21, [True] * 21, 0.8) == [] and connect(sets, [str(i) for i in range(21)], [False] * 21, 0.8) == []
    assert all(i == 0 for i, _ in connect(sets, [str(i) for i in range(21)], [True] + [False] * 20, 0.8))


def test_large_groups_of_near_copies(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = [" ".join(changed(rng, base, rng.choice([1, 2, 3, 9]))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_copies(df, block=16).collect()) == sorted(set(groups(texts)))


def test_stage_drops_copies_of_similarity_0_8_and_no_others(spark):
    texts = families()
    want = groups(texts)
    assert len(set(want)) < len(texts) - 50  # most copies are similar enough, some are not
    assert len(set(want)) > 15
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_copies(df, block=3).collect()) == sorted(set(want))
    assert all(similar(texts[a], texts[b]) >= 0.8 for a, b in pairs_of(df, texts))
    assert sorted(r.doc_id for r in corpus_pipeline.no_near_copies(spark, df, "").collect()) == sorted(set(want))


def pairs_of(df, texts):
    at = {r.node: r.doc_id for r in df.select(F.md5("text").alias("node"), "doc_id").collect()}
    return [(at[r.u], at[r.v]) for r in near_links(df).collect()]


def test_rows_of_a_repeated_or_null_id_are_decided_apart(spark, tmp_path):
    a, b, c, d = ([f"{k}{i}" for i in range(60)] for k in "abcd")
    near = lambda x: " ".join([*x[:59], "changed"])
    a, b, c, d = map(" ".join, (a, b, c, d))
    rows = [(1, a), (2, near(a.split())), (2, b), (None, c), (None, near(c.split())), (3, d), (3, near(d.split())), (4, b + " more"), (5, "x y"), (5, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.no_near_copies(spark, docs, "").collect()
    left = {(r.doc_id, r.text[:2]) for r in out}
    assert left == {(1, "a0"), (2, "b0"), (None, "c0"), (3, "d0"), (5, "x ")} and len(out) == 5
    spark.createDataFrame([(1, b[:100])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = corpus_pipeline.no_benchmark(spark, docs, str(tmp_path))
    assert clean.columns == ["doc_id", "text"]
    assert sorted(r.text for r in clean.collect()) == sorted(t for _, t in rows if not t.startswith("b0"))


def test_simhash_links_are_proposed_and_confirmed(spark, monkeypatch):
    texts = families(3)[:42]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = df.select(F.md5("text").alias("node"), "text", "doc_id")
    at = {r.node: r.doc_id for r in nodes.collect()}
    prints = [fingerprint(t.encode()) for t in texts]
    got = [(at[r.u], at[r.v]) for r in printed_pairs(nodes.select("node", "text")).collect()]
    near = {i for i, x in enumerate(prints) for j, y in enumerate(prints) if i != j and (x ^ y).bit_count() <= 3}
    assert near and near == {x for pair in got for x in pair}
    # without any band the stage still drops what SimHash links and whole sets confirm
    monkeypatch.setattr(near_copies, "_sketches", lambda shingle: lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array([[]] * b.num_rows, pa.list_(pa.int64()))], ["node", "keys"]) for b in batches))
    left = drop_near_copies(df).count()
    assert len(set(groups(texts))) <= left < len(texts)
