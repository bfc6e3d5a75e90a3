import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from toroid.llm.components import components
from toroid.llm.decontaminate import MASKS, MIDDLE_MASKS, SHORT_MASKS, best_overlap, candidate_pairs, dealt_seeds, find_overlaps, token_hashes
from toroid.llm.simhash import _chain, fingerprint, links, near_duplicates


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(items, near):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def test_fingerprint_is_the_contracts():
    rng = random.Random(1)
    for text in [None, "", " \t\n", "One", "One two", "A b\x0bc\x0cd", "Ünï ö É", *[" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 700))) for _ in range(30)]]:
        assert fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    got = spark.sql("select xxhash64('a b c') as h").first().h & (1 << 64) - 1
    assert got == xxhash.xxh64_intdigest(b"a b c", 42)


def test_chain_loses_no_pair():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in a], np.uint64)
    assert np.logical_or.reduce([_chain(flips, t, 3) for t in range(4)]).all()
    far = np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in a], np.uint64)
    assert not np.logical_or.reduce([_chain(far, t, 3) for t in range(4)]).any()


def cluster_prints(n=300):
    rng = random.Random(5)
    out = []
    for _ in range(n // 30):
        at = rng.getrandbits(64)
        for _ in range(30):
            for _ in range(rng.randint(0, 2)):
                at ^= 1 << rng.randrange(64)
            out.append(at)
    return sorted(set(out))


def test_links_connect_as_all_pairs(spark):
    prints = cluster_prints()
    want = slow_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    for block in (2, 1024):
        edges = links(df, block=block).collect()
        got = slow_components(range(len(prints)), lambda a, b: False)
        at = {int(np.uint64(p).view(np.int64)): i for i, p in enumerate(prints)}
        parent = list(range(len(prints)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for e in edges:
            assert (prints[at[e.u]] ^ prints[at[e.v]]) >= 0
            parent[find(at[e.u])] = find(at[e.v])
        got = [find(i) for i in range(len(prints))]
        assert all((want[i] == want[j]) == (got[i] == got[j]) for i in range(len(prints)) for j in range(i))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5), (1001, 1002), (2000, 1999)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in (1000, 1001, 1002)}, 1999: 1999, 2000: 1999}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghijklm") + str(rng.randrange(50)) for _ in range(200)) for _ in range(12)]
    texts = [None, "", "  ", "One", "one", "w " * 40000]
    for b in base:
        words = b.split()
        for _ in range(5):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    texts += texts[:10]
    ids = list(range(100, 100 + len(texts)))
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    roots = slow_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, r in zip(ids, roots):
        least[r] = min(i, least.get(r, i))
    assert {i: got[i].component_id for i in ids} == {i: least[r] for i, r in zip(ids, roots)}
    assert [got[i].fp & (1 << 64) - 1 for i in ids] == prints
    assert near_duplicates(df.limit(0)).collect() == []


def test_token_hashes_keep_texts_apart():
    h, owner = token_hashes(["A b, C", "", "b-a", "É é"])
    assert owner.tolist() == [0, 0, 0, 2, 2, 3, 3]
    assert h[0] == h[4] and h[1] == h[3] and h[5] == h[6] and len(set(h.tolist())) == 4


def test_best_overlap():
    doc, item = np.array([9, 9, 1, 2, 3, 8, 5, 6, 7, 9]), np.array([1, 2, 3, 4, 5, 6, 7])
    assert best_overlap(doc, item, 2) == (6, 7, 2)
    assert best_overlap(doc, item, 50) == (0, 0, 0)


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def test_overlaps_found_and_clean_documents_left(spark):
    rng = random.Random(2)
    items = {i: words(rng, n) for i, n in enumerate([15, 30, 60, 25, 7])}
    common = words(rng, 400)
    rows, want = [], set()
    for d in range(60):
        body = [rng.choice(common) for _ in range(rng.randint(20, 300))]
        if d % 3 == 0:
            i = d // 3 % len(items)
            part = list(items[i])
            if i != 4:
                for k in range(4, len(part), 9):  # one word in nine is another
                    part[k] = "other"
            at = rng.randrange(len(body))
            body[at:at] = part
            want.add((d, i))
        rows.append((d, " ".join(body).capitalize().replace(" e", ", E"), 1))
    rows += [(100, None, 1), (101, "", 1), (102, " ".join(items[1][:9] + body), 1), (0, rows[0][1], 1)]
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in items.items()), (90, None), (91, "a b"), (92, "")], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    got = find_overlaps(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert find_overlaps(df.limit(0), bench).collect() == [] and find_overlaps(df, bench.limit(0)).collect() == []


def test_passage_deep_in_a_long_text(spark):
    rng = random.Random(4)
    item = words(rng, 40)
    text = " ".join(["filler"] * 50000 + item + ["filler"] * 50000)
    df = spark.createDataFrame([(1, text), (2, "filler " * 1000)], "doc_id long, text string")
    got = find_overlaps(df, spark.createDataFrame([(7, " ".join(item))], "item_id int, text string")).collect()
    assert [(r.doc_id, r.item_id, r.matched, r.start) for r in got] == [(1, 7, 40, 50000)]


def test_every_window_of_a_repeated_seed_counts(spark):
    rng = random.Random(6)
    phrase, between, tail = words(rng, 11), words(rng, 12), words(rng, 6)
    item = phrase + between + phrase + tail
    # eleven tokens match at both places of the phrase; only at the second one does the next but one match too
    text = words(rng, 20) + phrase + ["changed", tail[1]] + words(rng, 20)
    df = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(words(rng, 20) + phrase + words(rng, 20)))], "doc_id long, text string")
    got = find_overlaps(df, spark.createDataFrame([(7, " ".join(item))], "item_id int, text string")).collect()
    assert [(r.doc_id, r.item_id, r.matched, r.compared, r.start) for r in got] == [(1, 7, 12, 13, 20)]


def test_hot_seeds_are_dealt_into_cells(spark):
    hits = spark.range(12000).select(F.col("id").alias("region"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 700 + 2).alias("seed"), (F.col("id") % 5).cast("int").alias("doc_at"))
    known = spark.range(10000).select(F.col("id").alias("item"), F.when(F.col("id") < 900, 1).when(F.col("id") < 5000, 3).otherwise(F.col("id")).alias("seed"), (F.col("id") % 3).cast("int").alias("item_at"))
    one, other = dealt_seeds(hits, known)
    for side in (one, other):  # 4,000 hits and 900 windows of a seed, 4,100 windows of another
        assert side.groupBy("seed", "_rows", "_columns").count().agg(F.max("count")).first()[0] <= 300
    want = hits.where("region < 600").join(known, "seed").select("region", "item", (F.col("doc_at") - F.col("item_at")).alias("d"))
    got = candidate_pairs(hits, known).where("region < 600").select("region", "item", F.explode("diagonals").alias("d"))
    assert want.count() == got.count() and want.exceptAll(got).count() == 0


def test_one_seed_of_many_items_and_documents(spark):
    rng = random.Random(8)
    start = words(rng, 8)
    items = [start + words(rng, 20) for _ in range(1500)]
    docs = [(i, " ".join(start + (items[i][8:] if i % 50 == 0 else words(rng, 20)))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = find_overlaps(df, spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id int, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(0, 600, 50)]


def test_items_without_id_and_with_repeated_ids(spark):
    rng = random.Random(9)
    a, b = words(rng, 20), words(rng, 30)
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, "none of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, " ".join(a)), (5, " ".join(b)), (5, " ".join(b[:15])), (5, None)], "item_id int, text string")
    assert {(r.doc_id, r.item_id, r.matched) for r in find_overlaps(df, bench).collect()} == {(1, None, 20), (2, 5, 30)}
    assert find_overlaps(df, bench.select(F.col("item_id").cast("string"), F.lit(None).cast("string").alias("text"))).collect() == []


def test_best_overlap_is_any_stretch_of_the_share():
    item = np.arange(103)
    doc = item.copy()
    doc[np.flatnonzero((item >= 12) & ((item - 12) % 7 < 2))] = -1
    m, n, at = best_overlap(doc, item, 0)
    assert m >= 12 and m >= 0.75 * n and m == (doc == item)[at : at + n].sum()
    rng = np.random.default_rng(1)
    for _ in range(200):
        item = np.arange(rng.integers(1, 25))
        doc = np.where(rng.random(len(item)) < 0.65, item, -1)
        same = doc == item
        best = max(int(same[i:j].sum()) for i in range(len(item) + 1) for j in range(i, len(item) + 1) if same[i:j].sum() >= 0.75 * (j - i))
        m, n, at = best_overlap(doc, item, 0)
        assert m == best and m >= 0.75 * n and same[at : at + n].sum() == m


def test_short_masks_find_every_pattern_of_the_share():
    for n in range(5, 10):
        for bits in range(1 << n):
            on = [bits >> i & 1 for i in range(n)]
            if sum(on) >= 0.75 * n:
                assert any(all(on[a + i] for i, c in enumerate(k) if c == "1") for k in SHORT_MASKS for a in range(n - len(k) + 1))


def test_short_items_and_scripts_without_spaces(spark):
    rng = random.Random(3)
    items = {n: words(rng, n) for n in range(1, 10)}
    bench = [(n, " ".join(w)) for n, w in items.items()] + [(20, "春眠暁を覚えず処処啼鳥を聞く"), (21, "你好吗")]
    common, rows, want = [f"{w}q" for w in words(rng, 300)], [], set()
    for n, item in items.items():
        for k in range(-1, n):
            part = [w if i != k else "other" for i, w in enumerate(item)]
            doc, body = len(rows), [rng.choice(common) for _ in range(40)]
            body[20:20] = part
            rows.append((doc, " ".join(body)))
            if k < 0 or n >= 5:
                want.add((doc, n))
    part = [w if i not in (2, 5) else "other" for i, w in enumerate(items[8])]
    rows += [(100, " ".join(common[:9] + part)), (101, "彼は「春眠暁を覚えず、処処啼鳥を聞く」と言った。"), (102, "他说：你好吗？"), (103, "他说你很好"), (104, "夜来風雨の声")]
    want |= {(100, 8), (101, 20), (102, 21)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = find_overlaps(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("masks, n, changed", [(MASKS, 16, 4), (MASKS, 15, 3), (MASKS, 14, 2), (MASKS, 20, 5), *((MIDDLE_MASKS, n, int(n / 4)) for n in range(10, 16))])
def test_masks_reach_nine_tenths_of_what_the_rule_admits(masks, n, changed):
    windows = [sum(1 << a + i for i, c in enumerate(k) if c == "1") for k in masks for a in range(n - len(k) + 1)]
    places = [sum(1 << i for i in c) for c in itertools.combinations(range(n), changed)]
    assert sum(any(not w & p for w in windows) for p in places) >= 0.95 * len(places)


def overlaps_by_trying_all(doc, item):
    """Whether any stretch on any diagonal keeps the documented rule."""
    needed = len(item) if len(item) < 5 else min(12, 0.75 * len(item))
    for diagonal in range(-len(item) + 1, len(doc)):
        lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
        same = np.cumsum([0, *(doc[i] == item[i - diagonal] for i in range(lo, hi))])
        for i in range(len(same) - 1):
            m = same[i + 1 :] - same[i]
            if ((m >= needed) & (m >= 0.75 * np.arange(1, len(m) + 1))).any():
                return True
    return False


def test_overlaps_against_brute_force(spark):
    rng = random.Random(12)
    items = {i: words(rng, rng.choice([4, 7, 10, 12, 13, 15, 16, 18, 24, 40])) for i in range(25)}
    common, docs = words(rng, 200), {}
    for d in range(260):
        body, part = [rng.choice(common) for _ in range(rng.randint(5, 30))], list(items[d % 25])
        for k in rng.sample(range(len(part)), int(rng.choice([0, 0.1, 0.2, 0.25, 0.35, 0.5]) * len(part))):
            part[k] = "other"
        body[rng.randrange(len(body) + 1) :] += part[: rng.choice([len(part), len(part), 13])]
        docs[d] = body
    want = {(d, i) for d, body in docs.items() for i, item in items.items() if overlaps_by_trying_all(body, item)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_overlaps(spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string"), bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 130


def test_equal_overlaps_null_ids_and_clashing_names(spark):
    item = [f"word{i}" for i in range(20)]
    text = " ".join([*item, *["between"] * 200, *item])
    docs = spark.createDataFrame([(1, text, "x"), (None, text, "y"), (None, text, "y")], "doc_id long, text string, item_id string").withColumn("seed", F.lit(0))
    got = find_overlaps(docs, spark.createDataFrame([(7, " ".join(item), 1)], "item_id int, text string, start int")).collect()
    assert sorted(((r.doc_id, r.matched, r.compared, r.start) for r in got), key=str) == [(1, 20, 20, 0), (None, 20, 20, 0)]


def test_near_duplicates_with_null_ids_and_other_distances(spark):
    rows = [(None, "a b c d"), (None, "A b c d"), (4, "a b c d"), (None, "x y z w v")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"root": F.lit(1), "n": F.lit("n"), "key": F.lit(2)})).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == [(4, 4), (None, 4), (None, 4), (None, None)]
    with pytest.raises(ValueError, match="distance"):
        links(spark.createDataFrame([], "fp long"), distance=7)
