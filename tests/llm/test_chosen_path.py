import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from toroid.llm.chosen_path import LEAF, MATCHES, POSITIONS, child_keys, leaf_edges, node_edges, root_keys, similarity_join, sketch, tokens, whole_edges
from toroid.llm.set_links import connect, exact_links

WORDS = [f"w{i}" for i in range(400)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=2):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return set()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute_force(rows, k=2):
    """(n_shingles, component_id) by comparing all pairs of whole sets."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def got(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


def texts(rng, groups, copies, length=(20, 200), changed=0.12):
    out = []
    for _ in range(groups):
        words = [rng.choice(WORDS) for _ in range(rng.randint(*length))]
        for _ in range(rng.randint(1, copies)):
            own = list(words)
            for _ in range(int(rng.random() * changed * len(own))):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


def test_join_equals_all_pairs(spark):
    rng = random.Random(11)
    rows = list(enumerate(texts(rng, 120, 9)))
    rows += [(i + 5000, t) for i, t in enumerate(["", None, "  \n", "one", "One", "one two", "ONE\ttwo", "É é", "é é", "one two one two one", "one two one"])]
    rows += [(r[0] + 9000, r[1].upper()) for r in rows[:40]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(similarity_join(df)) == brute_force(rows)


def test_the_boundary_is_met_exactly(spark):
    """Sets of 80 shared shingles of 100 link, of 79 of 100 do not (shingles of one word)."""
    rows = []
    for g in range(40):
        common = [f"g{g}c{i}" for i in range(80)]
        rows += [(10 * g, " ".join(common + [f"g{g}a{i}" for i in range(10)])), (10 * g + 1, " ".join(common + [f"g{g}b{i}" for i in range(10)]))]
        rows += [(10 * g + 2, " ".join(common[:79] + [f"g{g}d{i}" for i in range(11)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = got(similarity_join(df, shingle=1))
    assert found == brute_force(rows, 1)
    assert sum(d != c for d, _, c in found) == 40


@pytest.mark.parametrize("options", [{"node": 60}, {"node": 60, "depth": 0}, {"node": 60, "depth": 1}])
def test_large_nodes_branch_or_are_dealt(spark, options):
    rng = random.Random(12)
    rows = list(enumerate(texts(rng, 2, 1, (150, 150)) + texts(rng, 40, 5)))
    base = [rng.choice(WORDS) for _ in range(150)]
    for i in range(300):  # one large group of near copies, some far from its centre
        own = list(base)
        for _ in range(rng.choice([1, 3, 9, 14])):
            own[rng.randrange(150)] = rng.choice(WORDS)
        rows.append((1000 + i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(similarity_join(df, **options)) == brute_force(rows)


def test_a_hot_copy_and_clashing_columns(spark):
    rng = random.Random(13)
    rows = [(i, "the same words again and again in each row") for i in range(600)] + [(i + 600, t) for i, t in enumerate(texts(rng, 30, 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "node", "component_id", "kept", "key", "digest", "size", "n")})
    out = similarity_join(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got(out) == brute_force(rows)


def test_odd_ids_repeats_long_texts_and_no_rows(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(3, long), (4, long + " y"), (None, "a b c"), (7, "a b c"), (7, "a b c"), (7, "d"), (None, "e f"), (None, None)]
    found = similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in found) == [
        (0, 0, 0, False), (0, 1, 0, False), (0, 2, 7, False), (3, 59_999, 3, True), (4, 60_000, 3, False), (7, 1, 7, True), (7, 2, 7, True), (7, 2, 7, True)]
    assert similarity_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def pair(rng, shared, own):
    common = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
    return [tokens(np.unique(np.r_[common, rng.integers(0, 1 << 63, own, dtype=np.uint64)])) for _ in range(2)]


def test_trees_reach_the_target_recall():
    """Pairs at the threshold meet in some root's child, and survive further levels."""
    rng, missed, deep, trials = np.random.default_rng(14), 0, 0, 400
    for _ in range(trials):
        a, b = pair(rng, 80, 10)
        assert (sketch(a) == sketch(b)).sum() >= MATCHES
        keys = np.intersect1d(root_keys(a), root_keys(b))
        missed += not len(keys)
        for _ in range(3):
            keys = np.intersect1d(*(np.unique(child_keys(keys, np.repeat(sketch(x)[None], len(keys), 0))[1]) for x in (a, b))) if len(keys) else keys
        deep += not len(keys)
    assert missed == 0 and deep == 0
    far = [len(np.intersect1d(*map(root_keys, pair(rng, 5, 95)))) for _ in range(300)]
    assert np.mean(far) < 2  # two children for a similarity of 1, over 14 trees


def connected(edges, n):
    label = list(range(n))
    for u, v in np.concatenate(edges, 1).T.tolist() if edges else []:
        a, b = label[u], label[v]
        label = [a if x == b else x for x in label]
    return {frozenset(i for i in range(n) if label[i] == x) for x in set(label)}


def test_nodes_keep_what_is_connected():
    rng = np.random.default_rng(15)
    base = rng.integers(0, 256, (12, POSITIONS))
    x = np.repeat(base, rng.integers(1, 40, 12), 0)
    x = np.where(rng.random(x.shape) < 0.25, rng.integers(0, 256, x.shape), x).astype(np.uint8)
    n, sizes = len(x), rng.integers(90, 100, len(x)).astype(np.int32)
    match = [(i, j) for i in range(n) for j in range(i) if (x[i] == x[j]).sum() >= MATCHES]
    wanted = connected([np.array(match).T], n)
    assert connected(leaf_edges(np.arange(n)[None], x, sizes), n) == wanted
    assert connected(whole_edges(np.arange(n), np.arange(n), x, sizes), n) == wanted
    assert n > LEAF
    # a single path loses some, all of them together none
    found = []
    for key in range(40):
        pool = {}
        found += node_edges(np.uint64(key), x, sizes, pool, 0)
        for size, leaves in pool.items():
            found += leaf_edges(np.array(leaves), x, sizes) if size > 1 else []
    assert connected(found, n) == wanted


def test_exact_links_connect_inside_clusters_only(spark):
    """A chain of candidates whose neighbours are not similar, while ends two apart are."""
    rng = random.Random(16)
    evens, odds = set(range(100)), set(range(1000, 1100))
    sets = [(i, sorted((evens if i % 2 == 0 else odds) - {rng.choice(list(evens | odds))})) for i in range(60)] + [(60, [1, 2]), (61, [1, 2])]
    links = exact_links(
        spark.createDataFrame([(i, i + 1) for i in range(59)] + [(60, 61)], "u long, v long"), spark.createDataFrame(sets, "node long, shingles array<long>"), 80, block=8).collect()
    label = connected([np.array([(r["u"], r["v"]) for r in links]).T], 62)
    assert label == {frozenset(range(0, 60, 2)), frozenset(range(1, 60, 2)), frozenset([60, 61])}
    assert len(links) < 870  # the pairs that are similar
    assert connect([np.array([1, 2]), np.array([1, 2]), np.array([9])], [0, 1, 2], [True, False, True], 80) == [(0, 1)]
