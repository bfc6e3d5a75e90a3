import hashlib
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from toroid.llm import exact_dedup
from toroid.llm.exact_dedup import build_directory, directory_depth, drop_copies, find_copies
from toroid.llm.mixing import FIELDS, mix, pair_fold, pool_fold, source_targets, take

SCHEMA = "doc_id long, text string, source string, extra int"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], SCHEMA)


ROWS = [(1, "Abc", "a"), (2, "aBC", "b"), (3, "É", "a"), (4, "é", "a"), (5, None, None), (6, "", "b"), (7, "x " * 30000, "a"), (8, "X " * 30000, "b"), (8, "X " * 30000, "b"), (None, "abc", "a"), (9, "lone", "c")]


def expected(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return {(i, hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest(), max((x for x in groups[(t or "").translate(LOWER)] if x is not None), default=None), len(groups[(t or "").translate(LOWER)])) for i, t, _ in rows}


@pytest.mark.parametrize("options", [{}, {"key_bits": 2, "capacity": 1}, {"capacity": 1}])
def test_copies(spark, options):
    got = find_copies(docs(spark, ROWS), **options).collect()
    assert len(got) == len(ROWS)
    assert {(r.doc_id, r.text_sha256, r.keep_id, r.group_size) for r in got} == expected(ROWS)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_collisions_are_chained(spark):
    got = find_copies(docs(spark, ROWS), key_bits=1).collect()
    assert max(r.chain_length for r in got) > 1
    assert {r.chain_length for r in find_copies(docs(spark, ROWS)).collect()} == {1}


def test_directory_doubles_and_owners_take_ranges(spark):
    rows = [(i, f"text {i // 2}", "a") for i in range(400)]
    got = find_copies(docs(spark, rows), capacity=10).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, i | 1, 2) for i in range(400)}
    owner = {r.bucket: r.owner for r in got}
    assert len(owner) > 16 and [owner[b] for b in sorted(owner)] == sorted(owner.values())
    keys = Counter((r.bucket, r.text_sha256) for r in got)
    assert max(Counter(b for b, _ in keys).values()) <= 10


def test_results_come_from_the_index(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "build_directory", lambda counts, capacity, depth: [])
    with pytest.raises(IndexError):
        find_copies(docs(spark, ROWS))


def test_many_repeated_texts_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_HASHES", 1)
    assert {(r.doc_id, r.text_sha256, r.keep_id, r.group_size) for r in find_copies(docs(spark, ROWS)).collect()} == expected(ROWS)


def test_drop_copies(spark):
    out = drop_copies(docs(spark, ROWS))
    assert out.columns == ["doc_id", "text", "source", "extra"]
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([2, 3, 4, 6, 8, 9], key=str)


def test_empty_and_clashing_columns(spark):
    empty = docs(spark, []).withColumn("kept", F.lit(1)).withColumn("owner", F.lit("x"))
    assert find_copies(empty).collect() == [] and drop_copies(empty).collect() == []
    clash = docs(spark, ROWS[:3]).withColumn("kept", F.lit(1)).withColumn("group_size", F.lit("x"))
    assert find_copies(clash).count() == 3


def test_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Same").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = find_copies(df).where("text_sha256 = sha2('same', 256)")
    assert got.agg(F.count("*"), F.max("keep_id"), F.min("group_size"), F.count_if("kept")).first() == (1000, 2997, 1000, 1)


def test_directory_splits_only_overfull_buckets():
    counts = {p: 1 for p in range(8)} | {8: 100, 12: 3}
    assert directory_depth(0, 10) == 2 and directory_depth(10**9, 10**4) == 19
    buckets = build_directory(counts, 10, 4)
    assert sum(b.keys for b in buckets) == sum(counts.values())
    covered = sorted(p for b in buckets for p in range(b.prefix << (4 - b.depth), (b.prefix + 1) << (4 - b.depth)))
    assert covered == list(range(16))
    assert all(b.keys <= 10 or b.depth == 4 for b in buckets)
    assert any(b.depth == 1 for b in buckets)  # the lower half was never split
    assert [b.owner for b in buckets] == sorted(b.owner for b in buckets)


def water_fill(sizes, weights, most):
    """Targets by repeated capping, as the contract words it."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > most * sizes[i] + 1e-9}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 100, 1000], [5, 0, 7, 1000, 3], [10], [1, 1, 1, 1, 10**6]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}" if i < len(sizes) - 1 else None, n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in source_targets(df, "source", (1, 2, 3), 3.0).orderBy(F.col("source").asc_nulls_last()).collect()]
    assert got == pytest.approx(water_fill(sizes, [i % 3 + 1 for i in range(len(sizes))], 3.0))


def mixed_docs(spark, n=3000):
    words = (F.abs(F.xxhash64("id")) % 40 + 1).cast("int")
    source = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(abs(xxhash64(id)) % 40 + 1 as int))").alias("text"), source.alias("source"))


def test_mix_meets_targets_and_reruns_agree(spark):
    df = mixed_docs(spark)
    got = mix(df, block=16, giant=20).collect()
    assert len(got) == 3000
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 40
        rate = rows[0].target / rows[0].source_size
        assert all(r.copies in (int(rate), int(rate) + 1) for r in rows)
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(sum(r.size for r in got))
    again = mix(df.repartition(5), block=16, giant=20).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_is_unbiased(spark):
    df = mixed_docs(spark, 60)
    taken = Counter()
    for seed in range(30):
        for r in mix(df, seed=seed, block=8, giant=6).collect():
            taken[r.source] += r.copies
    rates = {r.source: r.target / r.source_size for r in mix(df).collect()}
    n = Counter(r.source for r in df.collect())
    for s, rate in rates.items():
        assert taken[s] / 30 / n[s] == pytest.approx(rate, abs=0.2)


def folds(spark, sizes, chances, sql, runs=20_000):
    """Mean fraction of each item after `runs` folds of the same items under other keys, and the largest change of all words."""
    items = F.array(*[F.struct(F.xxhash64("id", F.lit(i)).alias("key"), F.lit(n).cast("long").alias("size"), F.lit(p).cast("double").alias("p"), F.lit(0).alias("whole"), F.lit(i).cast("long").alias("id"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("source_size"), F.lit(1.0).alias("target")) for i, (n, p) in enumerate(zip(sizes, chances))])
    done = spark.range(runs).select("id", items.alias("items")).select("id", F.expr(sql).alias("f")).select("id", F.explode(F.expr("if(f.held is null, f.out, array_append(f.out, f.held))")).alias("o"))
    mean = [r.p for r in done.groupBy("o.id").agg(F.avg("o.p").alias("p")).orderBy("id").collect()]
    words = done.groupBy("id").agg(F.sum(F.col("o.p") * F.col("o.size")).alias("w"), F.count_if(~F.col("o.p").isin(0.0, 1.0)).alias("u"))
    return mean, *words.agg(F.min("w"), F.max("w"), F.max("u")).first()


SIZES = [20_000, 900, 800, 350, 120, 60, 60, 9, 5, 1]


@pytest.mark.parametrize("p", [0.07, 0.5, 0.8])
def test_pool_steps_keep_every_expectation(spark, p):
    for sizes in (SIZES, SIZES[1:]):
        mean, least, most, undecided = folds(spark, sizes, [p] * len(sizes), pool_fold("items", "0L", 1, "bigint"))
        assert mean == pytest.approx([p] * len(sizes), abs=4 * (p * (1 - p) / 20_000) ** 0.5)
        assert least == pytest.approx(p * sum(sizes)) and most == pytest.approx(p * sum(sizes)) and undecided <= 1


@pytest.mark.parametrize("chances", [[0.1, 0.9] * 5, [0.5] * 10, [0.9, 0.2, 0.3, 0.99, 0.01, 0.6, 0.4, 0.7, 0.05, 0.5]])
def test_pair_steps_keep_every_expectation(spark, chances):
    mean, least, most, undecided = folds(spark, SIZES, chances, pair_fold("items", 1, "bigint"))
    assert mean == pytest.approx(chances, abs=4 * 0.5 / 20_000**0.5)
    words = sum(n * p for n, p in zip(SIZES, chances))
    assert least == pytest.approx(words) and most == pytest.approx(words) and undecided <= 1


def test_large_documents_do_not_spoil_targets(spark):
    sizes = [30_000, 9_000, 4_000] + [i % 90 + 1 for i in range(2000)]
    df = spark.createDataFrame([(i, "w " * n, "ab"[i % 2]) for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    for seed in range(3):
        got = mix(df, seed=seed).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
        assert all(abs(r.n - r.t) <= 45 for r in got)


def test_mix_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", "a"), (3, "one two", "a"), (None, "x y z", None), (4, "w " * 50000, "b")]
    got = mix(docs(spark, rows)).collect()
    assert len(got) == 6 and sum(r["size"] for r in got) == 50007
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert mix(docs(spark, [])).collect() == []
    assert mix(docs(spark, [(1, None, "a")])).first().taken == 0


def test_take_repeats_documents(spark):
    df = docs(spark, [(i % 40, f"t {i % 40}" + " w" * (i % 5), "abc"[i % 3]) for i in range(60)])
    decisions = mix(df)
    out = take(df, decisions)
    assert out.count() == decisions.agg(F.sum("copies")).first()[0]
    assert take(df, decisions, repeat=False).count() == decisions.where("copies > 0").count()


def test_take_with_clashing_columns(spark):
    df = docs(spark, [(i, f"t {i}" + " w" * (i % 5), "abc"[i % 3]) for i in range(30)]).withColumns({"copies": F.lit("x"), "size": F.lit("y"), "key": F.lit("k"), "taken": F.lit(0)})
    decisions = mix(df)
    out = take(df, decisions, repeat=False)
    assert {r.doc_id: r.taken for r in out.collect()} == {r.doc_id: r.taken for r in decisions.collect() if r.copies}
    assert set(out.columns) == {*df.columns, "source_size", "target"} and out.first().key == "k"
