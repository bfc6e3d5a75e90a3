"""Boosting against a plain grower that splits one leaf at a time, and what folds share."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from toroid import config as C
from toroid.operators import boosting as B
from toroid.operators import metrics as M
from toroid.operators import models as L
from toroid.operators import splits as S
from toroid.operators.quantiles import fold_quantiles
from toroid.sources import sinks

FEATURES = ["a", "b", "c", "d"]


def sample(n, seed=0, missing=0.0):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=n), rng.integers(0, 12, n), rng.exponential(size=n), rng.normal(size=n)]
    y = np.sin(3 * x[:, 0]) + (x[:, 1] > 5) * x[:, 2] + rng.normal(0, 0.3, n)
    x[rng.random(x.shape) < missing] = np.nan
    return x, np.exp(np.clip(y, -3, 5)) + 1


def frame(spark, x, y, fold=None):
    rows = [(*[None if math.isnan(v) else float(v) for v in r], float(t), int(i) % (fold or 1)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in FEATURES) + f", {C.TARGET} double, fold int")
    return df if fold else df.drop("fold")


def plain_tree(codes, residual, depth, leaves, least):
    """Residual means of the leaves of a tree that always splits the leaf of largest gain, and the number of leaves."""

    def best(rows, level):
        found = (0.0, None)
        if level == depth or len(rows) < 2 * least:
            return found
        r = residual[rows]
        for f in range(codes.shape[1]):
            for cut in np.unique(codes[rows, f])[:-1]:
                left = codes[rows, f] <= cut
                n = left.sum()
                if least <= n <= len(rows) - least:
                    gain = r[left].sum() ** 2 / n + r[~left].sum() ** 2 / (len(rows) - n) - r.sum() ** 2 / len(rows)
                    if gain > found[0] + 1e-9:
                        found = (gain, (f, cut))
        return found

    done = [(np.arange(len(residual)), 0)]
    done = [(*best(*done[0]), *done[0])]
    while len(done) < leaves:
        at = max(range(len(done)), key=lambda i: done[i][0])
        gain, split, rows, level = done[at]
        if split is None:
            break
        left = codes[rows, split[0]] <= split[1]
        done[at : at + 1] = [(*best(r, level + 1), r, level + 1) for r in (rows[left], rows[~left])]
    out = np.zeros(len(residual))
    for _, _, rows, _ in done:
        out[rows] = residual[rows].mean()
    return out, len(done)


def plain_boosting(codes, y, rounds, depth, leaves, least):
    score, sizes = np.full(len(y), y.mean()), []
    for _ in range(rounds):
        step, size = plain_tree(codes, y - score, depth, leaves, least)
        score = score + B.RATE * step
        sizes.append(size)
    return score, sizes


@pytest.mark.parametrize(("depth", "leaves"), [(8, 31), (3, 31), (8, 6)])
def test_equals_a_plain_leaf_by_leaf_grower(spark, depth, leaves):
    x, y = sample(900, missing=0.05)
    df = frame(spark, x, y).repartition(5)
    edges = B.bin_edges(df, FEATURES, 40)
    fills = L.medians(df, FEATURES)
    codes = np.stack([B.bin_numbers(np.where(np.isnan(x[:, i]), fills[c], x[:, i]), edges[c]) for i, c in enumerate(FEATURES)], 1)
    wanted, sizes = plain_boosting(codes, np.log1p(y), 6, depth, leaves, B.LEAST)
    model, passes = L.Boosting(6, depth, 40, leaves)._fitted(df, FEATURES, {None: fills}, edges)
    got = [r[0] for r in model[None].transform(frame(spark, x, y).coalesce(1)).select(L._LOG).collect()]
    assert np.allclose(got, wanted, atol=1e-9)
    trees = model[None].stages[0].trees
    assert [sum(f < 0 for f in t.feature) for t in trees] == sizes and max(sizes) <= leaves
    assert passes.histograms <= 6 * depth and passes.rounds == [6]


def test_leaves_hold_enough_rows(spark):
    x, y = sample(700, 1)
    df = frame(spark, x, y)
    model = L.Boosting(4, 8, 64)(df, FEATURES)
    own = json.loads(model.stages[0].getOrDefault("document"))
    codes = np.stack([B.bin_numbers(x[:, i], e) for i, e in enumerate(own["edges"])])
    for tree in model.stages[0].trees:
        assert np.bincount(tree.place(codes))[np.array(tree.feature) < 0].min() >= B.LEAST


def test_edges_and_bins(spark):
    df = spark.createDataFrame([(float(i % 5), float(i), None, 1.0, float("nan") if i % 2 else 2.0) for i in range(2000)], "few double, many double, none double, one double, half double")
    edges = B.bin_edges(df, df.columns)
    assert edges["few"] == [0.5, 1.5, 2.5, 3.5] and edges["none"] == [] and edges["one"] == [] and edges["half"] == []
    assert 240 < len(edges["many"]) <= 254 and max(np.diff(edges["many"])) < 25
    values = np.array([-1.0, 0.5, 0.6, 9.0, np.nan, math.inf])
    assert B.bin_numbers(values, edges["few"]).tolist() == [0, 0, 1, 4, B.MISSING, 4]


def test_folds_share_passes_and_equal_single_fits(spark):
    x, y = sample(1000, 2, missing=0.1)
    df = frame(spark, x, y, 4).repartition(6).cache()
    values = L.fold_medians(df, FEATURES, 4)
    edges = B.bin_edges(df, FEATURES)
    family = L.Boosting(5, 4)
    together, passes = family._fitted(df, FEATURES, values, edges)
    assert passes.histograms <= 5 * 4  # as one model alone
    for k in range(4):
        alone, _ = family._fitted(df.where(F.col("fold") != k).drop("fold"), FEATURES, {None: values[k]}, edges)
        a, b = ([r[0] for r in L.predict(m, df).orderBy(*FEATURES).select(M.PREDICTED).collect()] for m in (together[k], alone[None]))
        assert np.allclose(a, b, rtol=1e-9)
    assert L.cross_validate(df, FEATURES, family, 4, "boosting", values=values).count() == 1


def test_early_stop_takes_fewer_rounds_for_the_same_error(spark):
    rng = np.random.default_rng(3)
    x, y = sample(3000, 3)
    y = np.exp((x[:, 0] > 0) + rng.normal(0, 0.3, len(x)))  # a few rounds tell all there is
    df = frame(spark, x, y, 5).cache()
    train, test = df.where("fold <> 0").drop("fold"), df.where("fold = 0").drop("fold")
    found = {}
    for early in (1000, 10**9):
        model, passes = L.Boosting(45, 3, early_rows=early, rate=0.3)._fitted(train, FEATURES, {None: L.medians(train, FEATURES)})
        errors = L.predict(model[None], test).select(F.sqrt(F.avg((F.log1p(M.PREDICTED) - F.log1p(C.TARGET)) ** 2))).first()[0]
        found[early] = passes.rounds[0], errors
    assert B.PATIENCE < found[1000][0] < 45 == found[10**9][0], found
    assert found[1000][1] <= found[10**9][1] * 1.02


def test_stop_rule():
    model = B.Model(B.View(None, [], True), losses=[1.0 / (i + 1) for i in range(30)])
    assert not model.over
    model.losses += [model.losses[-1]] * 9
    assert not model.over
    model.losses += [model.losses[-1]]
    assert model.over and not B.Model(B.View(None, [], False), losses=model.losses).over


def test_a_saved_model_predicts_the_same(spark, tmp_path):
    x, y = sample(300, 4, missing=0.2)
    df = frame(spark, x, y).coalesce(1)
    model = L.Boosting(3, 3)(df, FEATURES)
    loaded = sinks.read_model(spark, sinks.write_model(model, str(tmp_path / "m")))
    assert isinstance(loaded, PipelineModel)
    a, b = (L.predict(m, df).select(M.PREDICTED).collect() for m in (model, loaded))
    assert a == b and all(math.isfinite(r[0]) for r in a)


def test_partitions_and_unsplittable_tables(spark):
    x, y = sample(400, 5)
    a, b = (L.predict(L.Boosting(3, 5)(frame(spark, x, y).repartition(p), FEATURES), frame(spark, x, y).coalesce(1)).toPandas()[M.PREDICTED] for p in (1, 7))
    assert np.allclose(a, b, rtol=1e-9)
    flat = frame(spark, np.ones((50, 4)), np.full(50, 2.0))
    assert L.predict(L.Boosting(3, 5)(flat, FEATURES), flat).agg(F.max(M.PREDICTED)).first()[0] == pytest.approx(2.0)
    with pytest.raises(ValueError, match="missing"):
        L.Boosting(3)(frame(spark, np.full((30, 4), np.nan), np.arange(30.0)), FEATURES)


def test_partial_histograms_that_are_too_many_are_added_by_tasks(spark, monkeypatch):
    x, y = sample(500, 6)
    df = frame(spark, x, y).repartition(4)
    edges = B.bin_edges(df, FEATURES)
    fills = {None: L.medians(df, FEATURES)}
    whole = L.Boosting(2, 4)._fitted(df, FEATURES, fills, edges)[0][None].stages[0].getOrDefault("document")
    monkeypatch.setattr(B, "DIRECT", 0)
    apart = L.Boosting(2, 4)._fitted(df, FEATURES, fills, edges)[0][None].stages[0].getOrDefault("document")
    assert json.loads(whole)["trees"][0][:4] == json.loads(apart)["trees"][0][:4]


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9])
def test_fold_quantiles_equal_those_of_each_training_part(spark, share):
    rng = np.random.default_rng(7)
    n = 4000
    columns = {"smooth": rng.normal(size=n) * 1e6, "ties": rng.integers(0, 4, n).astype(float), "skew": rng.exponential(size=n) ** 4, "one": np.ones(n), "gone": np.full(n, np.nan), "ends": rng.choice([-math.inf, math.inf, 0.0, 1.0], n)}
    columns["smooth"][rng.random(n) < 0.3] = np.nan
    fold = rng.integers(0, 5, n)
    rows = [(*[None if math.isnan(v) else float(v) for v in r], int(k) if k < 4 else None) for *r, k in zip(*columns.values(), fold)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", fold int").repartition(5)
    got = fold_quantiles(df, {c: (F.col(c), share) for c in columns}, "fold", 4)
    for k in range(4):
        for c, v in columns.items():
            own = np.sort(v[(fold != k) & ~np.isnan(v)])
            at = share * (len(own) - 1)
            low, part = (own[math.floor(at)], at - math.floor(at)) if len(own) else (None, 0)
            assert got[k][c] == (low if not part else (1 - part) * low + part * own[math.floor(at) + 1]), (k, c)
    assert fold_quantiles(df.limit(0), {"smooth": (F.col("smooth"), share)}, "fold", 2) == {0: {"smooth": None}, 1: {"smooth": None}}


def test_fold_medians_of_shots(spark):
    df = S.shot_folds(spark.range(400).select((F.col("id") % 60).alias("shot_id"), F.col("id").cast("double").alias(C.TARGET), F.sqrt("id").alias("x")), folds=5).cache()
    got = L.fold_medians(df, ["x"], 5)
    for k in range(5):
        own = L.medians(L.log_label(df.where(F.col("fold") != k)), ["x", "_label"])
        assert got[k] == own


def test_features_with_the_same_bins_are_counted_once(spark):
    x, y = sample(600, 8)
    df = frame(spark, x, y).withColumns({"e": F.col("b") * 3, "f": F.log1p("b")}).repartition(3)
    names = ["a", "b", "c", "d", "e", "f"]
    model, _ = L.Boosting(3, 4)._fitted(df, names, {None: L.medians(df, names)})
    assert json.loads(model[None].stages[0].getOrDefault("document"))["features"] == FEATURES
    alone, _ = L.Boosting(3, 4)._fitted(df, FEATURES, {None: L.medians(df, FEATURES)})
    a, b = (L.predict(m[None], df).select(M.PREDICTED).toPandas()[M.PREDICTED] for m in (model, alone))
    assert np.allclose(a, b, rtol=1e-12)


def test_chunks_are_large(spark):
    x, y = sample(400, 9)
    df = L.log_label(frame(spark, np.tile(x, (100, 1)), np.tile(y, 100)).coalesce(1))
    chunks = B.chunked(df, FEATURES, B.bin_edges(df, FEATURES), L._LABEL, F.lit(-1), F.lit(False), 1)
    assert [r.n for r in chunks.collect()] == [40_000]  # batches of 10,000 rows come as one chunk


def test_one_feature_alone(spark):
    x, y = sample(300, 10)
    df = frame(spark, x, y)
    assert L.predict(L.Boosting(2, 3)(df, ["a"]), df).where(f"{M.PREDICTED} > 0").count() > 0


def test_bins_of_medians_come_from_counts(spark):
    rng = np.random.default_rng(12)
    n = 1200
    x = rng.normal(size=(n, 4))
    x[:, 1] = rng.integers(0, 3, n)
    x[:, 2] = np.arange(n) % 2 * 10.0  # the two middle values of all rows are 0 and 10
    x[rng.random((n, 4)) < [0.2, 0.1, 0, 0]] = np.nan
    df = frame(spark, x, np.exp(rng.normal(size=n)), 4).withColumn("gone", F.lit(None).cast("double")).repartition(3).cache()
    names = [*FEATURES, "gone"]
    edges = B.bin_edges(df, names, 40)
    rows = L.log_label(df)
    wanted = {None: L.medians(df, FEATURES)} | L.fold_medians(df, FEATURES, 4)
    asked = []

    def exact(columns):
        asked.extend(columns)
        return wanted

    chunks = B.chunked(rows, names, edges, L._LABEL, F.col("fold"), F.lit(False), 0)
    got = B.with_middles(chunks, names, edges, list(wanted), exact)
    assert got.features == FEATURES and "c" in asked and "gone" not in asked
    assert got.fills == {k: [int(B.bin_numbers(np.array([v[c]]), edges[c])[0]) for c in FEATURES] for k, v in wanted.items()}
    assert got.rows == {k: df.where(F.col("fold") != k).count() if k is not None else n for k in wanted}


def test_tasks_read_one_chunk_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(B, "CHUNK_ROWS", 100)
    x, y = sample(2000, 13)
    df = L.log_label(frame(spark, x, y).coalesce(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        chunks = B.chunked(df, FEATURES, B.bin_edges(df, FEATURES), L._LABEL, F.lit(-1), F.lit(False), 0)
        seen = chunks.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["rows"]) for b in bs), "rows long")
        with B.chunk_by_chunk(spark):
            assert {r.rows for r in seen.collect()} == {1} and chunks.count() == 20
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "100"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_codes_that_were_joined_make_the_same_chunks(spark):
    x, y = sample(500, 14, missing=0.1)
    df = L.log_label(frame(spark, x, y, 4).withColumn("id", F.monotonically_increasing_id()).coalesce(1))
    edges = B.bin_edges(df, FEATURES)
    straight = B.chunked(df, FEATURES, edges, L._LABEL, F.col("fold"), B.set_aside(FEATURES, L._LABEL), 0).drop("score").collect()
    coded = B.coded(df, FEATURES, edges, L._LABEL, B.set_aside(FEATURES, L._LABEL), "id").withColumn("fold", F.lit(None).cast("int"))
    got = B.chunked_codes(coded, 4).drop("score").collect()
    assert [(r.n, r.codes, r.label, r.aside) for r in got] == [(r.n, r.codes, r.label, r.aside) for r in straight]
    assert set(np.frombuffer(got[0].fold, np.int16)) == {-1}


def test_fold_errors_are_those_of_the_models_predictions(spark):
    x, y = sample(900, 15, missing=0.1)
    df = frame(spark, x, y, 3).repartition(4).cache()
    values, family = L.fold_medians(df, FEATURES, 3), L.Boosting(4, 3)
    models = family.folds(df, FEATURES, values)
    for _, k, *got in family.fold_errors(df, FEATURES, values, "boosting"):
        own = M.sound_metrics(L.predict(models[k], df.where(F.col("fold") == k)), "", C.TARGET, M.PREDICTED)
        assert got == pytest.approx([own["mae"], own["rmse"], own["r2"]], rel=1e-9)
