"""The forest over binned chunks: its trees against a plain grower, its draws, and that partitions do not matter."""

import json

import numpy as np
from pyspark.sql import functions as F

from test_boosting import FEATURES, frame, plain_tree, sample
from toroid import config as C
from toroid.operators import boosting as B
from toroid.operators import forest as T
from toroid.operators import metrics as M
from toroid.operators import models as L


def test_draws_follow_poisson_and_differ_by_tree():
    row = np.random.default_rng(0).integers(0, 1 << 63, 200_000).astype(np.uint64)
    a, b = (T.draws(row, k).astype(float) for k in (0, 1))
    assert abs(a.mean() - 1) < 0.02 and abs(a.var() - 1) < 0.03 and abs((a == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01


def test_equals_the_mean_of_plain_trees(spark, monkeypatch):
    monkeypatch.setattr(T, "GROUP_BYTES", 0)  # one tree at a time, as large ones grow
    x, y = sample(500, 11)
    df = L.log_label(frame(spark, x, y).repartition(4))
    fills = L.medians(df, FEATURES)
    model = T.fit_forest(df, FEATURES, L._LABEL, fills, trees=3, depth=4, bins=30)
    own = json.loads(model.getOrDefault("document"))
    codes = np.stack([B.bin_numbers(x[:, i], e) for i, e in enumerate(own["edges"])], 1)
    label = np.log1p(y)
    h = label.view(np.uint64) + np.uint64(C.SEED)
    for f in range(4):
        h = ((h ^ (h >> np.uint64(29))) + codes[:, f]) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    want = np.zeros(len(y))
    for k in range(3):
        drawn = np.repeat(np.arange(len(y)), T.draws(h, k))
        step, leaves = plain_tree(codes[drawn], label[drawn], 4, 16, T.LEAST)
        tree = model.trees[k]
        assert sum(f < 0 for f in tree.feature) == leaves
        got = 3 * np.array(tree.value)[tree.place(codes.T)]
        assert np.allclose(got[drawn], step, atol=1e-9)
        want += got / 3
    found = model.transform(df.coalesce(1)).select(L._LABEL, "prediction").collect()
    assert np.allclose(sorted(r[1] for r in found), sorted(want), atol=1e-9)
    assert abs(sum(model.importances.values()) - 1) < 1e-9


def test_partitions_do_not_change_a_forest(spark):
    x, y = sample(400, 12, missing=0.1)
    models = [L.Forest(4, 4)(frame(spark, x, y).repartition(p), FEATURES) for p in (1, 6)]
    a, b = (L.predict(m, frame(spark, x, y).coalesce(1)).toPandas()[M.PREDICTED] for m in models)
    assert np.allclose(a, b, rtol=1e-9)


def test_equal_importance_of_unused_features_is_zero(spark):
    x, y = sample(300, 13)
    df = frame(spark, x, y).withColumn("same", F.lit(1.0))
    found = dict(L.importance(L.Forest(3, 3)(df, [*FEATURES, "same"]), [*FEATURES, "same"]))
    assert found["same"] == 0 and abs(sum(found.values()) - 1) < 1e-9
