import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from toroid import config as C
from toroid.operators import metrics as M
from toroid.operators import models as L
from toroid.operators import scoring as R
from toroid.operators import splits as S
from toroid.plans.score import score_published, score_requests
from toroid.plans.train import train
from toroid.sources import sinks
from toroid.sources.samples import synthetic_shots
from toroid.streaming.score import score_stream

TINY = L.registry(trees=3, tree_depth=3, rounds=3, boost_depth=2)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), min_size=25, max_size=120), st.integers(1, 9))
def test_folds_are_disjoint_and_stable(spark, shots, parts):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shots)], "id long, shot_id int")
    a = {r.id: r.fold for r in S.shot_folds(df, folds=5).collect()}
    assert a == {r.id: r.fold for r in S.shot_folds(df.repartition(parts), folds=5).collect()}
    by_shot = {}
    for i, s in enumerate(shots):
        by_shot.setdefault(s, set()).add(a[i])
    assert all(len(f) == 1 for f in by_shot.values())


def greedy(sizes, folds):
    """The fold of each group in order, by one step for each group."""
    load, out = [0] * folds, []
    for size, groups in sizes:
        for _ in range(groups):
            f = min(range(folds), key=lambda f: (load[f], f))
            load[f] += size
            out.append(f)
    return out


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=8), st.integers(2, 6))
def test_turns_are_those_of_the_greedy_rule(counts, folds):
    sizes = sorted(counts.items(), reverse=True)
    turns, got = S.greedy_turns(sizes, folds), []
    for size, groups in sizes:
        own = [(first, turn) for s, first, turn in turns if s == size]
        assert len(own) <= folds + 1
        for rank in range(groups):
            first, turn = [o for o in own if o[0] <= rank][-1]
            got.append(turn[(rank - first) % len(turn)])
    assert got == greedy(sizes, folds)


def test_turns_of_a_billion_groups_are_few():
    turns = S.greedy_turns([(10**7, 1), (3, 10**9), (1, 10**9)], 5)
    assert len(turns) <= 12


def test_skewed_shots_go_to_the_lightest_fold(spark):
    sizes = [200, 90, 90, 41, *[7] * 30, *[2] * 50, *[1] * 75]
    df = spark.createDataFrame([(s,) for s, n in enumerate(sizes) for _ in range(n)] + [(None,)] * 3, "shot_id int")
    got = S.shot_folds(df, folds=5).groupBy("shot_id", "fold").count().collect()
    loads = {f: sum(r["count"] for r in got if r.fold == f) for f in range(5)}
    want = greedy([(n, sizes.count(n)) for n in sorted(set(sizes), reverse=True)], 5)
    by_size = sorted(sizes, reverse=True)
    assert loads == {f: sum(n for n, g in zip(by_size, want) if g == f) for f in range(5)}
    h = {r.id: r.h for r in spark.range(len(sizes)).select("id", S.hash48(F.col("id").cast("int")).alias("h")).collect()}
    order = sorted(range(len(sizes)), key=lambda s: (-sizes[s], h[s]))
    assert {r.shot_id: r.fold for r in got if r.shot_id is not None} == dict(zip(order, want))
    assert [r.fold for r in got if r.shot_id is None] == [None]


def test_rank_is_the_global_rank(spark):
    df = spark.range(500)
    got = {r.id: r.rank for r in S.with_rank(df, F.col("id"), "rank", size=F.col("id") % 3).collect()}
    h = {r.id: r.h for r in df.select("id", S.hash48(F.col("id")).alias("h")).collect()}
    want = {i: n for n, i in enumerate(sorted(h, key=lambda i: (-(i % 3), h[i])))}
    assert got == want
    plan = S.with_rank(df, F.col("id"), "rank")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # one row for each hash range


def test_holdout_sizes(spark):
    assert S.holdout_size(15) == 3 and S.holdout_size(100) == 20
    with pytest.raises(ValueError, match="trustworthy holdout"):
        S.holdout_size(14)
    df = spark.range(101)
    assert S.random_holdout(df, F.col("id")).where("is_test").count() == 21
    assert [r["count"] for r in S.random_folds(df, F.col("id")).groupBy("fold").count().orderBy("fold").collect()] == [21, 20, 20, 20, 20]
    shots = spark.range(100).withColumn("shot_id", F.col("id") % 10)
    split = S.shot_holdout(shots)
    assert split.where("is_test").select("shot_id").distinct().count() == 2
    assert split.groupBy("shot_id").agg(F.count_distinct("is_test").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError, match="unique shot_id"):
        S.shot_holdout(shots.withColumn("shot_id", F.col("id") % 4))


def test_training_guards(spark):
    df = synthetic_shots(spark, 60)
    S.require_trainable(df, ["kappa"])
    with pytest.raises(ValueError, match="trustworthy holdout"):
        S.require_trainable(df.limit(1), ["kappa"])
    with pytest.raises(ValueError, match="shot_id"):
        S.require_trainable(df.withColumn("shot_id", F.lit(17)), ["kappa"])
    with pytest.raises(ValueError, match="distinct values"):
        S.require_trainable(df.withColumn(C.TARGET, F.lit(1.0)), ["kappa"])
    with pytest.raises(ValueError, match="features"):
        S.require_trainable(df, [])


def test_metrics(spark):
    y, p = [1.0, 2.0, 3.0, 10.0], [1.5, 2.0, 2.0, 8.0]
    df = spark.createDataFrame(list(zip(y, p)), f"{M.ACTUAL} double, {M.PREDICTED} double")
    got = M.compute(df, "test")
    assert got["mae"] == pytest.approx(3.5 / 4) and got["rmse"] == pytest.approx(math.sqrt(5.25 / 4))
    mean = statistics.mean(y)
    assert got["r2"] == pytest.approx(1 - 5.25 / sum((v - mean) ** 2 for v in y))
    assert got["high_yield_count"] == 1 and got["high_yield_mae"] == 2.0
    assert M.high_yield(df, M.ACTUAL).first().high_yield_threshold == pytest.approx(7.9)
    with pytest.raises(ValueError, match="distinct"):
        M.compute(df.limit(1), "test")
    with pytest.raises(ValueError, match="finite"):
        M.compute(df.withColumn(M.PREDICTED, F.lit(float("nan"))), "test")


def test_imputer_takes_the_midpoint(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None), (None, None)], "a double, b double")
    values = L.medians(df, ["a", "b"])
    assert values == {"a": 2.5, "b": None}
    assert L.impute(df, values).where("a = 2.5").count() == 1


def test_baseline_refit_uses_all_rows(spark, tmp_path):
    rows = [(1e20, 15.0, 1.0 + i / 10, float(i + 1)) for i in range(15)]
    df = spark.createDataFrame(rows, "fuel_density_m3 double, temperature_keV double, confinement_time_s double, neutron_yield double")
    source = sinks.write_table(df, str(tmp_path / "in.parquet"))
    out = train(spark, source, str(tmp_path / "out"), families={"baseline": L.fit_baseline})
    assert out["metadata"]["saved_model"]["row_count"] == 15 and out["saved_model_fit_scope"] == "full_prepared_dataset"
    model = sinks.read_model(spark, out["paths"]["model"])
    assert L.predict(model, df).first()[M.PREDICTED] == pytest.approx(8.0)


def test_train_and_score_end_to_end(spark, tmp_path):
    out = train(spark, None, str(tmp_path / "run"), allow_synthetic=True, synthetic_rows=180, families=TINY)
    doc = sinks.read_document(spark, out["paths"]["metadata"])
    assert doc["dataset_source"]["kind"] == "synthetic_generated" and doc["dataset_source"]["synthetic_data_used"]
    assert doc["best_model_name"] in TINY and "R_m" in doc["feature_defaults"]
    metrics = spark.read.parquet(out["paths"]["metrics"]).collect()
    assert {r.model for r in metrics} == set(TINY)
    assert spark.read.parquet(out["paths"]["predictions"]).count() == doc["test_row_count"]
    assert spark.read.parquet(out["paths"]["mismatches"]).count() == out["flagged_case_count"]
    requests = spark.createDataFrame([("a", 1e20, 15.0, "keV", 3.0, None), ("b", 1e20, 15000.0, "eV", 3.0, 0.9)], "id string, fuel_density_m3 double, temperature double, temperature_unit string, confinement_time_s double, fuel_purity double")
    got = {r.id: r for r in score_requests(requests, out["paths"]["model"], out["paths"]["metadata"]).collect()}
    assert all(r.predicted_neutron_yield > 0 and math.isfinite(r.predicted_neutron_yield) and r.status == "IGNITION REACHED" and r.broken == [] for r in got.values())
    bad = requests.withColumn("confinement_time_s", F.lit(-1.0))
    with pytest.raises(ValueError, match="confinement_time_s"):
        score_requests(bad, "/nowhere", "/nowhere")
    with pytest.raises(FileNotFoundError, match="Model"):
        score_requests(requests, "/nowhere", "/nowhere")
    listed = score_requests(bad, out["paths"]["model"], out["paths"]["metadata"], strict=False).collect()
    assert all(r.predicted_neutron_yield is None and r.broken for r in listed)
    assert isinstance(sinks.read_model(spark, out["paths"]["model"]), PipelineModel)


def test_a_run_that_dies_leaves_the_published_one(spark, tmp_path, monkeypatch):
    rows = [(1e20, 15.0, 1.0 + i / 10, float(i + 1)) for i in range(15)]
    df = spark.createDataFrame(rows, "fuel_density_m3 double, temperature_keV double, confinement_time_s double, neutron_yield double")
    source, out = sinks.write_table(df, str(tmp_path / "in.parquet")), str(tmp_path / "out")
    with pytest.raises(FileNotFoundError, match="published"):
        sinks.published(spark, out)
    first = train(spark, source, out, families={"baseline": L.fit_baseline})
    assert sinks.published(spark, out, verify=True) == first["paths"]
    request = df.drop("neutron_yield").withColumn("id", F.lit(1))
    before = score_published(request, out, row_key=["id"]).select("predicted_neutron_yield").collect()

    higher = sinks.write_table(df.withColumn("neutron_yield", F.col("neutron_yield") * 5), str(tmp_path / "in2.parquet"))
    for broken in ("write_model", "write_document", "publish"):  # dies before the second, the last, and the very last step
        with monkeypatch.context() as m:
            m.setattr(sinks, broken, lambda *a, **b: (_ for _ in ()).throw(OSError("killed")))
            with pytest.raises(OSError, match="killed"):
                train(spark, higher, out, families={"baseline": L.fit_baseline})
        assert sinks.published(spark, out, verify=True) == first["paths"]
        assert score_published(request, out, row_key=["id"]).select("predicted_neutron_yield").collect() == before
    second = train(spark, higher, out, families={"baseline": L.fit_baseline})
    assert sinks.published(spark, out, verify=True) == second["paths"] != first["paths"]
    assert score_published(request, out, row_key=["id"]).first()["predicted_neutron_yield"] > before[0][0]
    sinks.write_document(spark, {"other": 1}, second["paths"]["metadata"])
    with pytest.raises(ValueError, match="changed.*metadata"):
        sinks.published(spark, out, verify=True)


@pytest.mark.parametrize("change", [{"confinement_time_s": -1.0}, {"pressure_Pa": -1.0}, {"ne_20": 1.25}])
def test_scoring_rejects(spark, change):
    row = {"fuel_density_m3": 1e20, "temperature_keV": 15.0, "confinement_time_s": 3.0, "pressure_Pa": 1e5, "ne_20": 1.0} | change
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    assert R.validated(df).first().broken
    with pytest.raises(ValueError, match=next(iter(change))):
        R.require_valid_requests(df, ["temperature_keV"])


def test_empty_tables_keep_their_columns(spark, tmp_path):
    df = spark.createDataFrame([], "a int, b string")
    assert spark.read.parquet(sinks.write_table(df, str(tmp_path / "e"))).columns == ["a", "b"]


def test_scoring_a_stream(spark, tmp_path):
    df = synthetic_shots(spark, 40)
    model, defaults = L.fit_baseline(df, []), R.feature_defaults(df, list(C.BASE_FEATURES))
    source = str(tmp_path / "stream")
    df.select(*C.REQUIRED_INPUTS).write.parquet(source)
    stream = spark.readStream.schema(df.select(*C.REQUIRED_INPUTS).schema).parquet(source)
    q = score_stream(stream, model, defaults, "baseline").writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").where("predicted_neutron_yield > 0 and size(broken) = 0").count() == 40


def test_folds_that_cannot_be_trusted_raise(spark):
    rows = spark.range(40).select(F.col("id").alias("shot_id"), (F.col("id") % 4).cast("int").alias("fold"), F.when(F.col("id") % 4 == 3, 5.0).otherwise(F.col("id") * 1e9).alias(C.TARGET))
    with pytest.raises(ValueError, match="fold 3.*distinct"):
        L.cross_validate(rows, [], L.fit_baseline, 4, "baseline")


def test_hash_ranges_follow_the_rows(spark):
    assert S.hash_ranges(10) == 256 and S.hash_ranges(10**10) == 10_000
    df = spark.range(500).select("id", F.col("id").cast("string").alias("key"))
    ranks = [{r.id: r.n for r in S.with_rank(df, F.col("key"), "n", ranges=k).collect()} for k in (1, 256, 9973)]
    assert ranks[0] == ranks[1] == ranks[2] and sorted(ranks[0].values()) == list(range(500))


def test_folds_of_summed_shots_are_those_of_their_rows(spark):
    rows = spark.createDataFrame([(i, j) for i in range(40) for j in range(1 + i * 7 % 11)], "shot_id long, at long")
    want = {(r.shot_id, r.fold) for r in S.shot_folds(rows, folds=5).collect()}
    summed = rows.groupBy("shot_id").agg(F.count("*").alias("n"))
    assert {(r.shot_id, r.fold) for r in S.shot_folds(summed, folds=5, rows=F.col("n")).collect()} == want


def test_held_out_shots_are_told_by_a_threshold(spark):
    df = spark.range(600).select(F.when(F.col("id") % 50 < 49, F.col("id") % 97).alias("shot_id"), "id")
    split = S.shot_holdout(df)
    h = {r[0]: r[1] for r in df.where("shot_id is not null").select("shot_id", S.hash48(F.col("shot_id"))).distinct().collect()}
    first = sorted(h, key=lambda s: (h[s], str(s)))[: math.ceil(len(h) * C.TEST_SHARE)]
    assert {r.id for r in split.where("is_test").collect()} == {r.id for r in df.collect() if r.shot_id in first}
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan  # rows stay where they are
