"""Training: guards, leakage-safe holdout and folds, comparison of families, report, refit on all rows, save."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toroid import config as C
from toroid.operators import metrics as M
from toroid.operators import models as L
from toroid.operators import splits as S
from toroid.operators.scoring import feature_defaults
from toroid.plans.prepare import prepare
from toroid.sources import sinks
from toroid.sources.shared import materialise


def row_key(df: DataFrame) -> F.Column:
    """A key of a row by its content; rows are distinct after cleaning, and a 128-bit digest tells them apart."""
    return F.md5(F.to_json(F.struct(*df.columns)))


def train(spark: SparkSession, path: str | None, out_dir: str, *, allow_synthetic: bool = False, families: dict[str, L.Family] | None = None, exact: bool = True, **prepare_options) -> dict:
    """Prepare, compare, choose by cross-validation, report on the holdout, refit the winner on all rows and save it.

    All parts go into a folder of this run; out_dir's manifest names it once the run is complete (see sinks.published).
    """
    top, out_dir = out_dir, sinks.new_run(out_dir)
    prepared = prepare(spark, path, allow_synthetic=allow_synthetic, exact=exact, **prepare_options)
    features = prepared.features
    table_path = sinks.write_table(prepared.frame, f"{out_dir}/prepared")
    df = spark.read.parquet(table_path)
    S.require_trainable(df, features)
    split, strategy = S.holdout(df, row_key(df))
    split = materialise(split)
    held = split.where("is_test").drop("is_test")
    fit_rows, fold_strategy, folds = S.with_folds(split.where("not is_test").drop("is_test"), strategy, row_key(df))
    fit_rows = materialise(fit_rows)
    families = families or L.registry(exact=exact)
    values = L.fold_medians(fit_rows, features, folds, exact)  # of all families
    rows, holdouts, fitted = [], {}, {}
    for name, fit in families.items():
        own = L.cross_validate(fit_rows, features, fit, folds, name, values=values).first().asDict()
        fitted[name] = fit(fit_rows, features)
        holdouts[name] = materialise(L.predict(fitted[name], held))  # scored once for all metrics
        frame = M.prediction_frame(holdouts[name], features)
        rows.append(own | {f"holdout_{k}": v for k, v in M.compute(frame, f"{name} holdout", exact=exact).items()})
    order = ["model", *(k for k in rows[0] if k != "model")]
    metrics = L.ranked(spark.createDataFrame([{k: r[k] for k in order} for r in rows]).select(*order))
    best = metrics.first()["model"]
    predictions = M.prediction_frame(holdouts[best], features)
    flagged = M.physics_mismatches(predictions, exact=exact)
    importance = L.importance(fitted.get("random_forest", fitted[best]), features)
    ranks = spark.createDataFrame(importance, "feature string, importance double")
    paths = {
        "metrics": sinks.write_table(metrics, f"{out_dir}/metrics"), "predictions": sinks.write_table(predictions, f"{out_dir}/predictions"),
        "mismatches": sinks.write_table(flagged, f"{out_dir}/mismatches"), "importance": sinks.write_table(ranks.orderBy(F.desc("importance"), "feature"), f"{out_dir}/importance"),
        "model": sinks.write_model(families[best](df, features), f"{out_dir}/model"), "prepared": table_path,
    }
    n, n_train, n_test = df.count(), fit_rows.count(), held.count()
    document = {
        "feature_columns": features, "best_model_name": best, "split_strategy": strategy, "cv_strategy": fold_strategy, "cv_fold_count": folds, "train_row_count": n_train, "test_row_count": n_test,
        "full_data_row_count": n, "audit_summary": prepared.audit, "column_mapping": prepared.mapping,
        "dataset_source": {"kind": prepared.source_kind, "synthetic_data_used": prepared.source_kind == "synthetic_generated", "requested_dataset_path": prepared.requested},
        "model_selection": {"basis": "cross_validation", "primary_metric": "cv_rmse_mean", "tie_breakers": ["cv_mae_mean", "model"], "selected_model_name": best, "candidate_models": [r["model"] for r in metrics.collect()]},
        "holdout_evaluation": {"split_strategy": strategy, "cv_strategy": fold_strategy, "cv_fold_count": folds, "train_row_count": n_train, "test_row_count": n_test, "selected_model_fit_scope": "training_split_only", **{f"{k}_path": paths[k] for k in ("metrics", "predictions", "mismatches")}},
        "saved_model": {"path": paths["model"], "model_name": best, "fit_scope": "full_prepared_dataset", "row_count": n},
        "feature_defaults": feature_defaults(df, features, exact),
    }
    paths["metadata"] = sinks.write_document(spark, document, f"{out_dir}/metadata")
    sinks.publish(spark, top, out_dir, paths)
    return {"best_model_name": best, "flagged_case_count": flagged.count(), "dataset_source_kind": prepared.source_kind, "saved_model_fit_scope": "full_prepared_dataset", "paths": paths, "metadata": document}
