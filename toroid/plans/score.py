"""Scoring of a request table with a saved model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from toroid.operators.scoring import require_valid_requests, score
from toroid.sources import sinks


def score_requests(requests: DataFrame, model_path: str, metadata_path: str, *, row_key: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Predictions and Lawson status for each request. strict: a request that breaks a rule is an error, raised before the
    model is loaded; else it is returned with the rules it breaks."""
    spark = requests.sparkSession
    if strict:
        require_valid_requests(requests, row_key or requests.columns[:1])
    model, document = sinks.read_model(spark, model_path), sinks.read_document(spark, metadata_path)
    return score(requests, model, document["feature_defaults"], document["best_model_name"])


def score_published(requests: DataFrame, out_dir: str, **options) -> DataFrame:
    """Scoring with the model and metadata of the run that out_dir's manifest names, both of one run."""
    parts = sinks.published(requests.sparkSession, out_dir)
    return score_requests(requests, parts["model"], parts["metadata"], **options)
