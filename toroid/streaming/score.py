"""The row-by-row steps on a stream: canonical columns, rule report and scoring.

Steps that need a whole table or a whole shot (dedup, fail-fast validation, collapsing) stay with batches.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from toroid.operators import validate as V
from toroid.operators.normalise import canonical
from toroid.operators.scoring import score


def canonical_stream(stream: DataFrame) -> DataFrame:
    return canonical(stream)[0]


def violation_stream(stream: DataFrame, row_key: list[str], required: tuple[str, ...], optional: tuple[str, ...] = ()) -> DataFrame:
    """(row key, field, rule) as rows arrive."""
    return V.violations(stream, V.checks(stream.columns, required, optional), row_key)


def score_stream(stream: DataFrame, model: PipelineModel, defaults: dict[str, float | None], model_name: str) -> DataFrame:
    """Predictions and status as requests arrive."""
    return score(stream, model, defaults, model_name)
