"""From a source to a prepared table: audit, canonical columns, one row for each shot, dedup, validation, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from toroid import config as C
from toroid.operators import validate as V
from toroid.operators.audit import audit
from toroid.operators.features import engineer
from toroid.operators.normalise import canonical, feature_columns
from toroid.operators.repeats import without_repeats
from toroid.operators.shots import aggregate_shots
from toroid.sources.samples import read_raw, read_samples, resolve_source, synthetic_shots
from toroid.sources.shared import materialise


def clean(df: DataFrame) -> DataFrame:
    """Without rows that equal another in all columns."""
    return without_repeats(df)


def prepare_frame(df: DataFrame, ties: tuple[str, ...] = (), row_key: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The prepared form of a raw table and the column mapping; raises if a row breaks a rule.

    Shots are stored before they are cleaned, which reads them twice, and the cleaned table too, since both the validation and
    everything later read it.
    """
    rows, mapping = canonical(df)
    stored = materialise(clean(materialise(aggregate_shots(rows, ties))))
    key = row_key or [C.SHOT] if C.SHOT in stored.columns else row_key or list(C.REQUIRED_INPUTS)
    V.require_valid(stored, [k for k in key if k in stored.columns])
    return engineer(stored), mapping


def prepare(spark: SparkSession, path: str | None = None, *, allow_synthetic: bool = False, synthetic_rows: int = 600, ties: tuple[str, ...] = (), exact: bool = True) -> C.Prepared:
    """A prepared table from a path, or from synthetic shots if that is allowed."""
    source, kind = resolve_source(path, allow_synthetic)
    samples, mapping = read_samples(spark, source) if source else (synthetic_shots(spark, synthetic_rows), {})
    profile = audit(read_raw(spark, source) if source else samples, exact=exact)  # of the table as it came
    frame, own = prepare_frame(samples, ties)
    return C.Prepared(frame, profile, mapping or own, feature_columns(frame.columns), kind, path)
