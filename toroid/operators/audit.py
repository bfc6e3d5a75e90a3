"""A profile of a raw table: shape, duplicates, nulls, types, target distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toroid import config as C
from toroid.functions.numbers import to_number
from toroid.operators.quantiles import quantile
from toroid.operators.repeats import repeat_counts


def _count_nulls(df: DataFrame) -> list[Column]:
    return [F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, nulls), one pass over the table."""
    counts = df.agg(*_count_nulls(df))
    return counts.unpivot([], counts.columns, "column_name", "nulls") if df.columns else df.sparkSession.createDataFrame([], "column_name string, nulls long")


def duplicates(df: DataFrame) -> DataFrame:
    """One row: how many rows equal an earlier row, and in how many groups."""
    return repeat_counts(df)


def profile(df: DataFrame) -> DataFrame:
    """(column_name, dtype, nulls, row_count, column_count)."""
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    counts = df.agg(F.count("*").alias("_rows"), *_count_nulls(df))
    long = counts.unpivot(["_rows"], [c for c in counts.columns if c != "_rows"], "column_name", "nulls")
    return long.select("column_name", F.element_at(types, F.col("column_name")).alias("dtype"), "nulls", F.col("_rows").alias("row_count"), F.lit(len(df.columns)).alias("column_count"))


def target_distribution(df: DataFrame, target: str = C.TARGET, exact: bool = True) -> DataFrame:
    """One row: min, median, mean, max of the target, missing values left out."""
    y = to_number(F.col(target), df.schema[target].dataType)
    return df.agg(F.min(y).alias("target_min"), F.lit(quantile(df, y, 0.5, exact)).cast("double").alias("target_median"), F.avg(y).alias("target_mean"), F.max(y).alias("target_max"))


def audit(df: DataFrame, canonical: bool = False, exact: bool = True) -> dict:
    """The whole profile as a document. The target is described only if it has its own name (or canonical=True after mapping)."""
    if canonical:
        from toroid.operators.normalise import column_mapping, rename

        df = rename(df, column_mapping(df.columns))
    counts = df.agg(F.count("*").alias("_rows"), *_count_nulls(df)).first().asDict()
    out = {"shape": [counts.pop("_rows"), len(df.columns)], "duplicates": duplicates(df).first()["duplicates"], "null_counts": counts, "dtypes": dict(df.dtypes)}
    if C.TARGET in df.columns:
        found = target_distribution(df, exact=exact).first()
        out["target_distribution"] = {k.removeprefix("target_"): v for k, v in found.asDict().items()}
    return out
