import math

import pytest
from pyspark.sql import functions as F

from toroid.operators import repeats as R

ROWS = [(1.0, "a", None), (1.0, "a", None), (1.0, None, "a"), (math.nan, "", ""), (math.nan, "", ""), (-0.0, "z", "z"), (0.0, "z", "z"), (None, None, None), (None, None, None), (None, None, None), (2.0, "b", "c")]


def slow(df):
    groups = df.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count(F.lit(1)).alias("rows")).collect()
    return sum(r["rows"] - 1 for r in groups), sum(r["rows"] > 1 for r in groups)


@pytest.mark.parametrize("bits", [64, 1])
@pytest.mark.parametrize("most", [R.BROADCAST_DIGESTS, 0])
def test_counts_and_rows_are_those_of_whole_rows(spark, monkeypatch, bits, most):
    """Also where digests collide (two bits), and where repeated digests are too many to be broadcast."""
    monkeypatch.setattr(R, "BROADCAST_DIGESTS", most)
    df = spark.createDataFrame(ROWS, "x double, `b.c` string, count string").repartition(3)
    assert tuple(R.repeat_counts(df, bits).first()) == slow(df) == (5, 4)
    got = R.without_repeats(df, bits)
    assert got.columns == df.columns and got.count() == 6
    assert tuple(R.repeat_counts(got, bits).first()) == (0, 0) and df.exceptAll(got).count() == 5


def test_no_rows_and_no_columns(spark):
    empty = spark.createDataFrame([], "x int, y string")
    assert tuple(R.repeat_counts(empty).first()) == (0, 0) and R.without_repeats(empty).collect() == []
    assert tuple(R.repeat_counts(spark.range(4).select()).first()) == (3, 1)


def test_single_rows_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(5000).select("id", F.repeat(F.lit("wide "), 200).alias("text")).write.parquet(path)
    single, _ = R.split_repeats(spark.read.parquet(path))
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert single.count() == 5000 and "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan
