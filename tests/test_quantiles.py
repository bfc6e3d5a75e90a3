import math
import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from toroid.operators import quantiles as Q

NUMBERS = st.one_of(st.floats(allow_nan=False, allow_infinity=False), st.integers(-3, 3).map(float), st.none())


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(NUMBERS, min_size=1, max_size=60), st.sampled_from([0.0, 0.1, 0.5, 0.9, 1.0]))
def test_equals_interpolation_between_ranks(spark, values, share):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None)
    got = Q.quantile(df, "v", share)
    if not known:
        assert got is None
        return
    at = share * (len(known) - 1)
    low, part = known[math.floor(at)], at - math.floor(at)
    want = low if not part else (1 - part) * low + part * known[math.floor(at) + 1]
    assert got == want


def test_many_columns_skew_and_ties(spark):
    df = spark.range(20_000).select(F.pow(F.lit(10.0), F.col("id") / 1000 - 5).alias("heavy"), (F.col("id") % 2).cast("double").alias("two"), F.lit(7.0).alias("one"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") > 5, F.col("id").cast("double")).alias("some"))
    pdf = df.toPandas()
    got = Q.quantiles(df, {c: (F.col(c), q) for c, q in (("heavy", 0.9), ("two", 0.5), ("one", 0.5), ("none", 0.5), ("some", 0.25))})
    for c, q in (("heavy", 0.9), ("two", 0.5), ("one", 0.5), ("some", 0.25)):
        assert got[c] == pytest.approx(np.quantile(pdf[c].dropna(), q), rel=1e-12)
    assert got["none"] is None
    assert Q.quantile(df, "heavy", 0.5, exact=False) == pytest.approx(statistics.median(pdf["heavy"]), rel=0.01)


def test_infinite_values(spark):
    df = spark.createDataFrame([(-math.inf,), (1.0,), (2.0,), (math.inf,), (math.inf,)], "v double")
    assert [Q.quantile(df, "v", s) for s in (0.0, 0.25, 0.5, 0.75, 1.0)] == [-math.inf, 1.0, 2.0, math.inf, math.inf]
