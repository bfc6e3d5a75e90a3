import pytest
from pyspark.sql import functions as F

from toroid import config as C
from toroid.operators import validate as V
from toroid.operators.audit import audit, duplicates, null_counts
from toroid.operators.features import engineer
from toroid.operators import shots
from toroid.operators.shots import collapse, pre_window
from toroid.functions import physics as P

GOOD = dict(fuel_density_m3=1e20, temperature_keV=15.0, confinement_time_s=4.0, neutron_yield=1.0)


def table(spark, *rows):
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], ", ".join(f"{k} {'string' if k == 'row' else 'double'}" for k in names))


@pytest.mark.parametrize(("n", "kept"), [(1, 1), (3, 3), (5, 4), (6, 5), (10, 8)])
def test_leading_window(spark, n, kept):
    df = spark.createDataFrame([(7, float(i)) for i in range(n)], "shot_id int, time_s double")
    rows = pre_window(df).where("in_pre_window").collect()
    assert sorted(r.time_s for r in rows) == [float(i) for i in range(kept)]


def test_collapse_kinds(spark):
    rows = [(1, 0.0, "b", True, "3", 5.0), (1, 1.0, "a", False, "4", 9.0), (1, 2.0, "a", True, None, 1.0), (1, 3.0, "b", True, "5", 2.0), (1, 4.0, "z", True, "99", 100.0), (None, 0.0, "x", True, "1", 3.0)]
    df = spark.createDataFrame(rows, "shot_id int, time_s double, regime string, flag boolean, note string, neutron_yield double")
    out = collapse(df).collect()
    assert len(out) == 1
    r = out[0]
    assert r.regime == "a"  # tie of a and b: the smaller; z is past the window
    assert r.note == 4.0 and r.flag == 1.0 and r.neutron_yield == 100.0 and r.time_s == 1.5


def _shots(spark):
    """Shots of 1 to 12 rows, three giant ones (one of equal times, one of missing times), rows without a shot."""
    small = [(s, float(t % 5), t, f"r{t % 3}", "7.5", float(s * t % 11), None if t % 4 else 2.0, float(t)) for s in range(30) for t in range(1 + s % 12)]
    rows = small + [(100, float(t % 977), t, f"r{t * t % 5}", str(t % 50), float(t * 7919 % 1000), 3.0, float(t)) for t in range(4001)]
    rows += [(101, 1.0, t, "b" if t % 2 else "a", "1", float(t), None, 5.0) for t in range(2500)] + [(102, None, t, None, "2", float(-t), 1.0, None) for t in range(1500)]
    rows += [(None, 0.0, t, "n", "3", 1.0, 1.0, 9.0) for t in range(1200)]
    return spark.createDataFrame(rows, "shot_id int, time_s double, k int, regime string, note string, x double, y double, neutron_yield double").repartition(5)


def test_giant_shots_equal_usual_ones(spark):
    df = _shots(spark)
    usual, dealt = (pre_window(df, ("k",), giant=g, cell=300).collect() for g in (10**9, 1000))
    assert sorted(map(repr, usual)) == sorted(map(repr, dealt))
    usual, dealt = ({r.shot_id: r for r in collapse(df, ("k",), giant=g, cell=300).collect()} for g in (10**9, 1000))
    assert len(usual) == 33 and usual == dealt


def test_cells_of_a_giant_shot_are_bounded(spark):
    df = spark.range(40_000).select(F.lit(1).alias("shot_id"), F.floor(F.col("id") / 20_000).cast("double").alias("time_s"), F.col("id").alias("k"), F.lit("same").alias("regime"), (F.col("id") % 3).cast("double").alias("x"))
    order = [F.col(c) for c in ("shot_id", "time_s", "k")]
    cells = [r["count"] for r in shots._in_cells(df, order, 1000).groupBy("_cell").count().collect()]
    assert max(cells) <= 3000 and len(cells) >= 20
    few = shots._counts(df, {"x": F.col("x")}, "shot_id")
    assert few.count() == 3  # what a median is searched in: different values, not rows
    assert collapse(df, ("k",), giant=1000, cell=1000).collect() == collapse(df, ("k",)).collect()


def test_one_exchange(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0)], "shot_id int, time_s double, neutron_yield double")
    plan = collapse(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_bad_optional_inputs(spark):
    df = table(spark, GOOD | {"pressure_Pa": -1.0, "Ip_MA": 3.0, "row": "a"}, GOOD | {"pressure_Pa": 1.0, "Ip_MA": 0.0, "row": "b"})
    with pytest.raises(ValueError, match=r"pressure_Pa rows \[a\].*Ip_MA rows \[b\]"):
        V.require_valid(df, ["row"])


def test_density_tolerance(spark):
    df = table(spark, GOOD | {"ne_20": 1.5, "row": "a"}, GOOD | {"ne_20": 1.0005, "row": "b"}, GOOD | {"ne_20": None, "row": "c"})
    with pytest.raises(ValueError, match=r"ne_20 rows \[a\] must be consistent"):
        V.require_valid(df, ["row"])
    found = V.violations(df, V.checks(df.columns), ["row"]).collect()
    assert [tuple(r) for r in found] == [("a", "ne_20", "consistency")]


def test_missing_infinite_geometry_and_many_rows(spark):
    bad = [GOOD | {"confinement_time_s": None, "row": f"{i}"} for i in range(7)]
    df = table(spark, *bad, GOOD | {"R_m": 1.0, "a_m": 1.0, "row": "g"}, GOOD | {"temperature_keV": float("inf"), "row": "i"})
    with pytest.raises(ValueError) as e:
        V.require_valid(df, ["row"])
    text = str(e.value)
    assert "confinement_time_s rows [0, 1, 2, 3, 4, ...]" in text and "a_m rows [g]" in text and "temperature_keV rows [i]" in text


def test_unknown_and_absent_columns(spark):
    with pytest.raises(KeyError):
        V.checks(["x"], ("x",), ())
    with pytest.raises(ValueError, match="Missing required columns"):
        V.checks(["temperature_keV"])


def test_zero_yield_and_pure_fuel_are_fine(spark):
    V.require_valid(table(spark, GOOD | {"neutron_yield": 0.0, "fuel_purity": 1.0, "row": "a"}, GOOD | {"fuel_purity": 0.0, "row": "b"}), ["row"])


def test_lawson_case(spark):
    r = engineer(table(spark, GOOD)).withColumn("status", P.lawson_status(F.col("lawson_ratio"))).first()
    assert r.triple_product == pytest.approx(6e21) and r.lawson_ratio == pytest.approx(2.0) and r.status == "IGNITION REACHED"


def test_features_keep_missing(spark):
    r = engineer(table(spark, GOOD | {"neutron_yield": None, "fuel_purity": None, **{c: 1.0 for c in ("Ip_MA", "Bt_T", "R_m", "kappa", "Pin_MW")}, "a_m": 0.0}, GOOD)).orderBy(F.col("fuel_purity").desc()).first()
    assert r.log_neutron_yield is None and r.purity_weighted_density is None and r.tau_E_ipb98_s is None
    assert engineer(table(spark, GOOD)).first().purity_weighted_density == 1e20


def test_ne20_derived(spark):
    df = spark.createDataFrame([(1e20, None), (1e20, 1.0005), (1e20, 1.25), (None, 2.0)], "d double, n double")
    assert [r[0] for r in df.select(V.derive_ne20(F.col("d"), F.col("n"))).collect()] == [1.0, 1.0, None, 2.0]


def test_audit(spark):
    df = spark.createDataFrame([(1, None, 2.0), (1, None, 2.0), (2, "x", None)], "a int, b string, neutron_yield double")
    doc = audit(df)
    assert doc["shape"] == [3, 3] and doc["duplicates"] == 1 and doc["null_counts"] == {"a": 0, "b": 2, "neutron_yield": 1}
    assert doc["target_distribution"] == {"min": 2.0, "median": 2.0, "mean": 2.0, "max": 2.0}
    assert "target_distribution" not in audit(df.withColumnRenamed("neutron_yield", "yield"))
    assert "target_distribution" in audit(df.withColumnRenamed("neutron_yield", "yield"), canonical=True)
    assert duplicates(df.limit(0)).first().duplicates == 0
    assert {r.column_name: r.nulls for r in null_counts(df).collect()} == {"a": 0, "b": 2, "neutron_yield": 1}


def test_rule_table_is_complete():
    assert len(C.RULES) == 15 and len(C.ALIASES) == 24
