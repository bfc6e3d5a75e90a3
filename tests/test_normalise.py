import math

import pytest
from pyspark.sql import functions as F

from toroid.functions import physics as P
from toroid.operators import normalise as N
from toroid.operators.shots import aggregate_shots
from toroid.operators.audit import audit
from toroid.plans.prepare import prepare, prepare_frame
from toroid.sources.samples import read_raw, read_samples, resolve_source, surplus_rows, synthetic_shots


def aliased(spark):
    rows = [(101, t, 1e20, e, 0.8, y, 0.9, 50.0, 1e5, 10.0, 5.0, 3.0, 1.0, 1.7, 40.0) for t, e, y in ((0, 11000, 50.0), (5, 12000, 200.0), (10, 13000, 120.0))]
    rows += [(202, t, 1.2e20, e, 0.9, y, 0.92, 60.0, 2e5, 11.0, 5.2, 3.1, 1.1, 1.8, 42.0) for t, e, y in ((0, 16000, 60.0), (5, 17000, 65.0), (10, 18000, 70.0))]
    return spark.createDataFrame(rows, "experiment_id int, time_ms int, density_m3 double, temperature_eV int, tau_E double, yield double, fuel_mix_purity double, energy_input double, pressure double, plasma_current_MA double, magnetic_field_T double, major_radius_m double, minor_radius_m double, elongation double, power_input_MW double")


def test_aliases_and_shots(spark):
    frame, mapping = prepare_frame(aliased(spark))
    assert mapping["experiment_id"] == "shot_id" and mapping["tau_E"] == "confinement_time_s"
    rows = {r.shot_id: r for r in frame.collect()}
    assert len(rows) == 2
    assert rows[101].temperature_keV == 12.0 and rows[101].neutron_yield == 200.0
    assert rows[202].temperature_keV == 17.0 and rows[202].neutron_yield == 70.0
    assert rows[101].tau_E_ipb98_s > 0


def test_first_spelling_wins_and_case_matters():
    assert N.column_mapping(["tau", "tau_e", "tau_E"]) == {"tau_E": "confinement_time_s"}
    assert N.column_mapping(["Shot_ID"]) == {}


def test_names_that_differ_in_case(spark, tmp_path):
    (tmp_path / "a.csv").write_text("shot,tau_E,tau_e,temp_kev,density,yield\n1,0.5,0.9,NA,1e20,7\n2, 0.6 ,0.9,12,1.5d,nan\n")
    df, mapping = read_samples(spark, str(tmp_path / "a.csv"))
    assert mapping["tau_E"] == "confinement_time_s" and "tau_e" in df.columns
    rows = sorted(N.canonical(df)[0].collect(), key=lambda r: r.shot_id)
    assert rows[0].confinement_time_s == 0.5 and rows[0].temperature_keV is None and rows[0].fuel_density_m3 == 1e20
    assert rows[1].confinement_time_s == 0.6 and rows[1].fuel_density_m3 is None and rows[1].neutron_yield is None


def test_files_with_other_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("temperature_keV,neutron_yield\n10,5\n11,6\n")
    (tmp_path / "b.csv").write_text("neutron_yield,temperature_keV\n7,20\n")
    df, _ = read_samples(spark, str(tmp_path))
    assert sorted((r.temperature_keV, r.neutron_yield) for r in df.collect()) == [("10", "5"), ("11", "6"), ("20", "7")]
    (tmp_path / "c.csv").write_text("neutron_yield,temperature_keV,kappa\n7,20,1\n")
    with pytest.raises(ValueError, match="c.csv.*kappa"):
        read_samples(spark, str(tmp_path))


def test_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("temperature_keV,neutron_yield,kappa\n10,5\n11,6,1.5\n")
    assert [r.kappa for r in read_samples(spark, str(tmp_path))[0].orderBy("temperature_keV").collect()] == [None, "1.5"]
    for surplus in ("99", '""', "98,97"):
        (tmp_path / "b.csv").write_text(f"temperature_keV,neutron_yield,kappa\n12,7,1.6,{surplus}\n")
        with pytest.raises(Exception, match="more fields than the 3 columns"):
            read_samples(spark, str(tmp_path))[0].select("neutron_yield").collect()
    found = surplus_rows(spark, str(tmp_path)).collect()
    assert len(found) == 1 and found[0].file.endswith("b.csv") and found[0].fields == ["12", "7", "1.6", "98"]


def test_the_raw_table_is_audited(spark, tmp_path):
    lines = ["density_m3,temperature_eV,tau_E,yield,regime"] + [f"1e20,{12000 + i},{'NA' if i == 3 else 0.5},{i + 1},H" for i in range(20)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    found = audit(read_raw(spark, str(tmp_path / "a.csv")))
    assert found["shape"] == [20, 5] and found["null_counts"] == {"density_m3": 0, "temperature_eV": 0, "tau_E": 1, "yield": 0, "regime": 0}
    assert found["dtypes"] == {"density_m3": "double", "temperature_eV": "double", "tau_E": "double", "yield": "double", "regime": "string"}
    assert "target_distribution" not in found  # only a column of that very name is described
    (tmp_path / "b.csv").write_text("\n".join([lines[0].replace("yield", "neutron_yield"), *(line.replace("NA", "0.5") for line in lines[1:])]) + "\n")
    prepared = prepare(spark, str(tmp_path / "b.csv"))
    assert "density_m3" in prepared.audit["dtypes"] and prepared.audit["target_distribution"]["median"] == 10.5
    assert prepared.mapping["density_m3"] == "fuel_density_m3" and prepared.frame.count() == 20


@pytest.mark.parametrize(("text", "number"), [("1.5d", None), (" 2.5 ", 2.5), ("inf", math.inf), ("-Infinity", -math.inf), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("", None), ("abc", None), ("nan", None), ("1_0", None), ("+7", 7.0), ("0x10", None)])
def test_coercion(spark, text, number):
    df = spark.createDataFrame([(text,)], "pressure_Pa string")
    assert N.coerce(df).first()[0] == number


def test_nan_becomes_null(spark):
    assert N.coerce(spark.createDataFrame([(float("nan"),)], "kappa double")).first()[0] is None


def test_temperature_precedence(spark):
    df = spark.createDataFrame([(1.0, 5000.0, None)], "temperature_keV double, temperature_eV double, temperature_K double")
    assert N.with_kev(df).first().temperature_keV == 1.0
    assert N.with_kev(df.drop("temperature_keV")).first().temperature_keV == 5.0
    k = spark.createDataFrame([(1.160451812e7,)], "temperature_K double")
    assert N.with_kev(k).first().temperature_keV == pytest.approx(1.0)
    with pytest.warns(UserWarning, match="keV"):
        assert N.with_kev(spark.createDataFrame([(3.0,)], "temperature double")).first().temperature_keV == 3.0
    with pytest.raises(ValueError, match="temperature"):
        N.with_kev(spark.createDataFrame([(3.0,)], "x double"))


def test_units(spark):
    df = spark.createDataFrame([(12500.0, "eV"), (12.5, " KEV "), (12.5 * 1.160451812e7, "k"), (-1.0, "keV"), (1.0, "F")], "v double, u string")
    got = [r[0] for r in df.select(P.to_kev(F.col("v"), F.col("u"))).collect()]
    assert got[:3] == pytest.approx([12.5, 12.5, 12.5]) and got[3:] == [None, None]
    with pytest.raises(Exception, match="unit must be"):
        df.select(P.to_kev(F.col("v"), F.col("u"), strict=True)).collect()


def test_unit_round_trips(spark):
    row = spark.range(1).select(
        P.kelvin_to_kev(P.kev_to_kelvin(F.lit(12.5))), P.kelvin_to_ev(P.ev_to_kelvin(F.lit(7.0))), P.ev_to_kev(P.kev_to_ev(F.lit(3.0))), P.ev_to_kelvin(F.lit(0.0)), P.ev_to_kelvin(F.lit(float("inf"))),
    ).first()
    assert list(row[:3]) == pytest.approx([12.5, 7.0, 3.0]) and row[3] is None and row[4] is None


def test_source_policy(spark):
    assert resolve_source("/x", False) == ("/x", "provided_path")
    assert resolve_source(None, True) == (None, "synthetic_generated")
    with pytest.raises(ValueError, match="dataset-path.*allow-synthetic"):
        resolve_source(None, False)


def test_synthetic_shots(spark):
    counts = {r.shot_id: r["count"] for r in synthetic_shots(spark, 10).groupBy("shot_id").count().collect()}
    assert counts == {0: 6, 1: 4}
    a, b = synthetic_shots(spark, 50), synthetic_shots(spark, 50).repartition(7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(ValueError):
        synthetic_shots(spark, 0)


def test_guard_leaves_single_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, 0.0, 6.0)], "shot_id int, time_s double, kappa double")
    assert aggregate_shots(df).collect() == df.collect()
