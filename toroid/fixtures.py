"""Plasma samples derived from the lineitem table, in SQL that Spark and DuckDB read alike.

Exponent literals are doubles in both. k1..k4 identify a row and order equal times within a shot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from toroid.sources.shared import table

TIES = ("k1", "k2", "k3", "k4")
ROW_KEY = "concat(cast(shot_id as varchar(20)), ':', cast(k1 as varchar(20)), ':', cast(k2 as varchar(20)), ':', cast(k3 as varchar(20)), ':', cast(cast(round(k4 * 1e2) as bigint) as varchar(20)))"

SAMPLES = """
WITH b AS (
  SELECT l_orderkey AS shot_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    CAST(extract(year FROM l_shipdate)*372 + extract(month FROM l_shipdate)*31 + extract(day FROM l_shipdate) AS DOUBLE) AS time_s,
    l_returnflag AS regime,
    2e19 + l_quantity*6e18 AS fuel_density_m3,
    4e0 + (l_partkey % 25) AS temperature_keV,
    15e-2 + l_discount*5e1 AS confinement_time_s,
    72e-2 + l_tax*3e0 AS fuel_purity,
    l_extendedprice/5e2 AS energy_input_MJ,
    1e5*(1 + l_suppkey % 30) AS pressure_Pa,
    45e-1 + l_quantity*27e-2 AS Ip_MA,
    22e-1 + l_linenumber*7e-1 AS Bt_T,
    18e-1 + l_linenumber*6e-1 AS R_m,
    (18e-1 + l_linenumber*6e-1)*(24e-2 + l_discount*14e-1) AS a_m,
    145e-2 + l_tax*9e0 AS kappa,
    (2e19 + l_quantity*6e18)/1e20 AS ne_20,
    235e-2 + l_discount*3e0 AS M_amu,
    6e0 + l_extendedprice/1e3 AS Pin_MW,
    ((l_partkey*7919 + l_suppkey*104729) % 1000)*1e-3 - 5e-1 AS noise
  FROM {lineitem}),
s AS (SELECT *, 125e-1
    + 16e-1*ln(1e0 + fuel_density_m3*temperature_keV*confinement_time_s/3e21*1e1)
    + 35e-2*ln(1e0 + energy_input_MJ) + 25e-2*ln(1e0 + pressure_Pa/1e5)
    + 25e-1*(fuel_purity - 75e-2) AS signal FROM b)
SELECT shot_id, time_s, regime, fuel_density_m3, temperature_keV, confinement_time_s, fuel_purity,
  energy_input_MJ, pressure_Pa, Ip_MA, Bt_T, R_m, a_m, kappa, ne_20, M_amu, Pin_MW,
  exp(signal + noise) - 1e0 AS neutron_yield, exp(signal) - 1e0 AS surrogate_yield, energy_input_MJ*1e6 AS crude_yield,
  l_linenumber AS k1, l_partkey AS k2, l_suppkey AS k3, l_extendedprice AS k4
FROM s"""

DIRTY = """
SELECT shot_id, time_s, regime, fuel_density_m3, temperature_keV,
  CASE WHEN k2 % 83 = 0 THEN NULL ELSE confinement_time_s END AS confinement_time_s,
  CASE WHEN k2 % 71 = 0 THEN 12e-1 ELSE fuel_purity END AS fuel_purity, energy_input_MJ,
  CASE WHEN k2 % 97 = 0 THEN -1e0 ELSE pressure_Pa END AS pressure_Pa,
  CASE WHEN k2 % 89 = 0 THEN NULL ELSE Ip_MA END AS Ip_MA, Bt_T, R_m,
  CASE WHEN k2 % 73 = 0 THEN R_m ELSE a_m END AS a_m, CASE WHEN k2 % 109 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN k2 % 113 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE kappa END AS kappa,
  CASE WHEN k2 % 79 = 0 THEN ne_20*15e-1 ELSE ne_20 END AS ne_20,
  M_amu, Pin_MW, neutron_yield, k1, k2, k3, k4 FROM {samples}
UNION ALL SELECT shot_id, time_s, regime, fuel_density_m3, temperature_keV, confinement_time_s, fuel_purity,
  energy_input_MJ, pressure_Pa, Ip_MA, Bt_T, R_m, a_m, kappa, ne_20, M_amu, Pin_MW, neutron_yield, k1, k2, k3, k4
  FROM {samples} WHERE k2 % 101 = 0"""

#: Other spellings and units of the same samples; shots that are missing.
ALIASED = """
SELECT shot_id AS experiment_id, time_s*1e3 AS time_ms, fuel_density_m3 AS density_m3, temperature_keV*1e3 AS temperature_eV, confinement_time_s AS tau_E, neutron_yield AS yield,
  fuel_purity AS fuel_mix_purity, energy_input_MJ AS energy_input, pressure_Pa AS pressure, Ip_MA AS plasma_current_MA, Bt_T AS magnetic_field_T, R_m AS major_radius_m, a_m AS minor_radius_m,
  kappa AS elongation, Pin_MW AS power_input_MW, k1, k2, k3, k4 FROM {samples}"""

UNITS = """
SELECT shot_id, k1, k2, k3, k4, CASE k2 % 4 WHEN 0 THEN 'keV' WHEN 1 THEN 'eV' WHEN 2 THEN ' K ' ELSE 'KEV' END AS temperature_unit,
  CASE WHEN k2 % 53 = 0 THEN NULL ELSE CASE k2 % 4 WHEN 1 THEN temperature_keV*1e3 WHEN 2 THEN temperature_keV*1160451812e-2 ELSE temperature_keV END END AS temperature FROM {samples}"""

TEXT = """
SELECT shot_id, k1, k2, k3, k4, CASE k2 % 7 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN '1.5d' WHEN 3 THEN 'inf' WHEN 4 THEN concat(' ', cast(k2 as varchar(20)), '.5 ') WHEN 5 THEN concat(cast(k2 as varchar(20)), 'e2') ELSE cast(k2 as varchar(20)) END AS pressure_Pa,
  CASE WHEN k3 % 5 = 0 THEN 'nan' ELSE concat('.', cast(k3 as varchar(20))) END AS fuel_purity FROM {samples}"""

NULL_SHOTS = """
SELECT CASE WHEN k2 % 103 = 0 THEN NULL ELSE shot_id END AS shot_id, time_s, regime, temperature_keV, neutron_yield, k1, k2, k3, k4 FROM {samples}"""

REQUESTS = """
SELECT shot_id, k1, k2, k3, k4, CASE WHEN k2 % 61 = 0 THEN -1e0 ELSE fuel_density_m3 END AS fuel_density_m3, CASE WHEN k2 % 67 = 0 THEN NULL ELSE temperature_keV END AS temperature_keV, confinement_time_s,
  CASE WHEN k2 % 3 = 0 THEN NULL ELSE fuel_purity END AS fuel_purity, CASE WHEN k2 % 5 = 0 THEN NULL ELSE energy_input_MJ END AS energy_input_MJ,
  CASE WHEN k2 % 7 = 0 THEN NULL WHEN k2 % 59 = 0 THEN -1e0 ELSE pressure_Pa END AS pressure_Pa, CASE WHEN k2 % 11 = 0 THEN NULL ELSE Ip_MA END AS Ip_MA, CASE WHEN k2 % 13 = 0 THEN NULL ELSE Bt_T END AS Bt_T,
  CASE WHEN k2 % 17 = 0 THEN NULL ELSE R_m END AS R_m, CASE WHEN k2 % 19 = 0 THEN NULL WHEN k2 % 73 = 0 THEN 9e0 ELSE a_m END AS a_m, CASE WHEN k2 % 23 = 0 THEN NULL ELSE kappa END AS kappa,
  CASE WHEN k2 % 2 = 0 THEN NULL WHEN k2 % 79 = 0 THEN ne_20*15e-1 ELSE ne_20*10002e-4 END AS ne_20, CASE WHEN k2 % 29 = 0 THEN NULL ELSE M_amu END AS M_amu, CASE WHEN k2 % 31 = 0 THEN NULL ELSE Pin_MW END AS Pin_MW FROM {samples}"""

_ALL = {"dirty": DIRTY, "aliased": ALIASED, "units": UNITS, "texts": TEXT, "null_shots": NULL_SHOTS, "requests": REQUESTS}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SAMPLES, lineitem=table(spark, sf_dir, "lineitem"))


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_ALL[name], samples=samples(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as long time-resolved groups with a category."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS shot_id", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS time_s", "value AS signal", "event_type AS regime", "event_id AS k1")


def with_sql(body: str) -> str:
    """DuckDB SQL of body, which may read samples, the derived tables and event_samples."""
    tables = {"samples": SAMPLES.format(lineitem="lineitem"), **{k: v.format(samples="samples") for k, v in _ALL.items()}}
    tables["event_samples"] = "SELECT user_id AS shot_id, epoch_us(ts) / 1e6 AS time_s, value AS signal, event_type AS regime, event_id AS k1 FROM events"
    needed, text = [], body
    for name in reversed(["samples", "event_samples", *_ALL]):
        if name in text:
            needed.insert(0, name)
            text += tables[name]
    return "WITH " + ", ".join(f"{n} AS ({tables[n]})" for n in needed) + ("," if body.lstrip().startswith(",") else " ") + body.lstrip().removeprefix(",")
