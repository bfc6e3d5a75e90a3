"""The registered queries of the plasma-shot library, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toroid import config as C
from toroid import fixtures as X
from toroid.functions import physics as P
from toroid.functions.numbers import to_number
from toroid.operators import audit as A
from toroid.operators import boosting as B
from toroid.operators import metrics as M
from toroid.operators import models as L
from toroid.operators import normalise as N
from toroid.operators import scoring as R
from toroid.operators import shots as H
from toroid.operators import splits as S
from toroid.operators import validate as V
from toroid.operators.features import engineer
from toroid.operators.quantiles import fold_quantiles, quantile, quantiles
from toroid.sources.samples import read_samples, synthetic_shots
from toroid.sources.shared import materialise, new_path, stamp, table
from toroid.sources.sinks import write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The SQL of queries before the derived tables are put in front, for a second query with the same result.
ORACLE_BODY: dict[str, str] = {}
KEY = ("shot_id", *X.TIES)
#: Tree sizes in queries; full sizes are the defaults of the families.
SMALL = {"trees": 20, "tree_depth": 8, "rounds": 20, "boost_depth": 5, "bins": 255}


@dataclass
class _Split:
    """Engineered samples with is_test, derived anew by whoever reads them; the training rows as bin numbers, written once; models fitted so far."""

    stamp: tuple
    rows: DataFrame
    features: list[str]
    edges: dict[str, list[float]]
    binned: B.Binned | None = None
    middle: L.Medians = field(default_factory=dict)
    models: dict[str, PipelineModel] = field(default_factory=dict)

    @property
    def train(self) -> DataFrame:
        return self.rows.where("not is_test")

    @property
    def test(self) -> DataFrame:
        return self.rows.where("is_test")


#: By session and folder, so that model queries do not split, bin, rank and fit the same again. Other data mean another stamp, and all is made anew.
_SPLITS: dict[tuple[str, str], _Split] = {}


def query(sql: str | None = None, plain: bool = False) -> Callable[[Query], Query]:
    """Register a function under its name, with SQL over the derived tables (plain: over the given tables)."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_BODY[f.__name__] = sql
            ORACLE_SQL[f.__name__] = sql if plain else X.with_sql(sql)
        return f
    return add


def rounded(c: Column | str, digits: int) -> Column:
    """c rounded as DuckDB does it: scaled, rounded to a whole number, scaled back, in doubles; c itself where scaling overflows.

    F.round works on decimal digits, and differs where c * 10**digits is over 2**53 or only comes to a half by scaling.
    """
    c = F.col(c) if isinstance(c, str) else c
    found = F.round(c * F.lit(10.0**digits)) / F.lit(10.0**digits)
    return F.when(F.isnan(found) | (F.abs(found) == float("inf")), c).otherwise(found)


def r6(c: Column | str, scale: float = 1.0) -> Column:
    """c / scale, rounded, so that engines agree."""
    return rounded((F.col(c) if isinstance(c, str) else c) / F.lit(scale), 6)


def row_key() -> Column:
    return F.expr(X.ROW_KEY)


_HASH = "('0x' || substr(md5('42:' || {0}), 1, 12))::bigint"
HASH_ROW, HASH_SHOT = _HASH.format(X.ROW_KEY), _HASH.format("cast(shot_id as varchar)")
_R = "round({0}, 6)"


# Sources

@query("""SELECT shot_id, k1, k2, k3, round(k4, 2) AS k4, round(temperature_keV, 6) AS temperature_kev, round(confinement_time_s, 6) AS confinement_time_s, round(neutron_yield / 1e9, 6) AS yield_1e9 FROM samples""")
def csv_source(spark, sf_dir):
    """Samples in other spellings, written as CSV and read back."""
    path = write_table(X.derived(spark, sf_dir, "aliased"), new_path(spark, "csv"), "csv")
    df, _ = N.canonical(read_samples(spark, path, "csv")[0])
    df = df.withColumns({c: to_number(F.col(c), df.schema[c].dataType) for c in KEY})
    whole = [F.col(c).cast("long").alias(c) for c in KEY[:-1]]
    return df.select(*whole, rounded("k4", 2).alias("k4"), r6("temperature_keV").alias("temperature_kev"), r6("confinement_time_s").alias("confinement_time_s"), r6(C.TARGET, 1e9).alias("yield_1e9"))


@query(ORACLE_BODY["csv_source"])
def csv_folder(spark, sf_dir):
    """The same from a folder of files whose columns stand in two orders."""
    df, path = X.derived(spark, sf_dir, "aliased"), new_path(spark, "csv")
    odd = F.col("k2") % 2 == 1
    write_table(df.where(~odd), path, "csv")
    df.where(odd).select(*reversed(df.columns)).write.mode("append").option("header", True).csv(path)
    back, _ = N.canonical(read_samples(spark, path, "csv")[0])
    back = back.withColumns({c: to_number(F.col(c), back.schema[c].dataType) for c in KEY})
    whole = [F.col(c).cast("long").alias(c) for c in KEY[:-1]]
    return back.select(*whole, rounded("k4", 2).alias("k4"), r6("temperature_keV").alias("temperature_kev"), r6("confinement_time_s").alias("confinement_time_s"), r6(C.TARGET, 1e9).alias("yield_1e9"))


_U = "(('0x' || substr(md5('42:{0}:' || i), 1, 12))::bigint)::double / 281474976710656e0"


@query(f"""SELECT i // 6 AS shot_id, round(4e0 + {_U.format('temperature_keV')} * 24e0, 6) AS temperature_kev, round(72e-2 + {_U.format('fuel_purity')} * (995e-3 - 72e-2), 6) AS fuel_purity,
  round(pow(1e1, 193e-1 + {_U.format('log10_density')} * (205e-1 - 193e-1)) / 1e20, 6) AS ne_20, round((18e-1 + {_U.format('R_m')} * (65e-1 - 18e-1)) * (24e-2 + {_U.format('aspect')} * (38e-2 - 24e-2)), 6) AS a_m
  FROM (SELECT unnest(range(0, (SELECT count(*) FROM lineitem))) AS i)""", plain=True)
def synthetic_shots_table(spark, sf_dir):
    """As many synthetic samples as there are line items."""
    df = synthetic_shots(spark, table(spark, sf_dir, "lineitem").count())
    return df.select("shot_id", r6("temperature_keV").alias("temperature_kev"), r6("fuel_purity").alias("fuel_purity"), r6("ne_20").alias("ne_20"), r6("a_m").alias("a_m"))


# Normalisation

@query("""SELECT shot_id, k1, k2, k3, round(time_s, 6) AS time_s, round(fuel_density_m3 / 1e20, 6) AS density, round(temperature_keV, 6) AS temperature_kev, round(R_m, 6) AS r_m, round(neutron_yield / 1e9, 6) AS yield_1e9 FROM samples""")
def alias_mapping(spark, sf_dir):
    df, _ = N.canonical(X.derived(spark, sf_dir, "aliased"))
    return df.select(*KEY[:-1], r6("time_s").alias("time_s"), r6("fuel_density_m3", 1e20).alias("density"), r6("temperature_keV").alias("temperature_kev"), r6("R_m").alias("r_m"), r6(C.TARGET, 1e9).alias("yield_1e9"))


@query("""SELECT shot_id, k1, k2, k3, round(CASE k2 % 7 WHEN 3 THEN 'inf'::double WHEN 4 THEN k2 + 5e-1 WHEN 5 THEN k2 * 1e2 WHEN 6 THEN k2::double END, 6) AS pressure_pa,
  CASE WHEN k3 % 5 <> 0 THEN round(('.' || k3)::double, 6) END AS fuel_purity FROM texts""")
def numeric_coercion(spark, sf_dir):
    df = N.coerce(X.derived(spark, sf_dir, "texts"))
    return df.select(*KEY[:-1], rounded("pressure_Pa", 6).alias("pressure_pa"), rounded("fuel_purity", 6).alias("fuel_purity"))


@query("SELECT shot_id, k1, k2, k3, round(temperature_eV / 1e3, 6) AS temperature_kev FROM (SELECT *, experiment_id AS shot_id FROM aliased)")
def temp_from_ev(spark, sf_dir):
    df = N.with_kev(X.derived(spark, sf_dir, "aliased"))
    return df.select(F.col("experiment_id").alias("shot_id"), *X.TIES[:-1], r6("temperature_keV").alias("temperature_kev"))


@query("SELECT shot_id, k1, k2, k3, round(temperature_keV * 1160451812e-2 / 1160451812e-2, 6) AS temperature_kev FROM samples")
def temp_from_k(spark, sf_dir):
    kelvin = X.samples(spark, sf_dir).withColumn("temperature_K", P.kev_to_kelvin(F.col("temperature_keV"))).drop("temperature_keV")
    return N.with_kev(kelvin).select(*KEY[:-1], r6("temperature_keV").alias("temperature_kev"))


@query("""SELECT shot_id, k1, k2, k3, round(CASE WHEN temperature > 0 THEN CASE lower(trim(temperature_unit)) WHEN 'kev' THEN temperature WHEN 'ev' THEN temperature / 1e3 WHEN 'k' THEN temperature / 1160451812e-2 END END, 6) AS temperature_kev FROM units""")
def temp_by_unit(spark, sf_dir):
    return N.with_kev(X.derived(spark, sf_dir, "units")).select(*KEY[:-1], r6("temperature_keV").alias("temperature_kev"))


@query("""SELECT shot_id, k1, k2, k3, round(t * 1160451812e-5, 4) AS ev_to_k, round(t / 1160451812e-5, 6) AS k_to_ev, round(t * 1160451812e-2 / 1e6, 6) AS kev_to_mk, round(t / 1160451812e-2 * 1e6, 6) AS k_to_mev, round(t / 1e3, 6) AS ev_to_kev, round(t * 1e3, 6) AS kev_to_ev
  FROM (SELECT *, CASE WHEN k2 % 9 > 0 THEN temperature_keV * (k2 % 9) END AS t FROM samples)""")
def temp_conversions(spark, sf_dir):
    df = X.samples(spark, sf_dir).withColumn("t", F.col("temperature_keV") * (F.col("k2") % 9))
    t = F.col("t")
    return df.select(*KEY[:-1], rounded(P.ev_to_kelvin(t), 4).alias("ev_to_k"), r6(P.kelvin_to_ev(t)).alias("k_to_ev"), r6(P.kev_to_kelvin(t), 1e6).alias("kev_to_mk"), rounded(P.kelvin_to_kev(t) * 1e6, 6).alias("k_to_mev"), r6(P.ev_to_kev(t)).alias("ev_to_kev"), r6(P.kev_to_ev(t)).alias("kev_to_ev"))


@query("SELECT experiment_id AS shot_id, k1, k2, k3, round(time_ms / 1e3, 6) AS time_s, round(time_ms, 3) AS time_ms FROM aliased")
def time_axis(spark, sf_dir):
    df = N.with_time(X.derived(spark, sf_dir, "aliased"))
    return df.select(F.col("experiment_id").alias("shot_id"), *X.TIES[:-1], r6("time_s").alias("time_s"), rounded("time_ms", 3).alias("time_ms"))


@query("""SELECT round(fuel_density_m3 / 1e20, 6) AS fuel_density_m3, round(temperature_keV, 6) AS temperature_kev, round(confinement_time_s, 6) AS confinement_time_s, round(fuel_purity, 6) AS fuel_purity,
  round(energy_input_MJ, 6) AS energy_input_mj, round(pressure_Pa, 6) AS pressure_pa, round(Ip_MA, 6) AS ip_ma, round(Bt_T, 6) AS bt_t, round(R_m, 6) AS r_m, round(a_m, 6) AS a_m, round(kappa, 6) AS kappa, round(ne_20, 6) AS ne_20, round(M_amu, 6) AS m_amu, round(Pin_MW, 6) AS pin_mw FROM samples""")
def feature_projection(spark, sf_dir):
    """Model inputs that are present, by name."""
    df = X.samples(spark, sf_dir)
    return df.select(*[r6(c, 1e20 if c == "fuel_density_m3" else 1.0).alias(c.lower()) for c in N.feature_columns(df.columns)])


# Audit

_COLUMNS = "shot_id time_s regime fuel_density_m3 temperature_keV confinement_time_s fuel_purity energy_input_MJ pressure_Pa Ip_MA Bt_T R_m a_m kappa ne_20 M_amu Pin_MW neutron_yield k1 k2 k3 k4".split()
_TYPES = {"shot_id": "bigint", "regime": "string", "k1": "int", "k2": "bigint", "k3": "bigint"}


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{_TYPES.get(c, 'double')}' AS dtype, count(*) - count({c}) AS nulls, count(*) AS row_count, {len(_COLUMNS)} AS column_count FROM dirty" for c in _COLUMNS) + ")")
def audit_profile(spark, sf_dir):
    return A.profile(X.derived(spark, sf_dir, "dirty"))


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, count(*) FILTER (WHERE n > 1) AS duplicate_groups FROM (SELECT count(*) AS n FROM dirty GROUP BY ALL)".replace("SELECT count(*) AS n FROM dirty GROUP BY ALL", f"SELECT {', '.join(_COLUMNS)}, count(*) AS n FROM dirty GROUP BY ALL"))
def audit_duplicates(spark, sf_dir):
    return A.duplicates(X.derived(spark, sf_dir, "dirty"))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM dirty" for c in _COLUMNS) + ")")
def audit_nulls(spark, sf_dir):
    return A.null_counts(X.derived(spark, sf_dir, "dirty"))


@query("SELECT round(min(neutron_yield) / 1e9, 6) AS target_min, round(median(neutron_yield) / 1e9, 6) AS target_median, round(avg(neutron_yield) / 1e9, 6) AS target_mean, round(max(neutron_yield) / 1e9, 6) AS target_max FROM dirty")
def audit_target(spark, sf_dir):
    found = A.target_distribution(X.derived(spark, sf_dir, "dirty"))
    return found.select(*[r6(c, 1e9).alias(c) for c in found.columns])


# Cleaning and validation

@query("SELECT shot_id, k1, k2, k3, round(k4, 2) AS k4, round(ne_20, 6) AS ne_20, round(a_m, 6) AS a_m FROM (SELECT DISTINCT * FROM dirty)")
def dedup_rows(spark, sf_dir):
    return X.derived(spark, sf_dir, "dirty").dropDuplicates().select(*KEY[:-1], rounded("k4", 2).alias("k4"), r6("ne_20").alias("ne_20"), r6("a_m").alias("a_m"))


def _violations(spark, sf_dir, kinds: set[str]) -> DataFrame:
    df = X.derived(spark, sf_dir, "dirty")
    rules = [c for c in V.checks(df.columns) if c.rule in kinds]
    return V.violations(df, rules, list(KEY)).withColumn("k4", rounded("k4", 2))


_BAD = "shot_id, k1, k2, k3, round(k4, 2) AS k4"
_POSITIVE = [c for c in C.BASE_FEATURES if c != "fuel_purity"]
_RANGES = [*[(c, f"{c} <= 0 OR isinf({c})") for c in _POSITIVE], ("fuel_purity", "fuel_purity < 0 OR fuel_purity > 1 OR isinf(fuel_purity)"), ("neutron_yield", "neutron_yield < 0 OR isinf(neutron_yield)")]
_MISSING_SQL = " UNION ALL ".join(f"SELECT {_BAD}, '{c}' AS field, 'missing' AS rule FROM dirty WHERE {c} IS NULL" for c in C.REQUIRED)
_RANGE_SQL = " UNION ALL ".join(f"SELECT {_BAD}, '{c}' AS field, 'range' AS rule FROM dirty WHERE {w}" for c, w in _RANGES)
_GEOMETRY_SQL = f"SELECT {_BAD}, 'a_m' AS field, 'geometry' AS rule FROM dirty WHERE a_m >= R_m"
_NE20_SQL = f"SELECT {_BAD}, 'ne_20' AS field, 'consistency' AS rule FROM dirty WHERE abs(fuel_density_m3 / 1e20 - ne_20) > greatest(1e-3 * greatest(abs(fuel_density_m3 / 1e20), abs(ne_20)), 1e-6)"


@query(f"SELECT * FROM ({_MISSING_SQL})")
def viol_missing(spark, sf_dir):
    return _violations(spark, sf_dir, {"missing"})


@query(f"SELECT * FROM ({_RANGE_SQL})")
def viol_range(spark, sf_dir):
    return _violations(spark, sf_dir, {"range"})


@query(_GEOMETRY_SQL)
def viol_geometry(spark, sf_dir):
    return _violations(spark, sf_dir, {"geometry"})


@query(_NE20_SQL)
def viol_ne20(spark, sf_dir):
    return _violations(spark, sf_dir, {"consistency"})


_EVERY_RULE = " UNION ALL ".join([*[f"SELECT '{c}' AS field, 'missing' AS rule" for c in C.REQUIRED], *[f"SELECT '{c}', 'range'" for c, _ in _RANGES], "SELECT 'a_m', 'geometry'", "SELECT 'ne_20', 'consistency'"])


@query(f"""SELECT field, rule, count(shot_id) AS violations FROM ({_EVERY_RULE}) e LEFT JOIN (SELECT * FROM ({_MISSING_SQL} UNION ALL {_RANGE_SQL} UNION ALL {_GEOMETRY_SQL} UNION ALL {_NE20_SQL})) v USING (field, rule) GROUP BY field, rule""")
def violation_summary(spark, sf_dir):
    df = X.derived(spark, sf_dir, "dirty")
    return V.summary(df, V.checks(df.columns))


_INPUTS = [c for c in C.BASE_FEATURES]
_BROKEN = " ".join([
    *[f"|| CASE WHEN {c} IS NULL THEN '{c}:missing ' ELSE '' END || CASE WHEN {c} <= 0 OR isinf({c}) THEN '{c}:range ' ELSE '' END" for c in C.REQUIRED_INPUTS],
    *[f"|| CASE WHEN {dict(_RANGES)[c]} THEN '{c}:range ' ELSE '' END" for c in C.OPTIONAL_INPUTS],
    "|| CASE WHEN a_m >= R_m THEN 'a_m:geometry ' ELSE '' END",
    "|| CASE WHEN abs(fuel_density_m3 / 1e20 - ne_20) > greatest(1e-3 * greatest(abs(fuel_density_m3 / 1e20), abs(ne_20)), 1e-6) THEN 'ne_20:consistency ' ELSE '' END",
])


@query(f"SELECT shot_id, k1, k2, k3, trim('' {_BROKEN}) AS broken FROM requests")
def score_validation(spark, sf_dir):
    return R.validated(X.derived(spark, sf_dir, "requests")).select(*KEY[:-1], F.array_join("broken", " ").alias("broken"))


@query("""SELECT shot_id, k1, k2, k3, round(CASE WHEN ne_20 IS NULL OR NOT abs(fuel_density_m3 / 1e20 - ne_20) > greatest(1e-3 * greatest(abs(fuel_density_m3 / 1e20), abs(ne_20)), 1e-6) THEN fuel_density_m3 / 1e20 END, 6) AS ne_20 FROM requests""")
def ne20_derive(spark, sf_dir):
    return R.validated(X.derived(spark, sf_dir, "requests")).select(*KEY[:-1], r6("ne_20").alias("ne_20"))


# Shots

@query("SELECT count(*) AS row_count, count(DISTINCT shot_id) AS shot_count, count(DISTINCT shot_id) <> count(*) AS collapse FROM samples")
def shot_guard(spark, sf_dir):
    return H.guard(X.samples(spark, sf_dir))


_PRE = "row_number() OVER (PARTITION BY shot_id ORDER BY time_s, {0}) <= greatest(1, ceil(count(*) OVER (PARTITION BY shot_id) * 8e-1)) AS pre"
_PRE4 = _PRE.format("k1, k2, k3, k4")


@query(f"SELECT shot_id, k1, k2, k3, round(k4, 2) AS k4, pre AS in_pre_window FROM (SELECT *, {_PRE4} FROM samples)")
def shot_pre_window(spark, sf_dir):
    return H.pre_window(X.samples(spark, sf_dir), X.TIES).select(*KEY[:-1], rounded("k4", 2).alias("k4"), "in_pre_window")


_MEDIANS = ["time_s", *C.BASE_FEATURES]


def _scale(c: str) -> float:
    return {"fuel_density_m3": 1e20, "pressure_Pa": 1e5}.get(c, 1.0)


@query(f"""SELECT shot_id, {', '.join(f"round(median({c}) FILTER (WHERE pre) / {_scale(c)!r}::double, 6) AS {c.lower()}" for c in _MEDIANS)}, round(max(neutron_yield) / 1e9, 6) AS neutron_yield
  FROM (SELECT *, {_PRE4} FROM samples) GROUP BY shot_id""")
def shot_aggregate(spark, sf_dir):
    df = H.aggregate_shots(X.samples(spark, sf_dir), X.TIES)
    return df.select("shot_id", *[r6(c, _scale(c)).alias(c.lower()) for c in _MEDIANS], r6(C.TARGET, 1e9).alias(C.TARGET))


@query(f"""SELECT m.shot_id, m.regime, round(v.signal, 6) AS signal FROM (
    SELECT shot_id, regime FROM (SELECT shot_id, regime, row_number() OVER (PARTITION BY shot_id ORDER BY count(*) DESC, regime) AS r FROM (SELECT *, {_PRE.format('k1')} FROM event_samples) WHERE pre GROUP BY shot_id, regime) WHERE r = 1) m
  JOIN (SELECT shot_id, median(signal) FILTER (WHERE pre) AS signal FROM (SELECT *, {_PRE.format('k1')} FROM event_samples) GROUP BY shot_id) v ON m.shot_id = v.shot_id""")
def shot_mode(spark, sf_dir):
    """Long groups with a category: events of a user."""
    df = H.aggregate_shots(X.events(spark, sf_dir), ("k1",))
    return df.select("shot_id", "regime", r6("signal").alias("signal"))


@query(ORACLE_BODY["shot_mode"])
def shot_dealt(spark, sf_dir):
    """The same groups, those of over 40 rows as giant shots: dealt into cells, their leading part and medians found by counts."""
    df = H.collapse(X.events(spark, sf_dir), ("k1",), giant=40, cell=5_000)
    return df.select("shot_id", "regime", r6("signal").alias("signal"))


@query(f"SELECT shot_id, round(median(temperature_keV) FILTER (WHERE pre), 6) AS temperature_kev, round(max(neutron_yield) / 1e9, 6) AS neutron_yield FROM (SELECT *, {_PRE4} FROM null_shots WHERE shot_id IS NOT NULL) GROUP BY shot_id")
def shot_null_key(spark, sf_dir):
    """Rows without a shot are left out when shots are collapsed."""
    df = H.aggregate_shots(X.derived(spark, sf_dir, "null_shots"), X.TIES)
    return df.select("shot_id", r6("temperature_keV").alias("temperature_kev"), r6(C.TARGET, 1e9).alias(C.TARGET))


# Features

_TP = "fuel_density_m3 * temperature_keV * confinement_time_s"


@query(f"""SELECT shot_id, k1, k2, k3, round({_TP} / 1e21, 6) AS triple_product, round({_TP} / 3e21, 6) AS lawson_ratio, round(fuel_density_m3 * temperature_keV / 1e20, 6) AS density_temp, round(fuel_density_m3 * confinement_time_s / 1e20, 6) AS density_tau, round(fuel_density_m3 * fuel_purity / 1e20, 6) AS purity_weighted_density FROM samples""")
def features_core(spark, sf_dir):
    df = engineer(X.samples(spark, sf_dir))
    return df.select(*KEY[:-1], r6("triple_product", 1e21).alias("triple_product"), r6("lawson_ratio").alias("lawson_ratio"), r6("density_temp", 1e20).alias("density_temp"), r6("density_tau", 1e20).alias("density_tau"), r6("purity_weighted_density", 1e20).alias("purity_weighted_density"))


_LOGS = {"log_fuel_density_m3": "fuel_density_m3", "log_temperature_kev": "temperature_keV", "log_confinement_time_s": "confinement_time_s", "log_energy_input_mj": "energy_input_MJ", "log_pressure_pa": "pressure_Pa", "log_triple_product": _TP, "log_neutron_yield": "greatest(neutron_yield, 0)"}


@query(f"SELECT shot_id, k1, k2, k3, {', '.join(f'round(ln(1e0 + {v}), 6) AS {k}' for k, v in _LOGS.items())} FROM samples")
def features_log(spark, sf_dir):
    df = engineer(X.samples(spark, sf_dir))
    names = {c.lower(): c for c in df.columns}
    return df.select(*KEY[:-1], *[r6(names[k]).alias(k) for k in _LOGS])


_TAU = "562e-4 * pow(Ip_MA, 93e-2) * pow(Bt_T, 15e-2) * pow(R_m, 197e-2) * pow(a_m / R_m, 58e-2) * pow(kappa, 78e-2) * pow(ne_20, 41e-2) * pow(M_amu, 19e-2) * pow(Pin_MW, -69e-2)"


@query(f"SELECT shot_id, k1, k2, k3, round(k4, 2) AS k4, round(CASE WHEN Ip_MA > 0 AND Bt_T > 0 AND R_m > 0 AND a_m > 0 AND kappa > 0 AND ne_20 > 0 AND M_amu > 0 AND Pin_MW > 0 THEN {_TAU} END, 6) AS tau_e_ipb98_s FROM dirty")
def tau_ipb98(spark, sf_dir):
    return engineer(X.derived(spark, sf_dir, "dirty")).select(*KEY[:-1], rounded("k4", 2).alias("k4"), r6("tau_E_ipb98_s").alias("tau_e_ipb98_s"))


@query(f"SELECT shot_id, k1, k2, k3, round({_TP} / 3e21, 6) AS lawson_ratio, CASE WHEN {_TP} / 3e21 >= 1 THEN 'IGNITION REACHED' ELSE 'SUB-CRITICAL' END AS status FROM samples")
def lawson_status(spark, sf_dir):
    ratio = P.lawson_ratio(P.triple_product(*(F.col(c) for c in C.REQUIRED_INPUTS)))
    return X.samples(spark, sf_dir).select(*KEY[:-1], r6(ratio).alias("lawson_ratio"), P.lawson_status(ratio).alias("status"))


# Splits and folds

@query("SELECT count(*) AS row_count, count(DISTINCT neutron_yield) AS distinct_targets, count(DISTINCT shot_id) AS shots, 14 AS n_features, CAST(NULL AS VARCHAR) AS failed FROM samples")
def training_guards(spark, sf_dir):
    df = X.samples(spark, sf_dir)
    return S.training_guards(df, N.feature_columns(df.columns))


@query(f"SELECT {X.ROW_KEY} AS row_key, row_number() OVER (ORDER BY {HASH_ROW}, {X.ROW_KEY}) <= ceil(count(*) OVER () * 2e-1) AS is_test FROM samples")
def split_random(spark, sf_dir):
    return S.random_holdout(X.samples(spark, sf_dir).withColumn("row_key", row_key()), F.col("row_key")).select("row_key", "is_test")


@query(f"SELECT shot_id, row_number() OVER (ORDER BY {HASH_SHOT}, shot_id) <= ceil(count(*) OVER () * 2e-1) AS is_test, n AS row_count FROM (SELECT shot_id, count(*) AS n FROM samples GROUP BY shot_id)")
def split_group(spark, sf_dir):
    return S.shot_holdout(X.samples(spark, sf_dir)).groupBy("shot_id", "is_test").agg(F.count("*").alias("row_count"))


@query(f"SELECT {X.ROW_KEY} AS row_key, CAST((row_number() OVER (ORDER BY {HASH_ROW}, {X.ROW_KEY}) - 1) % 5 AS INTEGER) AS fold FROM samples")
def folds_random(spark, sf_dir):
    return S.random_folds(X.samples(spark, sf_dir).withColumn("row_key", row_key()), F.col("row_key")).select("row_key", "fold")


# The groups of one size, in order, take the least of all (load after j more groups, fold); loads and folds so far go from size to size.
_PICKED = "list_sort(flatten(list_transform(range(0, 5), lambda f: list_transform(range(0, x.c), lambda j: {'v': a.loads[f + 1] + j * x.s, 'f': f}))))[1:x.c]"
_SIZE_STEP = f"list_transform([{_PICKED}], lambda q: {{'s': x.s, 'c': x.c, 'loads': list_transform(range(0, 5), lambda f: CAST(a.loads[f + 1] + x.s * len(list_filter(q, lambda z: z.f = f)) AS BIGINT)), 'out': list_concat(a.out, list_transform(q, lambda z: CAST(z.f AS BIGINT)))}})[1]"


def _group_folds(rows: str) -> str:
    """SQL for (shot_id, n, fold): the shots of a table, from large to small, each in the lightest of five folds."""
    shots = f"(SELECT shot_id, count(*) AS n FROM {rows} GROUP BY shot_id)"
    first = "{{'s': CAST({s} AS BIGINT), 'c': CAST({c} AS BIGINT), 'loads': CAST([0, 0, 0, 0, 0] AS BIGINT[]), 'out': CAST([] AS BIGINT[])}}"
    sizes = f"SELECT list({first.format(s='n', c='c')} ORDER BY n DESC) AS l FROM (SELECT n, count(*) AS c FROM {shots} GROUP BY n)"
    turns = f"SELECT list_reduce(list_concat([{first.format(s=0, c=0)}], l), lambda a, x: {_SIZE_STEP}).out AS turns FROM ({sizes})"
    return f"SELECT shot_id, n, CAST(turns[r] AS INTEGER) AS fold FROM (SELECT shot_id, n, row_number() OVER (ORDER BY n DESC, {HASH_SHOT}) AS r FROM {shots}) CROSS JOIN ({turns})"


_GROUP_FOLDS = _group_folds("samples")


@query(f"SELECT shot_id, fold, n AS row_count FROM ({_GROUP_FOLDS})")
def folds_group(spark, sf_dir):
    return S.shot_folds(X.samples(spark, sf_dir)).groupBy("shot_id", "fold").agg(F.count("*").alias("row_count"))


# Models

_FILLED = [c for c in C.OPTIONAL_INPUTS]


@query(f"""SELECT shot_id, k1, k2, k3, {', '.join(f'round(coalesce({c}, m_{c}) / {_scale(c)!r}::double, 6) AS {c.lower()}' for c in _FILLED)} FROM requests CROSS JOIN (SELECT {', '.join(f'median({c}) AS m_{c}' for c in _FILLED)} FROM requests)""")
def impute_median(spark, sf_dir):
    df = X.derived(spark, sf_dir, "requests")
    return L.impute(df, L.medians(df, _FILLED)).select(*KEY[:-1], *[r6(c, _scale(c)).alias(c.lower()) for c in _FILLED])


_BASE = "exp(median(ln(1e0 + neutron_yield))) - 1e0"


@query(f"SELECT shot_id, k1, k2, k3, round(b / 1e9, 6) AS predicted FROM samples CROSS JOIN (SELECT {_BASE} AS b FROM samples)")
def baseline_predict(spark, sf_dir):
    df = X.samples(spark, sf_dir)
    return L.predict(L.fit_baseline(df, []), df).select(*KEY[:-1], r6(M.PREDICTED, 1e9).alias("predicted"))


def _prepared(spark, sf_dir) -> _Split:
    at, now = (spark.sparkContext.applicationId, sf_dir), stamp(spark, f"{sf_dir}/lineitem.parquet")
    if at not in _SPLITS or _SPLITS[at].stamp != now:
        samples = X.samples(spark, sf_dir)
        split = S.shot_holdout(samples)
        rows = engineer(split)
        features = N.feature_columns(rows.columns)
        # bin edges come from a bounded sample of training rows, by a hash of their keys; see bin_edges
        share = min(1.0, B.EDGE_ROWS / max(1.0, samples.count() * (1 - C.TEST_SHARE)))
        some = engineer(split.where(F.pmod(F.xxhash64(*KEY), F.lit(1 << 30)) < int(share * (1 << 30))).where("not is_test"))
        edges = B.bin_edges(materialise(some.select(*features)), features, SMALL["bins"])
        _SPLITS[at] = _Split(now, rows.select(*KEY, *features, C.TARGET, "is_test"), features, edges)
    return _SPLITS[at]


def _binned(spark, sf_dir) -> B.Binned:
    """The training rows of all families, binned once, with the bins of the features' medians."""
    split = _prepared(spark, sf_dir)
    if split.binned is None:
        rows, names = L.log_label(split.train), split.features
        chunks = B.chunked(rows, names, split.edges, L.LABEL, F.lit(-1), B.set_aside(names, L.LABEL), 0)
        split.binned = B.with_middles(chunks, names, split.edges, [None], lambda columns: {None: quantiles(split.train, {c: (F.col(c), 0.5) for c in columns})})
    return split.binned


def _fitted(spark, sf_dir, family: str) -> PipelineModel:
    """A family's model at the sizes of queries, fitted once."""
    split, fit = _prepared(spark, sf_dir), L.registry(**SMALL)[family]
    if family not in split.models:
        table = _binned(spark, sf_dir)
        if isinstance(fit, L.Baseline):
            split.middle = split.middle or L.medians(table.labels(L.LABEL), [L.LABEL])
            split.models[family] = fit(split.train, [], split.middle)
        else:
            split.models[family] = fit.of(table)
    return split.models[family]


@query()
def rf_predict(spark, sf_dir):
    """Predictions of a small forest for the held-out shots."""
    return L.predict(_fitted(spark, sf_dir, "random_forest"), _prepared(spark, sf_dir).test).select(*KEY, C.TARGET, M.PREDICTED)


@query()
def gbt_predict(spark, sf_dir):
    """Predictions of short boosting for the held-out shots."""
    return L.predict(_fitted(spark, sf_dir, "hist_gradient_boosting"), _prepared(spark, sf_dir).test).select(*KEY, C.TARGET, M.PREDICTED)


@query()
def gbt_cross_validation(spark, sf_dir):
    """Five folds of short boosting, grown side by side over one binned table. Rows meet their folds as codes, a byte for each feature."""
    split = _prepared(spark, sf_dir)
    rows, names = L.log_label(split.train), split.features
    placed = S.fold_table(split.train.select("shot_id"), folds=C.MAX_FOLDS)
    coded = B.coded(rows, names, split.edges, L.LABEL, B.set_aside(names, L.LABEL), "shot_id")
    chunks = B.chunked_codes(coded.join(placed, coded["key"] == placed["_shot"], "left"), len(names))

    def exact(columns: list[str]) -> dict[int, L.Medians]:
        own = materialise(split.train.select("shot_id", *columns).join(placed, F.col("shot_id") == F.col("_shot"), "left").select("fold", *columns))
        return fold_quantiles(own, {c: (F.col(c), 0.5) for c in columns}, "fold", C.MAX_FOLDS)

    table = B.with_middles(chunks, names, split.edges, list(range(C.MAX_FOLDS)), exact)
    found = L.Boosting(10, SMALL["boost_depth"], SMALL["bins"]).fold_errors_of(table, "hist_gradient_boosting")
    return M.fold_summary(spark.createDataFrame(found, L.FOLD_COLUMNS))


_CV = f"""f AS ({_GROUP_FOLDS}), x AS (SELECT s.*, f.fold FROM samples s JOIN f ON s.shot_id = f.shot_id),
  m AS (SELECT k.fold, exp(median(ln(1e0 + x.neutron_yield))) - 1e0 AS p FROM x JOIN (SELECT DISTINCT fold FROM x) k ON x.fold <> k.fold GROUP BY k.fold),
  e AS (SELECT x.fold, sqrt(avg(pow(x.neutron_yield - m.p, 2))) AS rmse, avg(abs(x.neutron_yield - m.p)) AS mae FROM x JOIN m ON x.fold = m.fold GROUP BY x.fold)"""


@query(f", {_CV} SELECT k.fold, round(median(x.confinement_time_s), 6) AS confinement_time_s, round(median(x.pressure_Pa) / 1e5, 6) AS pressure_pa, round(median(x.energy_input_MJ), 6) AS energy_input_mj FROM x JOIN (SELECT DISTINCT fold FROM x) k ON x.fold <> k.fold GROUP BY k.fold")
def fold_medians(spark, sf_dir):
    """What missing values of each fold's training rows would be replaced by: medians of all folds and columns from shared passes."""
    names = ["confinement_time_s", "pressure_Pa", "energy_input_MJ"]
    folds = materialise(S.shot_folds(X.samples(spark, sf_dir)).select("fold", *names))
    found = fold_quantiles(folds, {c: (F.col(c), 0.5) for c in names}, "fold", 5)
    rows = spark.createDataFrame([(k, *[v[c] for c in names]) for k, v in found.items()], ", ".join(["fold int", *[f"{c} double" for c in names]]))
    return rows.select("fold", *[r6(c, _scale(c)).alias(c.lower()) for c in names])


@query(f", {_CV} SELECT 'baseline' AS model, round(avg(rmse) / 1e9, 6) AS cv_rmse_mean, round(stddev_pop(rmse) / 1e9, 6) AS cv_rmse_std, round(avg(mae) / 1e9, 6) AS cv_mae_mean, round(stddev_pop(mae) / 1e9, 6) AS cv_mae_std FROM e")
def cv_baseline(spark, sf_dir):
    folds = materialise(S.shot_folds(X.samples(spark, sf_dir)).select("shot_id", "fold", C.TARGET))
    found = L.cross_validate(folds, [], L.fit_baseline, 5, "baseline")
    return found.select("model", *[r6(c, 1e9).alias(c) for c in found.columns if c != "model"])


#: Predictions made without a model: what the samples were generated from, a crude one, and a constant.
_CANDIDATES = {"surrogate": "surrogate_yield", "crude": "crude_yield", "doubled": "surrogate_yield * 2e0"}


def _candidate_metrics(spark, sf_dir) -> DataFrame:
    """Fold errors of the candidates. Samples are sent once, by shot; from then on a shot is one row of sums."""
    df = X.samples(spark, sf_dir).where("shot_id IS NOT NULL")
    sent = df.select("shot_id", C.TARGET, *[F.expr(v).alias(k) for k, v in _CANDIDATES.items() if k != "doubled"]).repartition("shot_id")
    models = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.expr(v.replace("_yield", "")).alias("p")) for i, v in enumerate(_CANDIDATES.values())])).alias("m")
    different = sent.select("shot_id", C.TARGET, models).groupBy("shot_id", C.TARGET, "m.i", "m.p").agg(F.lit(1).alias("one"))
    error = F.col(C.TARGET) - F.col("p")
    sums = [F.sum(F.when(F.col("i") == i, v)).alias(f"{n}{i}") for i in range(len(_CANDIDATES)) for n, v in (("n", F.when(error.isNotNull(), 1)), ("s", error * error), ("a", F.abs(error)))]
    shots = materialise(different.groupBy("shot_id").agg(F.count("*").alias("n"), *sums))
    folds = S.shot_folds(shots, rows=F.col("n")).groupBy("fold").agg(*[F.sum(c).alias(c) for c in shots.columns[2:]])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.sqrt(F.try_divide(f"s{i}", f"n{i}")).alias("rmse"), F.try_divide(f"a{i}", f"n{i}").alias("mae")) for i, k in enumerate(_CANDIDATES)])).alias("e")
    return M.fold_summary(folds.select("fold", each).select("fold", "e.*"))


_CANDIDATE_SQL = f"""c AS (SELECT DISTINCT shot_id, neutron_yield, model, p FROM (SELECT shot_id, neutron_yield, surrogate_yield AS p, 'surrogate' AS model FROM samples UNION ALL SELECT shot_id, neutron_yield, crude_yield, 'crude' FROM samples UNION ALL SELECT shot_id, neutron_yield, surrogate_yield * 2e0, 'doubled' FROM samples)),
  f AS ({_group_folds("c")}),
  e AS (SELECT model, fold, sqrt(avg(pow(neutron_yield - p, 2))) AS rmse, avg(abs(neutron_yield - p)) AS mae FROM c JOIN f USING (shot_id) GROUP BY model, fold),
  t AS (SELECT model, avg(rmse) AS a, stddev_pop(rmse) AS b, avg(mae) AS c, stddev_pop(mae) AS d FROM e GROUP BY model)"""


@query(f", {_CANDIDATE_SQL} SELECT model, round(a / 1e9, 6) AS cv_rmse_mean, round(c / 1e9, 6) AS cv_mae_mean FROM t ORDER BY a, c, model LIMIT 1")
def select_best(spark, sf_dir):
    """The best candidate by cross-validated error."""
    best = L.ranked(_candidate_metrics(spark, sf_dir)).limit(1)
    return best.select("model", r6("cv_rmse_mean", 1e9).alias("cv_rmse_mean"), r6("cv_mae_mean", 1e9).alias("cv_mae_mean"))


_ERRORS = "avg(abs(neutron_yield - p)) AS mae, sqrt(avg(pow(neutron_yield - p, 2))) AS rmse"
_WITH_MODELS = "SELECT 'baseline' AS model, {0}, neutron_yield, b AS p FROM {1} UNION ALL " + " UNION ALL ".join(f"SELECT '{k}', {{0}}, neutron_yield, {v} FROM {{1}}" for k, v in _CANDIDATES.items())
_TABLE_SQL = f"""h AS (SELECT shot_id, row_number() OVER (ORDER BY {HASH_SHOT}, shot_id) <= ceil(count(*) OVER () * 2e-1) AS is_test FROM (SELECT DISTINCT shot_id FROM samples WHERE shot_id IS NOT NULL)),
  tr AS (SELECT s.* FROM samples s JOIN h USING (shot_id) WHERE NOT is_test), f AS ({_group_folds("tr")}), x AS (SELECT tr.*, f.fold FROM tr JOIN f ON tr.shot_id = f.shot_id),
  m AS (SELECT k.fold, {_BASE} AS b FROM x JOIN (SELECT DISTINCT fold FROM x) k ON x.fold <> k.fold GROUP BY k.fold),
  xm AS (SELECT x.*, m.b FROM x JOIN m ON x.fold = m.fold), e AS (SELECT model, fold, {_ERRORS} FROM ({_WITH_MODELS.format("fold", "xm")}) GROUP BY model, fold),
  cv AS (SELECT model, avg(rmse) AS a, stddev_pop(rmse) AS b, avg(mae) AS c, stddev_pop(mae) AS d FROM e GROUP BY model),
  te AS (SELECT s.*, (SELECT {_BASE} FROM tr) AS b FROM samples s JOIN h USING (shot_id) WHERE is_test), q AS (SELECT quantile_cont(neutron_yield, 9e-1) AS q FROM te),
  o AS (SELECT model, {_ERRORS}, 1e0 - sum(pow(neutron_yield - p, 2)) / (count(neutron_yield) * var_pop(neutron_yield)) AS r2, avg(abs(neutron_yield - p)) FILTER (WHERE neutron_yield >= q) AS high, count(*) FILTER (WHERE neutron_yield >= q) AS n
    FROM ({_WITH_MODELS.format("q", "te CROSS JOIN q")}) GROUP BY model)"""


@query(f""", {_TABLE_SQL} SELECT model, round(a / 1e9, 6) AS cv_rmse_mean, round(b / 1e9, 6) AS cv_rmse_std, round(c / 1e9, 6) AS cv_mae_mean, round(d / 1e9, 6) AS cv_mae_std, round(mae / 1e9, 6) AS holdout_mae, round(rmse / 1e9, 6) AS holdout_rmse,
  round(r2, 6) AS holdout_r2, round(high / 1e9, 6) AS holdout_high_yield_mae, n AS holdout_high_yield_count FROM cv JOIN o USING (model) ORDER BY a, c, model""")
def metrics_table(spark, sf_dir):
    """Cross-validated errors over the training shots and holdout errors of the baseline, fitted to each fold's rest, and of the candidates; best first."""
    split = S.shot_holdout(X.samples(spark, sf_dir).where("shot_id IS NOT NULL")).select("shot_id", C.TARGET, "surrogate_yield", "crude_yield", "is_test")
    train = materialise(S.shot_folds(split.where("not is_test").drop("is_test")).drop("shot_id"))
    test = materialise(split.where("is_test").drop("shot_id", "is_test"))
    middle = {k: v[L.LABEL] for k, v in L.fold_medians(train, [], C.MAX_FOLDS + 1).items()}  # the last one sees all folds
    known = {k: F.expr(v) for k, v in _CANDIDATES.items()}
    base = F.expm1(F.element_at(F.array(*[F.lit(middle[k]) for k in range(C.MAX_FOLDS)]), F.col("fold") + 1))
    cv = M.fold_summary(M.model_errors(train, {"baseline": base} | known, by=["fold"]))
    held = M.model_errors(test, {"baseline": F.expm1(F.lit(middle[C.MAX_FOLDS]))} | known, high=quantile(test, C.TARGET, C.HIGH_YIELD_QUANTILE))
    found = L.ranked(cv.join(held, "model"))
    errors = [c for c in cv.columns if c != "model"]
    holdout = [r6("r2").alias("holdout_r2") if c == "r2" else r6(c, 1e9).alias(f"holdout_{c}") for c in ("mae", "rmse", "r2", "high_yield_mae")]
    return found.select("model", *[r6(c, 1e9).alias(c) for c in errors], *holdout, F.col("high_yield_count").alias("holdout_high_yield_count"))


@query()
def holdout_comparison(spark, sf_dir):
    """Holdout metrics of every family, beside the baseline's. Held-out rows are derived once and scored by all families."""
    scored, names = _prepared(spark, sf_dir).test, list(L.registry(**SMALL))
    for name in names:
        scored = L.predict(_fitted(spark, sf_dir, name), scored).withColumnRenamed(M.PREDICTED, name)
    scored = materialise(scored.select(C.TARGET, *names))
    metrics = {name: M.sound_metrics(scored, f"{name} holdout", C.TARGET, name) for name in names}
    base = metrics["baseline"]["rmse"]
    rows = [(name, m["mae"], m["rmse"], m["r2"], base, m["rmse"] < base) for name, m in metrics.items()]
    return spark.createDataFrame(rows, "model string, mae double, rmse double, r2 double, baseline_rmse double, beats_baseline boolean")


def _importance(spark, sf_dir) -> DataFrame:
    features = _prepared(spark, sf_dir).features
    return spark.createDataFrame(L.importance(_fitted(spark, sf_dir, "random_forest"), features), "feature string, importance double")


@query()
def feature_importance(spark, sf_dir):
    return _importance(spark, sf_dir)


@query()
def top_features(spark, sf_dir):
    """The twelve most important features."""
    return _importance(spark, sf_dir).orderBy(F.desc("importance"), "feature").limit(12)


# Metrics, predictions, flags

_ERR = "neutron_yield - surrogate_yield"


@query(f"SELECT round(avg(abs({_ERR})) / 1e9, 6) AS mae, round(sqrt(avg(pow({_ERR}, 2))) / 1e9, 6) AS rmse, round(1e0 - sum(pow({_ERR}, 2)) / (count(*) * var_pop(neutron_yield)), 6) AS r2 FROM samples")
def regression_metrics(spark, sf_dir):
    return M.regression_metrics(X.samples(spark, sf_dir), C.TARGET, "surrogate_yield").select(r6("mae", 1e9).alias("mae"), r6("rmse", 1e9).alias("rmse"), r6("r2").alias("r2"))


@query("SELECT count(*) AS row_count, count(DISTINCT neutron_yield) AS distinct_targets, count(*) FILTER (WHERE tau IS NULL) AS bad_predictions FROM (SELECT *, confinement_time_s AS tau FROM dirty)")
def metric_guards(spark, sf_dir):
    return M.guards(X.derived(spark, sf_dir, "dirty"), C.TARGET, "confinement_time_s")


@query("""SELECT round(t / 1e9, 6) AS high_yield_threshold, count(*) FILTER (WHERE neutron_yield >= t) AS high_yield_count, round(avg(abs(neutron_yield - surrogate_yield)) FILTER (WHERE neutron_yield >= t) / 1e9, 6) AS high_yield_mae
  FROM samples CROSS JOIN (SELECT quantile_cont(neutron_yield, 9e-1) AS t FROM samples) GROUP BY t""")
def high_yield_metrics(spark, sf_dir):
    found = M.high_yield(X.samples(spark, sf_dir), C.TARGET, "surrogate_yield")
    return found.select(r6("high_yield_threshold", 1e9).alias("high_yield_threshold"), "high_yield_count", r6("high_yield_mae", 1e9).alias("high_yield_mae"))


@query(f"SELECT round(fuel_density_m3 / 1e20, 6) AS density, round(temperature_keV, 6) AS temperature_kev, round(neutron_yield / 1e9, 6) AS actual, round(surrogate_yield / 1e9, 6) AS predicted, round(({_ERR}) / 1e9, 6) AS residual FROM samples")
def prediction_frame(spark, sf_dir):
    df = M.prediction_frame(X.samples(spark, sf_dir), ["fuel_density_m3", "temperature_keV"], C.TARGET, "surrogate_yield")
    return df.select(r6("fuel_density_m3", 1e20).alias("density"), r6("temperature_keV").alias("temperature_kev"), r6(M.ACTUAL, 1e9).alias("actual"), r6(M.PREDICTED, 1e9).alias("predicted"), r6("residual", 1e9).alias("residual"))


@query(f"SELECT shot_id, k1, k2, k3, round(crude_yield / 1e9, 6) AS predicted, round({_TP} / 3e21, 6) AS lawson_ratio FROM samples WHERE crude_yield >= (SELECT quantile_cont(crude_yield, 9e-1) FROM samples) AND {_TP} / 3e21 < 5e-1")
def physics_mismatch(spark, sf_dir):
    """High predictions (of a crude model) where the Lawson ratio is low."""
    df = M.physics_mismatches(engineer(X.samples(spark, sf_dir)), "crude_yield")
    return df.select(*KEY[:-1], r6("crude_yield", 1e9).alias("predicted"), r6("lawson_ratio").alias("lawson_ratio"))


# Scoring

@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(median({c}) / {_scale(c)!r}::double, 6) AS default_value FROM samples" for c in C.BASE_FEATURES) + ")")
def feature_defaults(spark, sf_dir):
    df = X.samples(spark, sf_dir)
    found = R.feature_defaults(df, N.feature_columns(df.columns))
    return spark.createDataFrame([(c, v / _scale(c)) for c, v in found.items()], "feature string, default_value double").withColumn("default_value", rounded("default_value", 6))


_FILL = [c for c in C.OPTIONAL_INPUTS if c != "ne_20"]
_NE20_OWN = "CASE WHEN ne_20 IS NULL OR NOT abs(fuel_density_m3 / 1e20 - ne_20) > greatest(1e-3 * greatest(abs(fuel_density_m3 / 1e20), abs(ne_20)), 1e-6) THEN fuel_density_m3 / 1e20 END"
_FILLED_SQL = f"d AS (SELECT {', '.join(f'median({c}) AS d_{c}' for c in C.OPTIONAL_INPUTS)} FROM samples), q AS (SELECT shot_id, k1, k2, k3, fuel_density_m3, temperature_keV, confinement_time_s, trim('' {_BROKEN}) AS broken, coalesce({_NE20_OWN}, d_ne_20) AS ne_20, {', '.join(f'coalesce({c}, d_{c}) AS {c}' for c in _FILL)} FROM requests CROSS JOIN d)"


def _request_parts(spark, sf_dir) -> tuple[DataFrame, dict]:
    df = X.samples(spark, sf_dir)
    return X.derived(spark, sf_dir, "requests"), R.feature_defaults(df, list(C.BASE_FEATURES))


@query(f", {_FILLED_SQL} SELECT shot_id, k1, k2, k3, round(ne_20, 6) AS ne_20, {', '.join(f'round({c} / {_scale(c)!r}::double, 6) AS {c.lower()}' for c in _FILL)} FROM q")
def score_fill(spark, sf_dir):
    requests, defaults = _request_parts(spark, sf_dir)
    df = R.fill(R.validated(requests), defaults)
    return df.select(*KEY[:-1], r6("ne_20").alias("ne_20"), *[r6(c, _scale(c)).alias(c.lower()) for c in _FILL])


_GOOD = "broken = '' AND NOT coalesce(a_m >= R_m, false)"


@query(f", {_FILLED_SQL} SELECT shot_id, k1, k2, k3, round({_TP} / 3e21, 6) AS lawson_ratio, round(CASE WHEN Ip_MA > 0 AND a_m > 0 AND ne_20 > 0 THEN {_TAU} END, 6) AS tau_e_ipb98_s FROM q WHERE {_GOOD}")
def score_features(spark, sf_dir):
    """Features of the requests that are sound after defaults were filled in."""
    requests, defaults = _request_parts(spark, sf_dir)
    filled = materialise(R.fill(R.validated(requests), defaults))
    sound = filled.where((F.size("broken") == 0) & (F.size(R.broken_rules([c for c in filled.columns if c != "broken"])) == 0))
    return engineer(sound).select(*KEY[:-1], r6("lawson_ratio").alias("lawson_ratio"), r6("tau_E_ipb98_s").alias("tau_e_ipb98_s"))


@query(f", {_FILLED_SQL}, b AS (SELECT {_BASE} AS p FROM samples) SELECT shot_id, k1, k2, k3, CASE WHEN {_GOOD} THEN round(p / 1e9, 6) END AS predicted, CASE WHEN {_GOOD} THEN round({_TP} / 3e21, 6) END AS lawson_ratio, CASE WHEN {_GOOD} THEN CASE WHEN {_TP} / 3e21 >= 1 THEN 'IGNITION REACHED' ELSE 'SUB-CRITICAL' END END AS status, 'baseline' AS model_name FROM q CROSS JOIN b")
def batch_score(spark, sf_dir):
    """All requests scored by the baseline; those that break a rule are listed without a prediction."""
    requests, defaults = _request_parts(spark, sf_dir)
    model = L.fit_baseline(X.samples(spark, sf_dir), [])
    df = R.score(requests, model, defaults, "baseline")
    return df.select(*KEY[:-1], r6(M.PREDICTED, 1e9).alias("predicted"), r6("lawson_ratio").alias("lawson_ratio"), "status", "model_name")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots collapsed and described, with Lawson status and whether a high predicted yield contradicts the physics."""
    df = engineer(H.aggregate_shots(X.samples(spark, sf_dir), X.TIES))
    limit = quantile(df, "surrogate_yield", C.HIGH_YIELD_QUANTILE)
    flagged = df.withColumn("mismatch", (F.col("surrogate_yield") >= F.lit(limit).cast("double")) & (F.col("lawson_ratio") < C.LOW_LAWSON_RATIO))
    return flagged.select("shot_id", "triple_product", "lawson_ratio", P.lawson_status(F.col("lawson_ratio")).alias("status"), "tau_E_ipb98_s", C.TARGET, "mismatch")
