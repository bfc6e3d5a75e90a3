"""Engineered features, one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toroid import config as C
from toroid.functions import physics as P
from toroid.functions.numbers import no_nan

_IPB98 = ("Ip_MA", "Bt_T", "R_m", "a_m", "kappa", "Pin_MW")


def feature_expressions(columns: list[str]) -> dict[str, Column]:
    """Name -> expression for the features that a table with these columns can have."""
    density, kev, tau = (F.col(c) for c in C.REQUIRED_INPUTS)
    product = P.triple_product(density, kev, tau)
    purity = F.col("fuel_purity") if "fuel_purity" in columns else F.lit(1.0)
    out = {
        "triple_product": product, "lawson_ratio": P.lawson_ratio(product), "density_temp": density * kev, "density_tau": density * tau, "purity_weighted_density": density * purity,
        "log_fuel_density_m3": F.log1p(density), "log_temperature_keV": F.log1p(kev), "log_confinement_time_s": F.log1p(tau), "log_triple_product": F.log1p(product),
    }
    for c in ("energy_input_MJ", "pressure_Pa"):
        if c in columns:
            out[f"log_{c}"] = F.log1p(F.col(c))
    if C.TARGET in columns:
        # greatest() passes over null, and a missing target must stay missing
        out[C.LOG_TARGET] = F.when(F.col(C.TARGET).isNotNull(), F.log1p(F.greatest(F.col(C.TARGET), F.lit(0.0))))
    if set(_IPB98) <= set(columns):
        ne20 = F.col("ne_20") if "ne_20" in columns else density / F.lit(1e20)
        mass = F.col("M_amu") if "M_amu" in columns else F.lit(C.DEFAULT_ION_MASS)
        ip, bt, r, a, kappa, power = (F.col(c) for c in _IPB98)
        out["tau_E_ipb98_s"] = P.ipb98_confinement(ip, bt, r, a, kappa, ne20, mass, power)
    return {k: no_nan(v) for k, v in out.items()}


def engineer(df: DataFrame) -> DataFrame:
    """df with its features. The table counts as validated; a supplied tau_E_ipb98_s stays where it can't be computed."""
    return df.withColumns(feature_expressions(df.columns))
