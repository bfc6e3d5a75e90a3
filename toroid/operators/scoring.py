"""Scoring of operating points in bulk: validate, fill defaults, derive features, predict, Lawson status. All narrow steps."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toroid import config as C
from toroid.functions import physics as P
from toroid.operators import validate as V
from toroid.operators.features import engineer
from toroid.operators.metrics import PREDICTED
from toroid.operators.models import medians, predict


def request_checks(columns: list[str]) -> list[V.Check]:
    return V.checks(columns, C.REQUIRED_INPUTS, tuple(c for c in C.OPTIONAL_INPUTS if c in columns))


def broken_rules(columns: list[str]) -> Column:
    """Array of `field:rule` that a request breaks."""
    return F.array_compact(F.array(*[F.when(c.wrong, F.lit(c.name)) for c in request_checks(columns)]))


def with_kev(requests: DataFrame) -> DataFrame:
    """requests with temperature_keV from temperature and temperature_unit where they have no such column."""
    if "temperature_keV" in requests.columns:
        return requests
    return requests.withColumn("temperature_keV", P.to_kev(F.col("temperature"), F.col("temperature_unit")))


def validated(requests: DataFrame) -> DataFrame:
    """requests with `broken` (empty if all is well) and ne_20 derived from the density where it is absent or agrees."""
    requests = with_kev(requests)
    given = F.col("ne_20") if "ne_20" in requests.columns else F.lit(None).cast("double")
    checked = requests.withColumn("broken", broken_rules(requests.columns))
    return checked.withColumn("ne_20", V.derive_ne20(F.col("fuel_density_m3"), given))


def feature_defaults(df: DataFrame, features: list[str], exact: bool = True) -> dict[str, float | None]:
    """The median of every feature over the prepared rows."""
    return medians(df, features, exact)


def fill(requests: DataFrame, defaults: dict[str, float | None]) -> DataFrame:
    """Optional inputs that are absent or missing get their default; required ones are never filled, engineered ones never taken."""
    wanted = [c for c in C.OPTIONAL_INPUTS if c in defaults or c in requests.columns]
    given = {c: F.col(c) if c in requests.columns else F.lit(None).cast("double") for c in wanted}
    return requests.withColumns({c: F.coalesce(given[c], F.lit(defaults.get(c)).cast("double")) for c in wanted})


def score(requests: DataFrame, model: PipelineModel, defaults: dict[str, float | None], model_name: str) -> DataFrame:
    """requests with predicted_neutron_yield, triple_product, lawson_ratio, status, model_name and `broken`.

    A request that breaks a rule, as it came or after defaults were filled in, is listed with the rules and no prediction.
    """
    names = requests.columns
    checked = validated(requests).withColumn("_own_ne_20", F.col("ne_20"))
    filled = fill(checked, defaults)
    filled = filled.withColumn("broken", F.array_union("broken", broken_rules([c for c in filled.columns if c not in ("broken", "_own_ne_20")])))
    scored = predict(model, engineer(filled))
    good = F.size("broken") == 0
    out = {c: F.when(good, F.col(c)) for c in (PREDICTED, "triple_product", "lawson_ratio")}
    scored = scored.withColumns(out).withColumn("status", P.lawson_status(F.col("lawson_ratio"))).withColumn("model_name", F.lit(model_name))
    return scored.select(*names, PREDICTED, "triple_product", "lawson_ratio", "status", "model_name", "broken")


def require_valid_requests(requests: DataFrame, row_key: list[str]) -> None:
    """Raise before any model is loaded if a request breaks a rule."""
    V.require_valid(with_kev(requests), row_key, C.REQUIRED_INPUTS, C.OPTIONAL_INPUTS)
