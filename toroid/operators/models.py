"""Model families on log-scaled yield, as spark.ml pipelines that impute, predict and scale back.

A family is a function from a training table and feature names to a fitted PipelineModel that adds
predicted_neutron_yield to any table with those features.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toroid import config as C
from toroid.operators import boosting as B
from toroid.operators.forest import fit_forest, grow_forest
from toroid.operators.metrics import PREDICTED, fold_summary, sound_fold_metrics, sound_metrics
from toroid.operators.quantiles import fold_quantiles, quantile, quantiles

Family = Callable[[DataFrame, list[str]], PipelineModel]
_LOG, _LABEL = "_log_prediction", "_label"
#: Medians of features and of the log-scaled target, by name.
Medians = dict[str, float | None]
#: The log-scaled target's name among medians.
LABEL = _LABEL
FOLD_COLUMNS = "model string, fold int, mae double, rmse double, r2 double"


def medians(df: DataFrame, columns: list[str], exact: bool = True) -> Medians:
    """The median of each column, all columns together; None where it is all missing."""
    return quantiles(df, {c: (F.col(c), 0.5) for c in columns}, exact)


def training_medians(df: DataFrame, features: list[str], exact: bool = True) -> Medians:
    """The medians of features and log-scaled target, which all families can share."""
    return medians(log_label(df), [*features, _LABEL], exact)


def fold_medians(df: DataFrame, features: list[str], folds: int, exact: bool = True) -> dict[int, Medians]:
    """For each fold the medians of features and log-scaled target over the rows of the other folds, all in one set of passes."""
    return fold_quantiles(log_label(df), {c: (F.col(c), 0.5) for c in [*features, _LABEL]}, "fold", folds, exact)


def impute(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """df with missing values of the columns replaced; a column whose value is None stays as it is."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None})


def _back(columns: list[str] = ()) -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT *, expm1({_LOG}) AS {PREDICTED} FROM __THIS__")


def log_label(df: DataFrame) -> DataFrame:
    return df.withColumn(_LABEL, F.log1p(F.col(C.TARGET)))


@dataclass(frozen=True)
class Baseline:
    """Predicts the median of the log-scaled target."""

    exact: bool = True

    def __call__(self, df: DataFrame, features: list[str], values: Medians | None = None) -> PipelineModel:
        middle = values[_LABEL] if values else quantile(log_label(df), _LABEL, 0.5, self.exact)
        return PipelineModel([SQLTransformer(statement=f"SELECT *, {middle!r}D AS {_LOG} FROM __THIS__"), _back()])


@dataclass(frozen=True)
class Forest:
    """A random forest over median-imputed features, all of which are tried at every split."""

    trees: int = 400
    depth: int = 14
    bins: int = 255
    exact: bool = True

    def __call__(self, df: DataFrame, features: list[str], values: Medians | None = None) -> PipelineModel:
        fills = {c: v for c in features if (v := (values or {}).get(c)) is not None} if values else {c: v for c, v in medians(df, features, self.exact).items() if v is not None}
        if not fills:
            raise ValueError("every feature is missing in all rows")
        return PipelineModel([fit_forest(log_label(df), list(fills), _LABEL, fills, trees=self.trees, depth=self.depth, bins=self.bins, output=_LOG), _back()])

    def of(self, table: B.Binned) -> PipelineModel:
        return PipelineModel([grow_forest(table, trees=self.trees, depth=self.depth, output=_LOG), _back()])


@dataclass(frozen=True)
class Boosting:
    """Histogram gradient boosting: trees of at most `leaves` leaves that grow leaf by leaf, early stop on large tables."""

    rounds: int = 350
    depth: int = 8
    bins: int = 255
    leaves: int = B.MOST
    early_rows: int = B.EARLY_ROWS
    rate: float = B.RATE
    exact: bool = True

    def _fitted(self, df: DataFrame, features: list[str], values: dict[int | None, Medians], edges: dict[str, list[float]] | None = None, then: Callable[[DataFrame], list[tuple]] | None = None) -> tuple[dict[int | None, PipelineModel], B.Passes]:
        rows = log_label(df)
        counts = {r[0]: r[1] for r in rows.groupBy("fold").count().collect()} if "fold" in df.columns else {}
        total = sum(counts.values()) or rows.count()
        sizes = {k: total - counts.get(k, 0) if k is not None else total for k in values}
        models, passes = B.fit_models(rows, features, _LABEL, values, sizes, rounds=self.rounds, depth=self.depth, bins=self.bins, leaves=self.leaves, early_rows=self.early_rows, rate=self.rate, edges=edges, output=_LOG, then=then)
        return {k: PipelineModel([m, _back()]) for k, m in models.items()}, passes

    def __call__(self, df: DataFrame, features: list[str], values: Medians | None = None) -> PipelineModel:
        return self._fitted(df, features, {None: values or medians(df, features, self.exact)})[0][None]

    def _grown(self, table: B.Binned, then: Callable[[DataFrame], list[tuple]] | None = None) -> tuple[dict[int | None, B.BoostedTrees], B.Passes]:
        return B.grow_models(table, rounds=self.rounds, depth=self.depth, leaves=self.leaves, early_rows=self.early_rows, rate=self.rate, output=_LOG, then=then)

    def of(self, table: B.Binned) -> PipelineModel:
        return PipelineModel([self._grown(table)[0][None], _back()])

    def folds(self, df: DataFrame, features: list[str], values: dict[int, Medians]) -> dict[int, PipelineModel]:
        """A model for each fold, of the rows of the other folds; all grow side by side in shared passes."""
        return self._fitted(df, features, values)[0]

    def fold_errors(self, df: DataFrame, features: list[str], values: dict[int, Medians], name: str) -> list[tuple]:
        """(name, fold, mae, rmse, r2) of those models over the rows that they do not see."""
        return self._fitted(df, features, values, then=_errors(name, list(values)))[1].found

    def fold_errors_of(self, table: B.Binned, name: str) -> list[tuple]:
        return self._grown(table, _errors(name, list(table.fills)))[1].found


def _errors(name: str, folds: list[int]) -> Callable[[DataFrame], list[tuple]]:
    """From what folds' models make of the rows that they do not see, as they are scored already, the errors of each fold. Targets
    are taken back from the log-scaled ones."""
    def found(rows: DataFrame) -> list[tuple]:
        scaled = rows.select("fold", F.expm1("label").alias(C.TARGET), F.expm1("score").alias(PREDICTED))
        return sound_fold_metrics(scaled, name, folds, C.TARGET, PREDICTED)

    return found


fit_baseline = Baseline()


def fit_random_forest(df: DataFrame, features: list[str], trees: int = 400, depth: int = 14, bins: int = 255, exact: bool = True) -> PipelineModel:
    return Forest(trees, depth, bins, exact)(df, features)


def fit_boosting(df: DataFrame, features: list[str], rounds: int = 350, depth: int = 8, bins: int = 255, exact: bool = True) -> PipelineModel:
    return Boosting(rounds, depth, bins, exact=exact)(df, features)


def registry(trees: int = 400, tree_depth: int = 14, rounds: int = 350, boost_depth: int = 8, bins: int = 255, exact: bool = True) -> dict[str, Family]:
    return {"baseline": Baseline(exact), "random_forest": Forest(trees, tree_depth, bins, exact), "hist_gradient_boosting": Boosting(rounds, boost_depth, bins, exact=exact)}


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with predicted_neutron_yield and nothing else added."""
    return model.transform(df).select(*df.columns, PREDICTED)


def cross_validate(df: DataFrame, features: list[str], fit: Family, folds: int, name: str, threads: int = 3, values: dict[int, Medians] | None = None) -> DataFrame:
    """(model, cv_rmse_mean, cv_rmse_std, cv_mae_mean, cv_mae_std); df has fold, and is best stored or cached before.

    values: fold_medians(), which all families share; they are taken here where they are not given. A fold whose target is constant, or whose
    predictions or errors are not finite, raises.
    """
    ours = isinstance(fit, (Baseline, Forest, Boosting))
    if ours and values is None:
        values = fold_medians(df, [] if isinstance(fit, Baseline) else features, folds, fit.exact)
    if isinstance(fit, Boosting):
        return fold_summary(df.sparkSession.createDataFrame(fit.fold_errors(df, features, {k: values[k] for k in range(folds)}, name), FOLD_COLUMNS))

    def one(k: int) -> tuple:
        rest = df.where(F.col("fold") != k)
        model = fit(rest, features, values[k]) if ours else fit(rest, features)
        found = sound_metrics(predict(model, df.where(F.col("fold") == k)), f"{name}, fold {k}", C.TARGET, PREDICTED)
        return name, k, found["mae"], found["rmse"], found["r2"]

    with ThreadPoolExecutor(threads) as pool:
        return fold_summary(df.sparkSession.createDataFrame(list(pool.map(one, range(folds))), FOLD_COLUMNS))


def ranked(metrics: DataFrame) -> DataFrame:
    """Best first: by mean rmse, then mean mae, then name."""
    return metrics.orderBy("cv_rmse_mean", "cv_mae_mean", "model")


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) from large to small; zeros for a family without importances or an unused feature."""
    found = {c: v for s in model.stages if isinstance(s, B.BoostedTrees) for c, v in s.importances.items()}
    return sorted(((c, found.get(c, 0.0)) for c in features), key=lambda x: (-x[1], x[0]))
