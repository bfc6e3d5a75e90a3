"""Learning from positives and unlabelled rows with a non-negative risk, in numpy, one classifier for each shard.

With class prior p, positives P and unlabelled rows U, the risk of a score f under the logistic loss l is

    p * mean_P l(f) + max(0, mean_U l(-f) - p * mean_P l(-f)).

The second term estimates the loss on negatives, which no row shows; where it would fall below zero it has started to
fit noise and is stepped back instead. Rows are dealt at random into shards of bounded size, a linear classifier is
fitted to each in a task of its own, and the weights are averaged: every row takes part, and no task or the driver holds
more than a shard or a weight vector. The two means of the risk are apart, so positives are dealt apart from unlabelled
rows: where they are too few for all shards, several shards get the same ones, and no shard is without. The prior is
estimated from the scores of positives and unlabelled rows (estimate_prior) unless the caller knows it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a shard, on average.
SHARD = 4096
#: Positives of a shard, on average, at least; fewer in all, and each shard gets all of them.
POSITIVES = 256
#: Tasks that fit shards, at most; and bins of scores from which the class prior is estimated.
MOST_TASKS, BINS = 2048, 1024


@dataclass(frozen=True)
class Linear:
    """sigmoid(bias + weights . x)"""

    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights + self.bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, positive: np.ndarray, prior: float, decay: float = 1e-3, steps: int = 400, rate: float = 0.05) -> Linear:
    """Minimise the non-negative risk over rows x (all are unlabelled; `positive` marks those known as positive too).

    Full gradients with Adam, so the result depends on the rows alone. Without a positive row the score is the prior.
    """
    return fit_apart(x, x[positive], prior, decay, steps, rate)


def fit_apart(x: np.ndarray, known: np.ndarray, prior: float, decay: float = 1e-3, steps: int = 400, rate: float = 0.05) -> Linear:
    """fit with unlabelled rows x and positive rows `known`, whether or not they are among x."""
    n, d = x.shape
    odds = float(np.log(prior / (1 - prior)))
    if not len(known):
        return Linear(np.zeros(d), odds)
    w, b = np.zeros(d), odds
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, steps + 1):
        zp, zu = known @ w + b, x @ w + b
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # gradients of the loss on positives, and of the estimated loss on negatives
        gp, gn = -prior * (1 - sp) / len(sp), (su / n, -prior * sp / len(sp))
        gain = np.r_[known.T @ gp, gp.sum()]
        loss = np.r_[x.T @ gn[0] + known.T @ gn[1], gn[0].sum() + gn[1].sum()]
        g = gain + loss if negative >= 0 else -loss
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Linear(w, float(b))


Features = Callable[[pd.Series], np.ndarray]


def fit_shards(rows: DataFrame, features: Features, width: int, prior: float, seed: int = 42, shard: int = SHARD, **options) -> Linear:
    """The average of classifiers fitted to shards of rows (id, x, positive); `features` makes the matrix of a column of x.

    Each shard has some of the positives, or all where they are few. No rows, or none that is positive: the score is
    the prior."""
    n, known = rows.agg(F.count("*"), F.count_if("positive")).first()
    if not known:
        return Linear(np.zeros(width), float(np.log(prior / (1 - prior))))
    shards = max(1, round(n / shard))
    copies = min(shards, -(-POSITIVES * shards // known))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        shown = group["positive"].to_numpy(bool)
        if shown.all() or not shown.any():
            return pd.DataFrame({"at": np.empty(0, np.int32), "weight": np.empty(0)})
        found = fit_apart(features(group["x"][~shown]), features(group["x"][shown]), prior, **options)
        return pd.DataFrame({"at": np.arange(width + 1, dtype=np.int32), "weight": np.r_[found.weights, found.bias]})

    own = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards))
    first = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(shards))
    dealt = rows.select("x", F.lit(False).alias("positive"), own.alias("shard"))
    dealt = dealt.unionByName(rows.where("positive").select("x", F.lit(True).alias("positive"), F.explode(F.sequence(first, first + copies - 1)).alias("shard")).withColumn("shard", F.pmod("shard", F.lit(shards))))
    # Tasks work on one shard after the other, so their number need not grow with the shards.
    means = dealt.repartition(min(shards, MOST_TASKS), "shard").groupBy("shard").applyInPandas(one, "at int, weight double").groupBy("at").agg(F.avg("weight").alias("weight")).collect()
    weights = np.zeros(width + 1)
    for row in means:
        weights[row["at"]] = row["weight"]
    return Linear(weights[:-1], float(weights[-1]))


def best_bin(positive: np.ndarray, every: np.ndarray) -> float:
    """The class prior from histograms of scores (equal bins, low to high) of positives and of all rows.

    Above any limit, all rows hold at least prior * the positives' share; where hardly a negative scores as high, the
    two shares differ by the prior alone. So the prior is the least ratio of the shares, with limits that keep few
    rows held back by the error that so few allow (best bin estimation).
    """
    n_p, n_u = positive.sum(), every.sum()
    if not n_p or not n_u:
        return 0.5
    p, u = np.cumsum(positive[::-1]) / n_p, np.cumsum(every[::-1]) / n_u
    p, u = p[p > 0], u[p > 0]
    error = np.sqrt(np.log(4 / 0.1) / (2 * n_u)) + np.sqrt(np.log(4 / 0.1) / (2 * n_p))
    at = int(np.argmin((u + 1.01 * error) / p))
    return float(min(0.99, max(0.01, u[at] / p[at])))


def estimate_prior(rows: DataFrame, features: Features, width: int, seed: int = 42, **options) -> float:
    """The share of positives among all rows (id, x, positive), from positive and unlabelled rows alone.

    Each half of the rows is scored by a classifier fitted to the other half, so no row is scored by what it taught. Labels
    other than the positives' are not looked at; positives must be a fair sample of all that are positive. Without a
    positive it is one half.
    """
    half = F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(2))
    counts = np.zeros((2, BINS), np.int64)
    for k in (0, 1):
        model = fit_shards(rows.where(half != k), features, width, 0.5, seed, **options)

        @F.pandas_udf("int")
        def bin_of(x: pd.Series) -> pd.Series:
            return pd.Series(np.minimum(BINS - 1, model.score(features(x)) * BINS).astype(np.int32) if len(x) else [], dtype=np.int32)

        for r in rows.where(half == k).select("positive", bin_of("x").alias("bin")).groupBy("positive", "bin").agg(F.count("*").alias("n")).collect():
            counts[1, r["bin"]] += r["n"]
            if r["positive"]:
                counts[0, r["bin"]] += r["n"]
    return best_bin(*counts)
