"""Exact quantiles of whole tables in bounded memory.

A percentile aggregate holds every distinct value of a column in one buffer. Here a sample brackets the wanted rank, a
count makes sure that it does, and the bracket is cut into bins, the bin that holds the rank is cut again, and so on
until the rank's value is known. A pass counts BINS rows for a column, whatever the size of the table, and works only on
rows in a bracket, which are few.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 2048
#: Bins of a pass over folds, for each column and range.
FOLD_BINS = 512
#: Relative accuracy of the approximate way is one in this number of rows.
ACCURACY = 10_000
#: Rows of the sample that brackets ranks (about), and how far (as a share of all rows) a bracket reaches to both sides: more than
#: four standard deviations. A bracket that misses its rank costs passes, never the result.
SAMPLE, REACH = 50_000, 0.01


class _Search:
    """The values of ranks k and k + 1 (from 0) of one column, with the range they are known to lie in."""

    def __init__(self, n: int, low_infinite: int, high_infinite: int, low: float | None, high: float | None, share: float):
        at = share * (n - 1)
        self.k, self.part = math.floor(at), at - math.floor(at)
        self.low, self.high, self.below = low, high, low_infinite
        self.found: dict[int, float] = {}
        for rank in self.ranks():
            if rank < low_infinite:
                self.found[rank] = -math.inf
            elif rank >= n - high_infinite:
                self.found[rank] = math.inf
            elif low == high:
                self.found[rank] = low

    def bracket(self, low: float | None, high: float | None, below: int, above: int, n: int) -> None:
        """Look only between low and high if the ranks lie there; below and above are the rows outside."""
        if low is None or any(not below <= r < n - above for r in self.open()):
            return
        self.low, self.high, self.below = low, high, below
        if low == high:
            self.found |= dict.fromkeys(self.open(), low)

    def ranks(self) -> list[int]:
        return [self.k, self.k + 1] if self.part else [self.k]

    def open(self) -> list[int]:
        return [r for r in self.ranks() if r not in self.found]

    def narrow(self, bins: list[tuple[int, int, float, float]]) -> None:
        """Take (bin, count, min, max) of the current range; afterwards the range is the bin of the first open rank."""
        first = self.open()[0]
        start, within = self.below, None
        for _, count, low, high in sorted(bins):
            for rank in self.open():
                if start <= rank < start + count:
                    if low == high or count == 1:
                        self.found[rank] = low
                    elif rank == start:
                        self.found[rank] = low
                    elif rank == start + count - 1:
                        self.found[rank] = high
                    elif rank == first or first in self.found:
                        within = within or (start, low, high)
            start += count
        if self.open():
            self.below, self.low, self.high = within

    def value(self) -> float:
        a = self.found[self.k]
        return a if not self.part else (1 - self.part) * a + self.part * self.found[self.k + 1]


def _brackets(rows: DataFrame, shares: dict[int, float], n: int) -> dict[int, tuple[float, float]]:
    """Values of a bounded sample around the wanted rank of each column q0, q1, ...; columns without finite values are left out."""
    if not shares:
        return {}
    found = rows.select(*[f"q{i}" for i in shares]).sample(min(1.0, SAMPLE / n), seed=1).toArrow()
    out = {}
    for i, share in shares.items():
        v = found.column(f"q{i}").to_numpy().astype(float)
        v = v[np.isfinite(v)]
        if len(v):
            out[i] = (float(np.quantile(v, max(0.0, share - REACH), method="lower")), float(np.quantile(v, min(1.0, share + REACH), method="higher")))
    return out


def _bin(c: Column, low: float, high: float, bins: int) -> Column:
    """The bin of a value between low and high; halves, so that the range of the largest doubles doesn't overflow."""
    return F.least(F.lit(bins - 1), F.floor((c / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2) * bins)).cast("int")


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], exact: bool = True) -> dict[str, float | None]:
    """The interpolated quantile of each named expression; missing values are left out, None where there is nothing else.

    exact=False takes one pass with a bounded sketch and gives a value that occurs.
    """
    if not wanted:
        return {}
    names = list(wanted)
    rows = df.select(*[wanted[name][0].cast("double").alias(f"q{i}") for i, name in enumerate(names)])
    if not exact:
        found = rows.agg(*[F.percentile_approx(f"q{i}", wanted[name][1], ACCURACY).alias(f"q{i}") for i, name in enumerate(names)]).first()
        return dict(zip(names, found))
    inf = F.lit(math.inf)
    first = []
    for i in range(len(names)):
        c = F.col(f"q{i}")
        fine = F.when(F.abs(c) < inf, c)
        first.append(F.struct(F.count(c), F.count_if(c == -inf), F.count_if(c == inf), F.min(fine), F.max(fine)).alias(f"q{i}"))
    ranges = rows.agg(*first).first()
    searches = {i: _Search(*ranges[i][:5], wanted[name][1]) for i, name in enumerate(names) if ranges[i][0]}
    if rough := _brackets(rows, {i: wanted[names[i]][1] for i, s in searches.items() if s.open()}, max(r[0] for r in ranges)):
        outside = rows.agg(*[F.struct(F.count_if(F.col(f"q{i}") < F.lit(a)), F.count_if(F.col(f"q{i}") > F.lit(b))).alias(f"q{i}") for i, (a, b) in rough.items()]).first()
        for i, (a, b) in rough.items():
            searches[i].bracket(a, b, *outside[f"q{i}"], ranges[i][0])
    while still := {i: s for i, s in searches.items() if s.open()}:
        parts, near = [], F.lit(False)
        for i, s in still.items():
            c = F.col(f"q{i}")
            inside = (c >= F.lit(s.low)) & (c <= F.lit(s.high))
            near = near | inside
            parts.append(F.when(inside, F.struct(F.lit(i).alias("column"), _bin(c, s.low, s.high, BINS).alias("bin"), c.alias("value"))))
        counted = rows.where(near).select(F.explode(F.array_compact(F.array(*parts))).alias("p")).groupBy("p.column", "p.bin").agg(F.count("*").alias("n"), F.min("p.value").alias("low"), F.max("p.value").alias("high"))
        bins: dict[int, list] = {i: [] for i in still}
        for r in counted.collect():
            bins[r["column"]].append((r["bin"], r["n"], r["low"], r["high"]))
        for i, s in still.items():
            s.narrow(bins[i])
    return {name: searches[i].value() if i in searches else None for i, name in enumerate(names)}


def quantile(df: DataFrame, column: Column | str, share: float, exact: bool = True) -> float | None:
    c = F.col(column) if isinstance(column, str) else column
    return quantiles(df, {"q": (c, share)}, exact)["q"]


def fold_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], fold: str, folds: int, exact: bool = True) -> dict[int, dict[str, float | None]]:
    """For each fold 0..folds-1 the quantiles of the rows of the other folds (rows without a fold are in every one).

    Rows are counted by their own fold, once, and what a fold does not see is taken off the whole, so all folds and columns
    share three or four passes. Searches of one column share their bracket; bins that hold different folds' ranks are
    cut on their own. exact=False takes one pass with a bounded sketch for each fold and column.
    """
    if not wanted:
        return {k: {} for k in range(folds)}
    names = list(wanted)
    rows = df.select(F.coalesce(F.col(fold), F.lit(-1)).alias("fold"), *[wanted[name][0].cast("double").alias(f"q{i}") for i, name in enumerate(names)])
    if not exact:
        found = rows.agg(*[F.percentile_approx(F.when(F.col("fold") != k, F.col(f"q{i}")), wanted[name][1], ACCURACY).alias(f"q{k}_{i}") for k in range(folds) for i, name in enumerate(names)]).first()
        return {k: {name: found[f"q{k}_{i}"] for i, name in enumerate(names)} for k in range(folds)}
    inf, first = F.lit(math.inf), []
    for i in range(len(names)):
        c = F.col(f"q{i}")
        fine = F.when(F.abs(c) < inf, c)
        first.append(F.struct(F.count(c), F.count_if(c == -inf), F.count_if(c == inf), F.min(fine), F.max(fine)).alias(f"q{i}"))
    by_fold = {r["fold"]: r for r in rows.groupBy("fold").agg(*first).collect()}

    def others(k: int) -> list[int]:
        return [f for f in by_fold if f != k]

    def least(values: list[float | None]) -> float | None:
        return min((v for v in values if v is not None), default=None)

    def most(values: list[float | None]) -> float | None:
        return max((v for v in values if v is not None), default=None)

    searches: dict[tuple[int, int], _Search] = {}
    for i, name in enumerate(names):
        for k in range(folds):
            own = [by_fold[f][f"q{i}"] for f in others(k)]
            n, low_inf, high_inf = (sum(r[j] for r in own) for j in range(3))
            if n:
                searches[i, k] = _Search(n, low_inf, high_inf, least([r[3] for r in own]), most([r[4] for r in own]), wanted[name][1])
    total = max((sum(r[f"q{i}"][0] for r in by_fold.values()) for i in range(len(names))), default=0)
    if rough := _brackets(rows, {i: wanted[names[i]][1] for i in sorted({i for (i, _), s in searches.items() if s.open()})}, total):
        outside = {r["fold"]: r for r in rows.groupBy("fold").agg(*[F.struct(F.count_if(F.col(f"q{i}") < F.lit(a)), F.count_if(F.col(f"q{i}") > F.lit(b))).alias(f"q{i}") for i, (a, b) in rough.items()]).collect()}
        for (i, k), s in searches.items():
            if s.open() and i in rough:
                below, above = (sum(outside[f][f"q{i}"][j] for f in others(k)) for j in range(2))
                s.bracket(*rough[i], below, above, sum(by_fold[f][f"q{i}"][0] for f in others(k)))
    while still := {at: s for at, s in searches.items() if s.open()}:
        ranges = sorted({(i, s.low, s.high) for (i, _), s in still.items()})
        number = {r: j for j, r in enumerate(ranges)}
        parts, near = [], F.lit(False)
        for j, (i, low, high) in enumerate(ranges):
            c = F.col(f"q{i}")
            inside = (c >= F.lit(low)) & (c <= F.lit(high))
            near = near | inside
            parts.append(F.when(inside, F.struct(F.lit(j).alias("range"), _bin(c, low, high, FOLD_BINS).alias("bin"), c.alias("value"))))
        counted = rows.where(near).select("fold", F.explode(F.array_compact(F.array(*parts))).alias("p")).groupBy("p.range", "p.bin", "fold").agg(F.count("*").alias("n"), F.min("p.value").alias("low"), F.max("p.value").alias("high"))
        bins: dict[int, dict[int, dict[int, tuple]]] = {}
        for r in counted.collect():
            bins.setdefault(r["range"], {}).setdefault(r["bin"], {})[r["fold"]] = (r["n"], r["low"], r["high"])
        for (i, k), s in still.items():
            own = bins[number[i, s.low, s.high]]
            seen = []
            for b, by in own.items():
                rest = [v for f, v in by.items() if f != k]
                if rest:
                    seen.append((b, sum(v[0] for v in rest), min(v[1] for v in rest), max(v[2] for v in rest)))
            s.narrow(seen)
            if s.open():  # the whole bin, other folds' values too: so searches in one bin keep one range
                by = next(by for by in own.values() if min(v[1] for v in by.values()) <= s.low <= max(v[2] for v in by.values()))
                s.low, s.high = min(v[1] for v in by.values()), max(v[2] for v in by.values())
    return {k: {name: searches[i, k].value() if (i, k) in searches else None for i, name in enumerate(names)} for k in range(folds)}
