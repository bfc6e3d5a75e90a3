"""Toxicity by non-negative positive-unlabelled learning on the words of whole texts.

Confirmed toxic examples are rows labelled 1; every row of the training part is unlabelled text. A bounded number of
toxic examples proposes words and beginnings of words; how often texts hold each of them is counted over all rows; those
that most prefer toxic texts become features, and numpy classifiers are fitted to shards of all rows with the risk and the
class prior of pu. Rows labelled 0 are never looked at as such.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toroid.llm.common import materialise
from toroid.llm.pu import Linear, estimate_prior, fit_shards

THRESHOLD = 0.5
#: Weight of the squared weights in the fit, and its steps.
DECAY, STEPS = 2e-4, 300
#: Labelled toxic examples that propose words, at most; and the share of them (and number) that must hold a word. So words
#: proposed are at most 1 / SHARE times those of an average example.
EXAMPLES, SHARE, LEAST = 20_000, 0.01, 3
#: Features, at most; and how far (in standard errors) a word must prefer toxic texts.
FEATURES, SURE = 512, 4.0
#: Letters of the beginnings of words that are looked at beside whole words.
STEMS = (4, 5, 6, 7)
_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> dict[str, int]:
    """What is looked at in a text: its distinct words (runs of letters, lower-cased), counted once each, and their beginnings.

    A beginning stands for a stem, as `stem-`, and is counted by the distinct words that share it: a stem that chance makes
    once is seldom made often.
    """
    whole = set(_WORDS.findall((text or "").lower()))
    found = dict.fromkeys(whole, 1)
    for n in STEMS:
        for w in whole:
            if len(w) > n:
                stem = w[:n] + "-"
                found[stem] = found.get(stem, 0) + 1
    return found


class Lookup:
    """Finds known words and stems in a text; most words are passed over by their first letters."""

    def __init__(self, numbers: dict[str, int]):
        self.whole = {w: i for w, i in numbers.items() if not w.endswith("-")}
        self.stems = {w[:-1]: i for w, i in numbers.items() if w.endswith("-")}
        self.first = {s[: min(STEMS)] for s in self.stems}

    def present(self, text: str | None) -> list[int]:
        """The numbers of words(text) that are known, in order, each as often as it is counted."""
        whole = set(_WORDS.findall((text or "").lower()))
        found, stems, first, shortest = [self.whole[w] for w in whole & self.whole.keys()], self.stems, self.first, min(STEMS)
        for w in [w for w in whole if w[:shortest] in first]:
            found += [stems[w[:n]] for n in STEMS if len(w) > n and w[:n] in stems]
        return sorted(found)


def features(lists: list[list[int]], width: int) -> np.ndarray:
    """One row for each list of numbers: log2(1 + how often a number is in it)."""
    at = np.repeat(np.arange(len(lists)), [len(x) for x in lists]) * width + np.fromiter((i for x in lists for i in x), np.int64)
    return np.log2(1 + np.bincount(at, minlength=len(lists) * width)).reshape(len(lists), width)


@dataclass(frozen=True)
class Toxicity:
    vocabulary: dict[str, int]
    linear: Linear
    prior: float = 0.5

    def score(self, texts: list[str | None]) -> np.ndarray:
        lookup, width = Lookup(self.vocabulary), len(self.vocabulary)
        return np.concatenate([np.empty(0), *(self.linear.score(features([lookup.present(t) for t in texts[i : i + 1024]], width)) for i in range(0, len(texts), 1024))])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [w for t in batch.column(0).to_pylist() for w in words(t)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["word"])


def _sums(width: int):
    """For each number of a partition's lists, by whether the row is positive: sum and sum of squares of its values, and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 2, width))
        for batch in batches:
            lists, positive = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            key, n = np.unique(row * width + lists.flatten().to_numpy(zero_copy_only=False), return_counts=True)
            value, kind = np.log2(1 + n), positive[key // width]
            for k in (0, 1):
                own, v = key[kind == k] % width, value[kind == k]
                held[k, 0] += np.bincount(own, v, width)
                held[k, 1] += np.bincount(own, v * v, width)
        for k in (0, 1):
            some = np.flatnonzero(held[k, 0])
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), bool(k))), pa.array(held[k, 0, some]), pa.array(held[k, 1, some])], ["at", "positive", "s", "q"])

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None) -> Toxicity:
    """A classifier from docs (all taken as unlabelled) and labels, of which only the ones are used as examples.

    The caller keeps held-out rows out of both tables. Labels that repeat for an id count as their maximum; null labels,
    labels without a document, and null ids (which match none) are ignored. prior is the share of toxic texts where it
    is known; else it is estimated. Without toxic examples every score is the prior, one half if it isn't given. Other
    columns, whatever their names, are not read.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    toxic = materialise(labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")).where("label = 1").select("id"))
    examples = F.broadcast(toxic.orderBy(F.xxhash64("id"), "id").limit(EXAMPLES))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shown = materialise(rows.join(examples, "id").select("text"))
    n_shown = shown.count()
    counted = shown.mapInArrow(_split, "word string").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= max(LEAST, n_shown * SHARE))
    proposed = sorted(r["word"] for r in counted.select("word").collect())
    held = spark.sparkContext.broadcast({w: i for i, w in enumerate(proposed)})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(held.value)
        for batch in batches:
            found = [lookup.present(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["id", "x"])

    present = rows.mapInArrow(find, f"id {id_type}, x array<int>").join(toxic.withColumn("positive", F.lit(True)), "id", "left")
    present = materialise(present.select("id", "x", F.coalesce("positive", F.lit(False)).alias("positive")))
    n_all, n_toxic = present.agg(F.count("*"), F.count_if("positive")).first()
    sums, squares, own = np.zeros(len(proposed)), np.zeros(len(proposed)), np.zeros(len(proposed))
    for r in present.select("x", "positive").mapInArrow(_sums(max(1, len(proposed))), "at int, positive boolean, s double, q double").groupBy("at", "positive").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).collect():
        sums[r["at"]] += r["s"]
        squares[r["at"]] += r["q"]
        if r["positive"]:
            own[r["at"]] += r["s"]
    mean = sums / max(1, n_all)
    spread = np.sqrt(np.maximum(squares / max(1, n_all) - mean**2, 1e-9) / max(1, n_toxic))
    sure = (own / max(1, n_toxic) - mean) / spread
    best = sorted(np.flatnonzero(sure >= SURE).tolist(), key=lambda i: (-sure[i], proposed[i]))[:FEATURES]
    chosen = sorted(best)
    width = len(chosen)
    new = np.full(len(proposed) + 1, -1, np.int32)
    new[chosen] = np.arange(width)

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            found = new[lists.flatten().to_numpy(zero_copy_only=False)]
            before = np.r_[0, np.cumsum(found >= 0)]
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), pa.array(found[found >= 0])), batch.column(2)], ["id", "x", "positive"])

    def matrix(x: pd.Series) -> np.ndarray:
        return features(x.tolist(), width)

    train = materialise(present.mapInArrow(renumber, f"id {id_type}, x array<int>, positive boolean"))
    options = {"decay": DECAY, "steps": STEPS}
    prior = estimate_prior(train, matrix, width, **options) if prior is None else prior
    return Toxicity({proposed[i]: k for k, i in enumerate(chosen)}, fit_shards(train, matrix, width, prior, **options), prior)


def toxicity_score(model: Toxicity, text: Column) -> Column:
    """The chance that a text is toxic (0 to 1); null and empty texts have a score too."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()), dtype=float)

    return score(text.cast("string"))
