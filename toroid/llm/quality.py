"""Quality classifier by positive-unlabelled learning on surface statistics of whole texts.

Trusted positives are rows labelled 1; every row of the training part, whatever its label, is unlabelled web text. Rows
labelled 0 are never looked at as such. See pu for the risk, the class prior and the fit.

A text is described by statistics of its words and lines, the shares of kinds of bytes (each ASCII mark is a kind, and so
are small and capital letters, digits, spaces, line feeds, other control characters and parts of wide characters), and
the shares of pairs of kinds that stand side by side, hashed into PAIRS buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toroid.llm.common import materialise
from toroid.llm.pu import Linear, estimate_prior, fit_shards

THRESHOLD = 0.3
#: Rows of a shard, weight of the squared weights in the fit, and its steps.
SHARD, DECAY, STEPS = 16_384, 3e-4, 250
NAMES = ("words", "bytes", "lines", "word_length", "distinct_words", "top_word", "repeated_lines", "long_words", "short_words", "capital_words", "empty")
PAIRS = 128


def _kinds() -> np.ndarray:
    """The kind of each byte value."""
    kind = np.zeros(256, np.int64)  # control characters
    kind[[32, 10]] = 1, 2
    kind[range(48, 58)], kind[range(65, 91)], kind[range(97, 123)] = 3, 4, 5
    kind[range(128, 192)], kind[range(192, 256)] = 6, 7
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    kind[marks] = 8 + np.arange(len(marks))
    return kind


_KIND = _kinds()
KINDS = int(_KIND.max()) + 1
_BUCKET = (np.arange(KINDS * KINDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIRS.bit_length() + 1)).astype(np.int64)
#: Numbers that describe a text, and features made of them (squares of the statistics are added).
RAW = len(NAMES) + KINDS + PAIRS
WIDTH = RAW + len(NAMES)


def statistics(data: bytes) -> list[float]:
    """Statistics of a UTF-8 text, in the order of NAMES: shares and logarithms, all 0 but `empty` where it has no word."""
    words = data.split()
    if not words:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = data.split(b"\n")
    return [
        np.log1p(n), np.log1p(len(data)), np.log1p(len(lines)), float(sizes.mean()), len(counts) / n, max(counts.values()) / n, 1 - len(set(lines)) / len(lines),
        float((sizes > 12).mean()), float((sizes <= 3).mean()), sum(1 for w in counts if w[:1].isupper()) / len(counts), 0.0,
    ]


def describe(text: bytes | None) -> bytes:
    """What is stored of a text: its statistics (4 bytes each), and square roots of the shares of kinds and pairs (1 byte each)."""
    data = text or b""
    kind = _KIND[np.frombuffer(data, np.uint8)]
    shares = np.zeros(KINDS + PAIRS)
    if len(kind):
        shares[:KINDS] = np.bincount(kind, minlength=KINDS) / len(kind)
        shares[KINDS:] = np.bincount(_BUCKET[kind[:-1] * KINDS + kind[1:]], minlength=PAIRS) / len(kind)
    return np.array(statistics(data), np.float32).tobytes() + np.round(np.sqrt(shares) * 255).astype(np.uint8).tobytes()


def numbers(described: list[bytes]) -> np.ndarray:
    """Descriptions as a matrix of RAW columns."""
    whole = np.frombuffer(b"".join(described), np.uint8).reshape(len(described), -1)
    head = 4 * len(NAMES)
    return np.hstack([np.ascontiguousarray(whole[:, :head]).view(np.float32).astype(np.float64), whole[:, head:] / 255.0])


@dataclass(frozen=True)
class Quality:
    """Standardised numbers, the squares of the statistics, and a linear score of them."""

    mean: np.ndarray
    scale: np.ndarray
    linear: Linear
    prior: float = 0.5

    def features(self, described: list[bytes]) -> np.ndarray:
        z = np.clip((numbers(described) - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z[:, : len(NAMES)] ** 2 / 6])

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        return self.linear.score(self.features([describe(t) for t in texts])) if texts else np.empty(0)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [describe(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "x"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of rows, and sum and sum of squares of each column, of a partition."""
    n, total, squares = 0, np.zeros(RAW), np.zeros(RAW)
    for batch in batches:
        if batch.num_rows:
            x = numbers(batch.column(0).to_pylist())
            n, total, squares = n + len(x), total + x.sum(0), squares + (x * x).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(RAW, dtype=np.int32)), pa.array(np.full(RAW, n, np.int64)), pa.array(total), pa.array(squares)], ["at", "n", "s", "q"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", prior: float | None = None) -> Quality:
    """A classifier from docs (all taken as unlabelled) and labels, of which only the ones are used as examples.

    The caller keeps held-out rows out of both tables. Labels that repeat for an id count as their maximum; null labels,
    labels without a document, and null ids (which match none) are ignored. prior is the share of good texts where it
    is known; else it is estimated. Without any labels the score is one half for every text. Other columns, whatever
    their names, are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    good = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")).where("label = 1").select("id", F.lit(True).alias("positive"))
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(_describe, f"id {id_type}, x binary")
    rows = materialise(rows.join(good, "id", "left").select("id", "x", F.coalesce("positive", F.lit(False)).alias("positive")))
    sums = rows.select("x").mapInArrow(_sums, "at int, n bigint, s double, q double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    mean, scale = np.zeros(RAW), np.ones(RAW)
    for r in sums:
        if r["n"]:
            mean[r["at"]] = r["s"] / r["n"]
            scale[r["at"]] = max(np.sqrt(max(0.0, r["q"] / r["n"] - mean[r["at"]] ** 2)), 1e-3)
    shape = Quality(mean, scale, Linear(np.zeros(WIDTH), 0.0))

    def features(x: pd.Series) -> np.ndarray:
        return shape.features(x.tolist()) if len(x) else np.empty((0, WIDTH))

    options = {"shard": SHARD, "decay": DECAY, "steps": STEPS}
    prior = estimate_prior(rows, features, WIDTH, **options) if prior is None else prior
    return Quality(mean, scale, fit_shards(rows, features, WIDTH, prior, **options), prior)


def quality_score(model: Quality, text: Column) -> Column:
    """The chance that a text is good (0 to 1); null and empty texts have a score too."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score([None if t is None else t.encode("utf-8", "surrogatepass") for t in texts]), dtype=float)

    return score(text.cast("string"))
