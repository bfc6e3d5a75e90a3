"""Language identification: scripts narrow the candidates, Viterbi over per-word scores labels spans.

A word is a run of letters. Its score in a language is the sum of log probabilities of its letter triples, its edges
counting as letters; triples are hashed into BUCKETS counters for each language, counted over all training texts. A
language is a candidate for a word only if it was seen to use the word's script. Over the words of a text, the best
sequence of languages is found where each switch costs PENALTY; its runs are the spans.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of a language. The model is languages * BUCKETS numbers, whatever the number of texts.
BUCKETS = 1 << 15
#: Cost of a switch of language, in natural logarithms.
PENALTY = 24.0
#: Share of a language's letters that a script needs, for the language to be a candidate in it.
SCRIPT_SHARE = 0.02
#: Letters times languages that are scored at once.
CELLS = 4_000_000
UNKNOWN = "und"

#: Code point ranges of scripts; letters elsewhere are of one script of their own.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)], "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)], "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)], "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
N_SCRIPTS = len(SCRIPTS) + 2  # no letter, the named ones, others
_TABLE: np.ndarray | None = None


def _scripts(codes: np.ndarray) -> np.ndarray:
    """Script number of each code point; 0 where it is no letter."""
    global _TABLE
    if _TABLE is None:
        table = np.array([N_SCRIPTS - 1 if unicodedata.category(chr(c))[0] == "L" else 0 for c in range(1 << 18)], np.uint8)
        for number, ranges in enumerate(SCRIPTS.values(), 1):
            for lo, hi in ranges:
                table[lo : hi + 1][table[lo : hi + 1] > 0] = number
        _TABLE = table
    return _TABLE[np.minimum(codes, len(_TABLE) - 1)]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all letters of the texts joined by line feeds: position, bucket of the triple, script; and where each text starts."""
    low = [t if len(u := t.lower()) != len(t) else u for t in texts]  # the same length, so that spans fit
    codes = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    script = _scripts(codes)
    at = np.flatnonzero(script)
    kept = np.where(script > 0, codes, 0).astype(np.uint64)
    mixed = kept[at - 1] * np.uint64(0x9E3779B97F4A7C15) + kept[at] * np.uint64(0xC2B2AE3D27D4EB4F) + kept[at + 1] * np.uint64(0x165667B19E3779F9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    starts = np.cumsum([1, *(len(t) + 1 for t in low)])
    return at, (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), script[at], starts


def _pieces(texts: list[str | None], most: int) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most or i == len(texts) - 1:
            yield first, [x or "" for x in texts[first : i + 1]]
            first, size = i + 1, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) over a partition; scripts are buckets from BUCKETS on."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).to_pylist()
        for lang in set(langs.tolist()):
            counts = held.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
            for _, part in _pieces([texts[i] for i in np.flatnonzero(langs == lang)], CELLS):
                _, bucket, script, _ = letters(part)
                counts[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                counts[BUCKETS:] += np.bincount(script, minlength=N_SCRIPTS)
    for lang, counts in held.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some])], ["lang", "bucket", "n"])


class LanguageModel:
    """log probabilities of buckets by language, and which languages use which script."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        triples, scripts = counts[:, :BUCKETS].astype(float), counts[:, BUCKETS:].astype(float)
        total = triples.sum(1, keepdims=True)
        self.log = np.ascontiguousarray(np.log((triples + 0.5) / (total + 0.5 * BUCKETS)).T.astype(np.float32))
        self.uses = (scripts >= SCRIPT_SHARE * scripts.sum(1, keepdims=True)) & (scripts > 0)
        self.uses[:, ~self.uses.any(0)] = True  # a script that no language uses rules none out

    def best_path(self, scores: np.ndarray) -> np.ndarray:
        """The language of each word (rows of scores) on the best path."""
        n, total = len(scores), scores.sum(0)
        main = int(total.argmax())
        gains = np.cumsum(scores - scores[:, main : main + 1], axis=0)
        lows = np.minimum(np.minimum.accumulate(gains, axis=0), 0)
        # If no stretch gains over half a switch in any language, every path with switches loses: with m stretches outside
        # the main language it has m switches at least, or m - 1 if it never visits it (and then m > 1, or it gains nothing).
        if n == 1 or (gains - np.vstack([np.zeros((1, gains.shape[1])), lows[:-1]])).max() <= PENALTY / 2:
            return np.full(n, main)
        came = np.empty(scores.shape, np.int32)
        value, stay = scores[0].astype(float), np.arange(scores.shape[1])
        for t in range(1, n):
            top = int(value.argmax())
            switch = value[top] - PENALTY
            came[t] = np.where(value >= switch, stay, top)
            value = np.maximum(value, switch) + scores[t]
        path = np.empty(n, np.int64)
        path[-1] = int(value.argmax())
        for t in range(n - 1, 0, -1):
            path[t - 1] = came[t, path[t]]
        return path

    def label(self, texts: list[str]) -> Iterator[tuple[str, float, list[tuple[str, int, int]]]]:
        """(language, score, spans) of each text; a span is (language, first character, character after the last)."""
        at, bucket, script, starts = letters(texts)
        word = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        if len(word):
            scores = np.add.reduceat(self.log[bucket], word, axis=0)
            scores = np.where(self.uses.T[script[word]], scores, np.float32(-1e6))
            sizes = np.diff(np.r_[word, len(at)])
        limits = np.searchsorted(at[word], starts)
        for i in range(len(texts)):
            a, b = limits[i], limits[i + 1]
            if a == b or not self.langs:
                yield UNKNOWN, 0.0, []
                continue
            own = scores[a:b]
            path = self.best_path(own)
            shares = np.bincount(path, sizes[a:b], len(self.langs)) / sizes[a:b].sum()
            best = int(shares.argmax())
            total = own.sum(0, dtype=float)
            certain = 1 / np.exp(np.minimum(total - total[best], 700)).sum()
            cuts = np.r_[0, np.flatnonzero(np.diff(path)) + 1, b - a]
            spans = [(self.langs[path[x]], int(at[word[a + x]] - starts[i]), int(at[word[a + y - 1]] + sizes[a + y - 1] - starts[i])) for x, y in zip(cuts[:-1], cuts[1:])]
            yield self.langs[best], float(shares[best] * (certain if shares[best] > 0.99 else 1.0)), spans


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """A model of all rows whose lang is not null. What reaches the driver is languages * BUCKETS sums."""
    counted = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(_count, "lang string, bucket int, n bigint")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS + N_SCRIPTS), np.int64)
    if langs:
        row = np.searchsorted(np.array(langs, object), np.array(sums.column("lang").to_pylist(), object))
        counts[row, sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return LanguageModel(langs, counts)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] = ()) -> DataFrame:
    """id, lang_pred, score and spans (lang, start, end in characters) for each row, and the columns of keep.

    lang_pred has most letters on the text's path; it is `und` with score 0 and no spans where the text is null or has
    no letter. score is that share of letters, times the chance of the language given the words where it has them all.
    A text is labelled whole, however long. Rows that repeat are labelled each; an empty table gives an empty result.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias(id_col), *keep)
    kept = rows.drop("_text").schema
    names = [*kept.names, "lang_pred", "score", "spans"]
    held = docs.sparkSession.sparkContext.broadcast(model)
    most = max(50_000, CELLS // max(1, len(model.langs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for first, texts in _pieces(batch.column(0).to_pylist(), most):
                found = list(held.value.label(texts))
                own = [batch.column(i).slice(first, len(texts)) for i in range(1, batch.num_columns)]
                spans = pa.array([[{"lang": x, "start": a, "end": b} for x, a, b in f[2]] for f in found], span)
                yield pa.RecordBatch.from_arrays([*own, pa.array([f[0] for f in found]), pa.array([f[1] for f in found]), spans], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>")
