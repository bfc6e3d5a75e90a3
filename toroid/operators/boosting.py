"""Histogram gradient boosting of regression trees that grow leaf by leaf, over one binned table.

Features become bin numbers once. Each step of a tree is one pass: tasks place their rows in the tree as far as it is grown, and
send histograms (sum of gradients and count by node, feature and bin) that are added up by node. Only the smaller child
of a split is counted, the other one is its parent minus that. What reaches the driver depends on leaves, features and
bins, not on rows.

Best-first growth splits the leaf of largest gain until there are MOST leaves. The gain of a leaf does not depend on
the order of splits, so a pass counts the children of all leaves that could still have their turn (no more than leaves are
left to make), and a tree takes a pass for each level instead of one for each leaf.

Several models grow side by side, each on the rows of the other folds, with their scores in one table: k-fold
cross-validation takes the passes of its longest model. A model stops early when its error on a part of its rows, set
aside by hash, no longer falls.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toroid.config import SEED
from toroid.sources.shared import materialise

#: Bin numbers are bytes; the last one means that the value is missing.
BINS, MISSING = 255, 255
#: Leaves of a tree, rows of a leaf, and the share of a tree's step that is taken.
MOST, LEAST, RATE = 31, 20, 0.05
#: Rows above which a model sets VALIDATION of them aside, and rounds without gain (of over GAIN) after which it stops.
EARLY_ROWS, VALIDATION, PATIENCE, GAIN = 10_000, 0.1, 10, 1e-7
#: Rows that bin edges are taken from, about.
EDGE_ROWS = 200_000
#: Bytes of partial histograms that the driver adds up itself; above that, tasks add them first.
DIRECT = 64 << 20
#: Rows of a chunk, about: what a pass does once for a chunk must be little beside its rows.
CHUNK_ROWS = 1 << 16
#: Bytes of chunks that a task of a pass has at least, where there are so many.
TASK_BYTES = 2 << 20
#: Rounds between tables that cut the lineage.
CUT = 25
#: How chunks are written: row groups of a few chunks, which are what a task reads at once. Parquet would else look at sizes only every
#: hundred rows, and a hundred chunks are hundreds of megabytes.
CHUNK_FILES = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


@contextmanager
def chunk_by_chunk(spark: SparkSession):
    """Arrow batches of one row inside: a row is a chunk, and a batch of the usual 10,000 rows would be a task's whole part of the table."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS, rows: int = EDGE_ROWS) -> dict[str, list[float]]:
    """Upper ends of all but the last bin of each feature, rising, from all rows or a sample of about `rows` of them.

    A feature of `bins` values or fewer has a bin for each; others are cut at quantiles. Missing and infinite values are
    left out; a feature without any value has no edges. No target is looked at.
    """
    own = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    n = own.count()
    found = (own if n <= rows else own.sample(rows / n, seed=1)).toArrow()
    edges = {}
    for c in features:
        v = found.column(c).to_numpy().astype(float)
        v = v[np.isfinite(v)]
        known = np.unique(v)
        if len(known) <= bins:
            edges[c] = (known[:-1] + (known[1:] - known[:-1]) / 2).tolist()
        else:
            cuts = np.unique(np.quantile(v, np.arange(1, bins) / bins, method="midpoint"))
            edges[c] = cuts[cuts < known[-1]].tolist()
    return edges


def bin_numbers(values: np.ndarray, edges: list[float]) -> np.ndarray:
    """The number of edges below each value, as a byte; MISSING for NaN."""
    out = np.searchsorted(np.array(edges, float), values, "left").astype(np.uint8)
    out[np.isnan(values)] = MISSING
    return out


@dataclass
class Tree:
    """Nodes in the order they were made: rows with bin <= cut of the feature go left; feature -1 marks a leaf."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def reached(self, codes: np.ndarray, wanted: Iterable[int], rows: np.ndarray | None = None) -> list[np.ndarray]:
        """The rows (columns of codes, or those of them that are given) that come to each wanted node, in their order."""
        above = {child: node for node in range(len(self.feature)) if self.feature[node] >= 0 for child in (self.left[node], self.right[node])}
        goals = list(wanted)
        needed = set(goals)
        for node in goals:
            while node in above and above[node] not in needed:
                needed.add(node := above[node])
        found, todo = {}, [(0, np.arange(codes.shape[1]) if rows is None else rows)]
        while todo:
            node, own = todo.pop()
            found[node] = own
            children = [c for c in (self.left[node], self.right[node]) if c in needed] if self.feature[node] >= 0 else []
            if children:
                low = codes[self.feature[node]].take(own, mode="clip") <= self.cut[node]
                todo += [(c, own.compress(low if c == self.left[node] else ~low)) for c in children]  # a third of the time of own[low]
        return [found[node] for node in goals]

    def place(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row (column of codes) ends in."""
        leaves = [node for node, feature in enumerate(self.feature) if feature < 0]
        at = np.zeros(codes.shape[1], np.int64)
        for node, rows in zip(leaves, self.reached(codes, leaves)):
            at[rows] = node
        return at


def histograms(codes: np.ndarray, gradient: np.ndarray, parts: list[np.ndarray], weight: np.ndarray | None = None) -> np.ndarray:
    """(part, feature, bin, [gradient, count]) of lists of rows; a row counts weight times."""
    m, rows = len(parts), np.concatenate(parts)
    base = np.repeat(np.arange(m) * 256, [len(p) for p in parts])
    gradient, weight = gradient.take(rows), weight.take(rows) if weight is not None else None
    out = np.empty((m, len(codes), 256, 2))
    for f in range(len(codes)):
        key = base + codes[f].take(rows, mode="clip")
        out[:, f, :, 0] = np.bincount(key, gradient, m * 256).reshape(m, 256)
        out[:, f, :, 1] = np.bincount(key, weight, m * 256).reshape(m, 256)
    return out


def root_gradients(codes: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """histograms() of all rows as one part, with counts of zero."""
    out = np.zeros((1, len(codes), 256, 2))
    for f in range(len(codes)):
        out[0, f, :, 0] = np.bincount(codes[f], gradient, 256)
    return out


def best_split(hist: np.ndarray, least: int) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a node with histogram (feature, bin, [gradient, count]); None without gain.

    Of equal gains the first feature and the lowest bin win.
    """
    total, n = hist[0].sum(0)
    left, count = np.cumsum(hist[:, :MISSING, 0], 1), np.cumsum(hist[:, :MISSING, 1], 1)
    ok = (count >= least) & (n - count >= least)
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, left**2 / count + (total - left) ** 2 / (n - count) - total**2 / n, -np.inf)
    at = int(gain.argmax())
    best = float(gain.ravel()[at])
    return (best, *divmod(at, MISSING)) if best > 1e-12 * max(1.0, total**2 / n) else None


class Growth:
    """One tree while it grows: which nodes are to be counted next, and the tree once nothing is."""

    def __init__(self, depth: int, leaves: int, least: int):
        self.depth, self.leaves, self.least = depth, leaves, least
        self.tree, self.level = Tree([-1], [0], [-1], [-1], [0.0]), [0]
        self.sums: dict[int, tuple[float, float]] = {}
        self.hist: dict[int, np.ndarray] = {}
        self.split: dict[int, tuple[float, int, int] | None] = {}
        self.wanted: dict[int, tuple[int, int] | None] = {0: None}  # node to count: (sibling, parent)

    def _child(self, level: int, sums: tuple[float, float]) -> int:
        for name, v in (("feature", -1), ("cut", 0), ("left", -1), ("right", -1), ("value", 0.0)):
            getattr(self.tree, name).append(v)
        self.level.append(level)
        self.sums[len(self.level) - 1] = sums
        return len(self.level) - 1

    def _may_split(self, node: int) -> bool:
        return self.level[node] < self.depth and self.sums[node][1] >= 2 * self.least

    def _known(self, node: int, hist: np.ndarray) -> None:
        self.split[node] = best_split(hist, self.least) if self._may_split(node) else None
        if self.split[node]:
            self.hist[node] = hist

    def counted(self, found: dict[int, np.ndarray]) -> None:
        """Take the histograms of the wanted nodes; the siblings follow, and the next wanted nodes."""
        for node, pair in self.wanted.items():
            if pair is None:
                self.sums[node] = tuple(found[node][0].sum(0))
            self._known(node, found[node])
            if pair:
                sibling, parent = pair
                self._known(sibling, self.hist.pop(parent) - found[node])
        self.wanted = {}
        while blocked := self._blocked():
            for node in blocked:
                _, feature, cut = self.split[node]
                total, n = self.sums[node]
                own, count = self.hist[node][feature, : cut + 1].sum(0)
                a, b = self._child(self.level[node] + 1, (own, count)), self._child(self.level[node] + 1, (total - own, n - count))
                self.tree.feature[node], self.tree.cut[node], self.tree.left[node], self.tree.right[node] = feature, cut, a, b
                small, large = (a, b) if 2 * count <= n else (b, a)
                if self._may_split(large):
                    self.wanted[small] = (large, node)
                else:  # neither can be split: no need to count them
                    self.split[small] = self.split[large] = None
                    del self.hist[node]
            if self.wanted:
                return

    def _blocked(self) -> list[int]:
        """Leaves that may have their turn but have no children yet.

        Children that are not known could only push others back, so whatever best-first order splits in the end is among those
        that it splits when they are left out.
        """
        heap = [(-self.split[0][0], 0)] if self.split[0] else []
        blocked, made = [], 1
        while heap and made < self.leaves:
            _, node = heapq.heappop(heap)
            made += 1
            if self.tree.left[node] < 0:
                blocked.append(node)
                continue
            for child in (self.tree.left[node], self.tree.right[node]):
                if self.split.get(child):
                    heapq.heappush(heap, (-self.split[child][0], child))
        return blocked

    def finished(self, rate: float) -> Tree:
        """The tree of the leaves that best-first order makes, with their values."""
        out = Tree()
        heap = [(-self.split[0][0], 0)] if self.split[0] else []
        kept: set[int] = set()
        made = 1
        while heap and made < self.leaves:
            _, node = heapq.heappop(heap)
            kept.add(node)
            made += 1
            for child in (self.tree.left[node], self.tree.right[node]):
                if self.split[child]:
                    heapq.heappush(heap, (-self.split[child][0], child))
        todo, number = [0], {0: 0}
        while todo:
            node = todo.pop(0)
            total, n = self.sums[node]
            inner = node in kept
            for child in (self.tree.left[node], self.tree.right[node]) if inner else ():
                number[child] = len(number)
                todo.append(child)
            out.feature.append(self.tree.feature[node] if inner else -1)
            out.cut.append(self.tree.cut[node] if inner else 0)
            out.left.append(number[self.tree.left[node]] if inner else -1)
            out.right.append(number[self.tree.right[node]] if inner else -1)
            out.value.append(0.0 if inner else -rate * float(total / n))
        return out


def _filled(codes: np.ndarray, fill: list[int]) -> np.ndarray:
    """codes with missing values replaced by each feature's bin."""
    return np.where(codes == MISSING, np.array(fill, np.uint8)[:, None], codes) if codes.max(initial=0) == MISSING else codes


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same rows in tables of at least so many rows, but for the last one."""
    own: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            own.append(batch)
        if sum(b.num_rows for b in own) >= rows:
            yield pa.Table.from_batches(own)
            own = []
    if own:
        yield pa.Table.from_batches(own)


_CHUNK = "n int, codes binary, label binary, fold binary, aside binary, score binary"


def chunked(df: DataFrame, features: list[str], edges: dict[str, list[float]], label: str, fold: Column, validation: Column, scores: int) -> DataFrame:
    """Rows in chunks of arrays: (n, codes, label, fold, aside, score), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, CHUNK_ROWS):
            codes = np.stack([bin_numbers(batch.column(i).to_numpy().astype(float), edges[c]) for i, c in enumerate(features)])
            yield _chunk(codes, *(batch.column(len(features) + i).to_numpy() for i in range(3)), scores)

    rows = df.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double"), fold.cast("int"), validation.cast("boolean"))
    return materialise(rows.mapInArrow(run, _CHUNK), **CHUNK_FILES)


def _chunk(codes: np.ndarray, label: np.ndarray, fold: np.ndarray, aside: np.ndarray, scores: int) -> pa.RecordBatch:
    n = len(label)
    arrays = [codes, label.astype(float), fold.astype(np.int16), aside.astype(bool), np.zeros((scores, n))]
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], ["n", "codes", "label", "fold", "aside", "score"])


def coded(df: DataFrame, features: list[str], edges: dict[str, list[float]], label: str, validation: Column, key: str) -> DataFrame:
    """(key, codes, label, aside): a row of df in a byte for each feature, to be joined and shuffled before chunks are made of them."""
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            codes = np.stack([bin_numbers(batch.column(i).to_numpy(zero_copy_only=False).astype(float), edges[c]) for i, c in enumerate(features)], 1)
            ends = np.arange(0, (n + 1) * width, width, dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.RecordBatch.from_arrays([batch.column(width), packed, batch.column(width + 1), batch.column(width + 2)], ["key", "codes", "label", "aside"])

    rows = df.select(*[F.col(c).cast("double") for c in features], F.col(key).cast("long").alias("key"), F.col(label).cast("double").alias("label"), validation.cast("boolean").alias("aside"))
    return rows.mapInArrow(run, "key long, codes binary, label double, aside boolean")


def chunked_codes(df: DataFrame, features: int) -> DataFrame:
    """chunked() of rows that are coded() already, with fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, CHUNK_ROWS):
            held = batch.column(0).combine_chunks()
            held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
            first = np.frombuffer(held.buffers()[1], np.int32)[held.offset]
            codes = np.frombuffer(held.buffers()[2], np.uint8)[first : first + len(held) * features].reshape(-1, features)
            yield _chunk(np.ascontiguousarray(codes.T), *(batch.column(i).to_numpy() for i in (1, 2, 3)), 0)

    rows = df.select("codes", "label", F.coalesce(F.col("fold"), F.lit(-1)).cast("int"), "aside")
    return materialise(rows.mapInArrow(run, _CHUNK), **CHUNK_FILES)


def spread(chunks: DataFrame, width: int) -> DataFrame:
    """chunks in fewer tasks where they are small: passes over little data are mostly the start of tasks. width: bytes of a row."""
    size = (chunks.agg(F.sum("n")).first()[0] or 0) * width
    return chunks.coalesce(max(1, size // TASK_BYTES))


@dataclass
class Chunk:
    """The arrays of one row of chunked()."""

    codes: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    aside: np.ndarray
    score: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, features: int) -> Iterator[Chunk]:
        """Views of the batch, not copies."""
        for i, n in enumerate(batch.column(0).to_pylist()):
            codes, label, fold, aside, score = (np.frombuffer(batch.column(c)[i].as_buffer() or b"", kind) for c, kind in enumerate((np.uint8, float, np.int16, bool, float), 1))
            yield Chunk(codes.reshape(features, n), label, fold, aside, score.reshape(-1, n))


def different(chunks: DataFrame, features: int, edges: list[list[float]], fills: list[list[int]]) -> list[int]:
    """The features left when of those with the same bin number in every row, and the same fills, only the first stays.

    Of equal gains the first feature wins, so no tree would use the others.
    """
    likely = [(i, j) for j in range(features) for i in range(j) if len(edges[i]) == len(edges[j]) and all(f[i] == f[j] for f in fills)]
    if not likely:
        return list(range(features))

    def part(chunk: Chunk) -> dict[int, np.ndarray]:
        return {0: np.array([float(not np.array_equal(chunk.codes[i], chunk.codes[j])) for i, j in likely])}

    unlike = _added(chunks, part, features, 1, 0).get(0, np.ones(len(likely)))
    return [f for f in range(features) if f not in {j for (_, j), n in zip(likely, unlike) if not n}]


def narrowed(chunks: DataFrame, features: int, keep: list[int]) -> DataFrame:
    """chunks with the codes of some features only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.frombuffer(c, np.uint8).reshape(features, -1)[keep].tobytes() for c in batch.column(1).to_pylist()]
            yield batch.set_column(1, "codes", pa.array(codes, pa.binary()))

    return chunks.mapInArrow(run, chunks.schema) if len(keep) < features else chunks


@dataclass(frozen=True)
class View:
    """What a model sees of the rows: not those of `fold` (None: all), and none set aside if it may stop early."""

    fold: int | None
    fill: list[int]
    early: bool

    def rows(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Which rows of a chunk the model learns from, and which it validates on."""
        own = chunk.fold != self.fold if self.fold is not None else np.ones(len(chunk.label), bool)
        return (own & ~chunk.aside, own & chunk.aside) if self.early else (own, own & False)


@dataclass
class Model:
    """One of the models that grow side by side."""

    view: View
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    #: Rows by feature and bin, which are the same for every tree's root.
    counts: np.ndarray | None = None

    @property
    def over(self) -> bool:
        recent = self.losses[-PATIENCE:]
        return self.view.early and len(self.losses) > PATIENCE and not any(v < self.losses[-PATIENCE - 1] - GAIN for v in recent)


def _added(chunks: DataFrame, part: Callable[[Chunk], dict[int, np.ndarray]], features: int, parts: int, size: int) -> dict[int, np.ndarray]:
    """Arrays by number, added over all chunks in the order of tasks. size: bytes that a task sends, about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk in Chunk.of(batch, features):
                for k, v in part(chunk).items():
                    if k in total:
                        total[k] += v
                    else:
                        total[k] = v
        yield _packed(TaskContext.get().partitionId(), total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["slot"], r["task"], r["total"]) for batch in batches for r in batch.to_pylist())
        total: dict[int, np.ndarray] = {}
        for slot, _, data in rows:
            own = np.frombuffer(data)
            total[slot] = total[slot] + own if slot in total else own
        yield _packed(0, total)

    schema = "slot int, task int, total binary"
    partial = chunks.mapInArrow(run, schema)
    if parts * size > DIRECT:
        partial = partial.repartition("slot").mapInArrow(add, schema)
    out: dict[int, np.ndarray] = {}
    for slot, _, data in sorted((r["slot"], r["task"], bytes(r["total"])) for r in partial.collect()):
        own = np.frombuffer(data)
        out[slot] = out[slot] + own if slot in out else own
    return out


def _packed(task: int, total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([task] * len(total), pa.int32()), pa.array([np.ascontiguousarray(v, float).tobytes() for v in total.values()], pa.binary())], ["slot", "task", "total"],
    )


def _histograms(chunks: DataFrame, models: list[Model], growing: dict[int, Growth], features: int, parts: int, loss: bool) -> tuple[dict[int, dict[int, np.ndarray]], dict[int, tuple[float, float]]]:
    """Histograms of the wanted nodes of each growing tree, and (squared error, rows) of the rows set aside if asked for."""
    trees = {k: g.tree for k, g in growing.items()}
    slots = {k: {node: i for i, node in enumerate(g.wanted)} for k, g in growing.items()}
    views, width = {k: models[k].view for k in growing}, max(len(s) for s in slots.values())
    known = {k for k, own in slots.items() if 0 in own and models[k].counts is not None}

    def part(chunk: Chunk) -> dict[int, np.ndarray]:
        out = {}
        for k, view in views.items():
            own, held = view.rows(chunk)
            if loss and view.early:
                error = (chunk.score[k] - chunk.label)[held]
                out[-1 - k] = np.array([error @ error, len(error)])
            codes, gradient = _filled(chunk.codes, view.fill), chunk.score[k] - chunk.label
            if k in known:
                hist = root_gradients(codes, gradient if own.all() else np.where(own, gradient, 0.0))
            else:
                hist = histograms(codes, gradient, trees[k].reached(codes, slots[k], None if own.all() else np.flatnonzero(own)))
            for i in range(len(hist)):
                out[k * width + i] = hist[i].ravel()
        return out

    nodes = sum(map(len, slots.values()))
    found = _added(chunks, part, features, parts, nodes * features * 256 * 16)
    shape = (features, 256, 2)
    hists = {k: {node: found[k * width + i].reshape(shape) if k * width + i in found else np.zeros(shape) for node, i in own.items()} for k, own in slots.items()}
    for k in hists:
        if k in known:
            hists[k][0] = np.stack([hists[k][0][..., 0], models[k].counts], -1)
        elif 0 in hists[k]:
            models[k].counts = hists[k][0][..., 1].copy()
    return hists, {k: tuple(found.get(-1 - k, (0.0, 0.0))) for k in growing}


def _updated(chunks: DataFrame, models: list[Model], new: dict[int, Tree], features: int) -> DataFrame:
    """chunks with the new trees' values added to the scores of their models."""
    fills, count = {k: models[k].view.fill for k in new}, len(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for chunk in Chunk.of(batch, features):
                score = chunk.score.copy() if len(chunk.score) else np.zeros((count, len(chunk.label)))
                for k, tree in new.items():
                    score[k] += np.array(tree.value)[tree.place(_filled(chunk.codes, fills[k]))]
                scores.append(score.tobytes())
            yield batch.set_column(5, "score", pa.array(scores, pa.binary()))

    return chunks.mapInArrow(run, _CHUNK)


@dataclass
class Passes:
    """How many passes over the chunks a fit took, and how many rounds its models grew."""

    histograms: int = 0
    rounds: list[int] = field(default_factory=list)
    found: list[tuple] | None = None


def boost(chunks: DataFrame, models: list[Model], features: int, rounds: int, depth: int, leaves: int = MOST, least: int = LEAST, rate: float = RATE, then: Callable[[DataFrame], list[tuple]] | None = None) -> Passes:
    """Grow all models, in place. chunks: as chunked() gives them; scores start anew.

    then: gets held_out() by the whole models, while chunks are held; its result becomes the passes' `found`.
    """
    with chunk_by_chunk(chunks.sparkSession):
        return _boost(chunks, models, features, rounds, depth, leaves, least, rate, then)


def _boost(chunks: DataFrame, models: list[Model], features: int, rounds: int, depth: int, leaves: int, least: int, rate: float, then: Callable[[DataFrame], list[tuple]] | None) -> Passes:
    passes = Passes()
    parts = chunks.rdd.getNumPartitions()

    views = [m.view for m in models]

    def sums(chunk: Chunk) -> dict[int, np.ndarray]:
        return {k: np.array([(y := chunk.label[view.rows(chunk)[0]]).sum(), len(y)]) for k, view in enumerate(views)}

    for k, (total, n) in _added(chunks, sums, features, parts, 16).items():
        models[k].start = float(total / n) if n else 0.0
    root = {k: Tree([-1], [0], [-1], [-1], [m.start]) for k, m in enumerate(models)}
    held = _updated(chunks, models, root, features).persist()
    old, new = None, {}
    try:
        for turn in range(rounds):
            growing = {k: Growth(depth, leaves, least) for k, m in enumerate(models) if not m.over}
            first = True
            while now := {k: g for k, g in growing.items() if g.wanted}:
                found, losses = _histograms(held, models, now, features, parts, first)
                passes.histograms += 1
                if first:
                    if old is not None:
                        old.unpersist()
                        old = None
                    for k, (error, n) in losses.items():
                        models[k].losses.append(error / n if n else 0.0)
                    growing = {k: g for k, g in growing.items() if not models[k].over}
                first = False
                for k, g in growing.items():
                    if g.wanted:
                        g.counted(found[k])
            new = {k: g.finished(rate) for k, g in growing.items() if g.split[0]}
            if not new:
                break
            for k, tree in new.items():
                models[k].trees.append(tree)
            if turn + 1 < rounds:
                old, held = held, _updated(held, models, new, features)
                held = materialise(held, **CHUNK_FILES).persist() if (turn + 1) % CUT == 0 else held.persist()
                new = {}
        if then is not None:
            passes.found = then(held_out(_updated(held, models, new, features) if new else held, features, [v.fold for v in views]))
    finally:
        for df in (old, held):
            if df is not None:
                df.unpersist()
    passes.rounds = [len(m.trees) for m in models]
    return passes


class BoostedTrees(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the prediction of boosted trees to a table; its parameter `document` is the whole model, as JSON."""

    document = Param(Params._dummy(), "document", "features, edges, fills, start and trees", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, document: str = "{}", outputCol: str = "prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def of(model: Model, features: list[str], edges: dict[str, list[float]], output: str, importances: dict[str, float] | None = None) -> BoostedTrees:
        trees = [[t.feature, t.cut, t.left, t.right, t.value] for t in model.trees]
        return BoostedTrees(document=json.dumps({"features": features, "edges": [edges[c] for c in features], "fill": model.view.fill, "start": model.start, "trees": trees, "importances": importances or {}}), outputCol=output)

    @property
    def trees(self) -> list[Tree]:
        return [Tree(*t) for t in json.loads(self.getOrDefault(self.document))["trees"]]

    @property
    def importances(self) -> dict[str, float]:
        """By feature; empty where the fit did not find any."""
        return json.loads(self.getOrDefault(self.document)).get("importances", {})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text = self.getOrDefault(self.document)
        features = json.loads(text)["features"]

        @F.pandas_udf("double")
        def predicted(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            own = json.loads(text)
            trees = [Tree(*t) for t in own["trees"]]
            values = [np.array(t.value) for t in trees]
            for columns in parts:
                columns = columns if isinstance(columns, tuple) else (columns,)  # one feature comes by itself
                codes = _filled(np.stack([bin_numbers(c.to_numpy(float), e) for c, e in zip(columns, own["edges"])]), own["fill"])
                yield pd.Series(sum((v[t.place(codes)] for t, v in zip(trees, values)), np.full(codes.shape[1], own["start"])))

        return dataset.withColumn(self.getOutputCol(), predicted(*[F.col(c).cast("double") for c in features]))


def fit_models(
    df: DataFrame, features: list[str], label: str, fills: dict[int | None, dict[str, float]], rows: dict[int | None, int], *, rounds: int, depth: int, bins: int = BINS, leaves: int = MOST, least: int = LEAST,
    rate: float = RATE, early_rows: int = EARLY_ROWS, edges: dict[str, list[float]] | None = None, output: str = "prediction", then: Callable[[DataFrame], list[tuple]] | None = None,
) -> tuple[dict[int | None, BoostedTrees], Passes]:
    """A model for each key of fills: the fold whose rows it does not see (df has fold then), or None for all rows.

    fills: what replaces missing values, by feature; rows: how many rows each model learns from (above early_rows it
    sets VALIDATION of them aside and stops early). A feature that any model has no fill for is left out. All models share one binned
    table and their passes. Rows set aside are chosen by a hash of features and label, so no partitioning changes them.
    """
    used = [c for c in features if all(c in f and f[c] is not None for f in fills.values())]
    if not used:
        raise ValueError("every feature is missing in all rows")
    edges = edges or bin_edges(df, used, min(bins, BINS))
    aside = set_aside(used, label)
    chunks = chunked(df, used, edges, label, F.coalesce(F.col("fold"), F.lit(-1)) if "fold" in df.columns else F.lit(-1), aside, 0)
    codes = {k: [int(bin_numbers(np.array([float(v[c])]), edges[c])[0]) for c in used] for k, v in fills.items()}
    return grow_models(Binned(chunks, used, edges, codes, rows).narrowed(), rounds=rounds, depth=depth, leaves=leaves, least=least, rate=rate, early_rows=early_rows, output=output, then=then)


@dataclass
class Binned:
    """A table in chunks, written once for all models that learn from it. fills and rows: by model, see fit_models; fills as bin numbers."""

    chunks: DataFrame
    features: list[str]
    edges: dict[str, list[float]]
    fills: dict[int | None, list[int]]
    rows: dict[int | None, int]

    def narrowed(self) -> Binned:
        """Without the features that repeat others."""
        with chunk_by_chunk(self.chunks.sparkSession):
            keep = different(self.chunks, len(self.features), [self.edges[c] for c in self.features], list(self.fills.values()))
        return Binned(narrowed(self.chunks, len(self.features), keep), [self.features[i] for i in keep], self.edges, {k: [v[i] for i in keep] for k, v in self.fills.items()}, self.rows)

    def labels(self, name: str) -> DataFrame:
        """The label of each row, in one column."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for y in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(y))], [name])

        return self.chunks.select("label").mapInArrow(run, f"`{name}` double")


def set_aside(features: list[str], label: str) -> Column:
    """Which rows a model validates on; by a hash of features and label, so that no partitioning changes them."""
    return F.pmod(F.xxhash64(F.lit(SEED), *[F.col(c) for c in [*features, label]]), F.lit(1000)) < int(1000 * VALIDATION)


def with_middles(chunks: DataFrame, features: list[str], edges: dict[str, list[float]], keys: list[int | None], exact: Callable[[list[str]], dict[int | None, dict[str, float]]]) -> Binned:
    """chunks with the bins of the features' medians, for each model over the rows that it sees, from one count of the bins.

    A median lies in the bin that its rank falls into. Where the two middle values are in different bins, the features concerned are asked of
    `exact`, by name. A feature that is missing in all rows of a model is left out.
    """
    def part(chunk: Chunk) -> dict[int, np.ndarray]:
        out = {}
        for k in np.unique(chunk.fold):
            own = chunk.fold == k
            out[int(k) + 1] = np.concatenate([np.bincount(c if own.all() else c[own], minlength=256) for c in chunk.codes]).astype(float)
        return out

    with chunk_by_chunk(chunks.sparkSession):
        parts = chunks.rdd.getNumPartitions()
        counted = {k - 1: v.reshape(len(features), 256) for k, v in _added(chunks, part, len(features), parts, 16 * 256 * len(features)).items()}
    fills, rows, open_ = {}, {}, set()
    for k in keys:
        seen = sum((v for f, v in counted.items() if k is None or f != k), np.zeros((len(features), 256)))
        rows[k], fills[k] = int(seen[0].sum()), [-1] * len(features)
        for i in range(len(features)):
            upto = np.cumsum(seen[i, :MISSING])
            n = int(upto[-1])
            if n:
                low, high = (int(np.searchsorted(upto, r, "right")) for r in ((n - 1) // 2, n // 2))
                fills[k][i] = low
                if low != high:
                    open_.add(i)
    if open_:
        found = exact([features[i] for i in sorted(open_)])
        for k in keys:
            for i in open_:
                if fills[k][i] >= 0:
                    fills[k][i] = int(bin_numbers(np.array([float(found[k][features[i]])]), edges[features[i]])[0])
    keep = [i for i in range(len(features)) if all(fills[k][i] >= 0 for k in keys)]
    if not keep:
        raise ValueError("every feature is missing in all rows")
    return Binned(narrowed(chunks, len(features), keep), [features[i] for i in keep], edges, {k: [v[i] for i in keep] for k, v in fills.items()}, rows).narrowed()


def grow_models(
    table: Binned, *, rounds: int, depth: int, leaves: int = MOST, least: int = LEAST, rate: float = RATE, early_rows: int = EARLY_ROWS, output: str = "prediction", then: Callable[[DataFrame], list[tuple]] | None = None,
) -> tuple[dict[int | None, BoostedTrees], Passes]:
    """fit_models() over a table that is binned already."""
    models = [Model(View(k, fill, table.rows[k] > early_rows)) for k, fill in table.fills.items()]
    chunks = spread(table.chunks, len(table.features) + 11 + 8 * len(models))
    passes = boost(chunks, models, len(table.features), rounds, depth, leaves, least, rate, then)
    return {m.view.fold: BoostedTrees.of(m, table.features, table.edges, output) for m in models}, passes


def held_out(chunks: DataFrame, features: int, keys: list[int | None]) -> DataFrame:
    """(fold, label, score) of the rows that a fold's model did not see, from chunks with the scores of all models, in the order of keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in Chunk.of(batch, features):
                for i, k in enumerate(keys):
                    own = chunk.fold == k
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(own.sum(), k, np.int32)), pa.array(chunk.label[own]), pa.array(chunk.score[i][own])], ["fold", "label", "score"])

    return chunks.mapInArrow(run, "fold int, label double, score double")
