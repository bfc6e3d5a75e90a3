"""A random forest of regression trees over the binned chunks that boosting uses.

Every tree sees each row as often as a Poisson draw says. Draws come from a hash of the row and the tree, so no partitioning changes
them; rows that are equal in all features and target share theirs. All trees of a group grow side by side: a pass counts the smaller
children of the nodes split last, of all of them, and a group takes a pass for each level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toroid.config import SEED
from toroid.operators import boosting as B
from toroid.sources.shared import materialise

#: Rows of a leaf, and bytes of histograms that a group's deepest level may take in a task and in the driver.
LEAST, GROUP_BYTES = 2, 64 << 20
#: P(draw <= 0), P(draw <= 1), ... of the Poisson law with mean 1.
_LAW = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
_DRAWS = np.searchsorted(_LAW, np.arange(1 << 16) / (1 << 16), "right").astype(np.uint8)


def draws(row: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree sees each row, from the rows' 64-bit hashes (steps of splitmix64; 16 bits make a draw)."""
    with np.errstate(over="ignore"):
        z = row + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _DRAWS[z >> np.uint64(48)]


def hashed(chunks: DataFrame, features: int) -> DataFrame:
    """chunks with the rows' hashes where boosting keeps scores; they follow from bin numbers and target."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for chunk in B.Chunk.of(batch, features):
                h = np.frombuffer(chunk.label.tobytes(), np.uint64) + np.uint64(SEED)
                with np.errstate(over="ignore"):
                    for code in chunk.codes:
                        h = ((h ^ (h >> np.uint64(29))) + code) * np.uint64(0xBF58476D1CE4E5B9)
                found.append((h ^ (h >> np.uint64(32))).tobytes())
            yield batch.set_column(5, "score", pa.array(found, pa.binary()))

    return chunks.mapInArrow(run, chunks.schema)


def _grown(chunks: DataFrame, features: int, numbers: list[int], depth: int, fill: list[int], parts: int) -> list[B.Growth]:
    """The trees of these numbers, grown side by side."""
    growing = {k: B.Growth(depth, 1 << depth, LEAST) for k in numbers}
    while now := {k: g for k, g in growing.items() if g.wanted}:
        trees, wanted = {k: g.tree for k, g in now.items()}, {k: list(g.wanted) for k, g in now.items()}
        width = max(map(len, wanted.values()))

        def part(chunk: B.Chunk) -> dict[int, np.ndarray]:
            out, codes, row = {}, B._filled(chunk.codes, fill), chunk.score[0].view(np.uint64)
            for k, nodes in wanted.items():
                weight = draws(row, k).astype(float)
                hist = B.histograms(codes, -chunk.label * weight, trees[k].reached(codes, nodes, np.flatnonzero(weight)), weight)
                out |= {k * width + i: hist[i].ravel() for i in range(len(nodes))}
            return out

        found, shape = B._added(chunks, part, features, parts, sum(map(len, wanted.values())) * features * 256 * 16), (features, 256, 2)
        for k, g in now.items():
            g.counted({node: found[k * width + i].reshape(shape) if k * width + i in found else np.zeros(shape) for i, node in enumerate(wanted[k])})
    return list(growing.values())


def fit_forest(df: DataFrame, features: list[str], label: str, fills: dict[str, float], *, trees: int, depth: int, bins: int = B.BINS, output: str = "prediction") -> B.BoostedTrees:
    """The mean of `trees` trees, all features tried at every split. fills: what replaces missing values; a feature without one is left out.

    The model's importances are the gains of each feature's splits as shares of the tree's gain, averaged over trees.
    """
    used = [c for c in features if fills.get(c) is not None]
    if not used:
        raise ValueError("every feature is missing in all rows")
    edges = B.bin_edges(df, used, min(bins, B.BINS))
    fill = [int(B.bin_numbers(np.array([float(fills[c])]), edges[c])[0]) for c in used]
    chunks = B.chunked(df, used, edges, label, F.lit(-1), F.lit(False), 0)
    return grow_forest(B.Binned(chunks, used, edges, {None: fill}, {}).narrowed(), trees=trees, depth=depth, output=output)


def grow_forest(table: B.Binned, *, trees: int, depth: int, output: str = "prediction") -> B.BoostedTrees:
    """fit_forest() over a table that is binned already."""
    with B.chunk_by_chunk(table.chunks.sparkSession):
        return _forest(table, trees, depth, output)


def _forest(table: B.Binned, trees: int, depth: int, output: str) -> B.BoostedTrees:
    used, fill, edges = table.features, table.fills[None], table.edges
    held = B.spread(materialise(hashed(table.chunks, len(used)), **B.CHUNK_FILES), len(used) + 19).persist()
    group = max(1, GROUP_BYTES // (len(used) * 256 * 16 << max(0, depth - 2)))
    try:
        parts = held.rdd.getNumPartitions()
        grown = [g for first in range(0, trees, group) for g in _grown(held, len(used), list(range(first, min(trees, first + group))), depth, fill, parts)]
    finally:
        held.unpersist()
    gains = np.zeros(len(used))
    for g in grown:
        own = np.zeros(len(used))
        for split in filter(None, g.split.values()):
            own[split[1]] += split[0]
        gains += own / own.sum() if own.any() else own
    found = [g.finished(1.0) for g in grown]
    for tree in found:
        tree.value = [v / len(found) for v in tree.value]
    model = B.Model(B.View(None, fill, False), 0.0, found)
    shares = dict(zip(used, (gains / gains.sum() if gains.any() else gains).tolist()))
    return B.BoostedTrees.of(model, used, edges, output, shares)
