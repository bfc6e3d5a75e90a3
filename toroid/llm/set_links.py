"""Exact similarity links between sets that a candidate search has brought together.

Candidate edges are compared by whole sets. Where the candidates of a cluster are then still in several components, all
of its sets outside the largest one are compared with all of the cluster, in cells of bounded size; a cell
gives a spanning forest of the links that it finds. So candidates need only connect what belongs together, not be all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toroid.llm.common import broadcast_few, join_on_hot_key, materialise
from toroid.llm.components import components

#: Sets of a block, on average; a cell compares two blocks.
BLOCK = 256
#: Edges of one node that a task joins with its set.
DEGREE = 2048


def similar(both: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray, percent: int) -> bool | np.ndarray:
    """Whether sets of a and b elements that share `both` have a Jaccard similarity of percent / 100 or more, in whole numbers."""
    return 100 * both >= percent * (a + b - both)


def _compared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.array(a.values), np.array(b.values)
                good.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def with_sets(edges: DataFrame, sets: DataFrame, end: str, name: str) -> DataFrame:
    """edges with the set of their `end`; nodes of over DEGREE edges have their set sent to several tasks."""
    degrees = materialise(edges.groupBy(end).agg(F.count("*").alias("n")).where(F.col("n") > DEGREE).select(F.col(end).alias("node"), F.ceil(F.col("n") / DEGREE).cast("int").alias("parts")))
    own = sets.join(broadcast_few(degrees), "node", "left").select(F.col("node").alias(end), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("_part"), F.col("shingles").alias(name))
    other = "v" if end == "u" else "u"
    dealt = edges.join(broadcast_few(degrees.withColumnRenamed("node", end)), end, "left").withColumn("_part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return dealt.join(own, [end, "_part"]).drop("_part")


def connect(sets: list[np.ndarray], roots: list[int], minor: list[bool], percent: int) -> list[tuple[int, int]]:
    """Pairs (minor, other) of at least the similarity that connect different roots, as a forest.

    One set is compared with all others at once: its elements are marked, and the marks in each other set are summed.
    """
    parent = {r: r for r in roots}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    sizes = np.array([len(x) for x in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    mark, edges = np.zeros(number.max() + 1, bool), []
    for i in np.flatnonzero(minor).tolist():
        own = number[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        both = np.add.reduceat(mark[number], starts, dtype=np.int64)
        mark[own] = False
        for j in np.flatnonzero(similar(both, sizes, sizes[i], percent)).tolist():
            u, v = find(roots[i]), find(roots[j])
            if u != v:
                parent[u] = v
                edges.append((i, j))
    return edges


def _connected(percent: int):
    """Links of each cell, which are runs of rows (cluster, i, j, node, root, minor, shingles) in sorted batches."""

    def found(rows: list[tuple]) -> tuple[list[int], list[int]]:
        if len({r[1] for r in rows}) < 2:
            return [], []
        nodes, roots, minor, sets = zip(*rows)
        edges = connect(list(sets), list(roots), list(minor), percent)
        return [nodes[i] for i, _ in edges], [nodes[j] for _, j in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            us, vs, shingles = [], [], batch.column(6)
            for at, (cluster, i, j, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)))):
                if (cluster, i, j) != cell:
                    a, b = found(held)
                    us, vs = us + a, vs + b
                    cell, held = (cluster, i, j), []
                held.append((*row, np.array(shingles[at].values)))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
        a, b = found(held)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    return run


def exact_links(candidates: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(u, v): links of at least percent / 100 that connect whatever such links inside a cluster of candidates connect.

    candidates: edges (u, v) of long node numbers, in the shared folder. sets: (node, shingles), a sorted array of different
    64-bit hashes for each node of an edge; sets that are empty must not come.
    """
    edges = candidates.where("u <> v")
    compared = with_sets(with_sets(edges, sets, "u", "a"), sets, "v", "b").select("u", "v", "a", "b")
    good = materialise(compared.mapInArrow(_compared(percent), "u bigint, v bigint"))
    clusters = components(edges).select("node", F.col("root").alias("cluster"))
    placed = materialise(clusters.join(components(good), "node", "left").select("cluster", "node", F.coalesce("root", "node").alias("root")))
    parts = placed.groupBy("cluster", "root").agg(F.count("*").alias("c"))
    open_ = parts.groupBy("cluster").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("most")).where("n > most.c")
    open_ = materialise(open_.select("cluster", "n", (F.col("n") - F.col("most.c")).alias("m"), F.col("most.root").alias("main")))
    total = open_.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return good
    rows = join_on_hot_key(placed, open_, ["cluster"], "n", total).withColumns({
        "minor": F.col("root") != F.col("main"), "rows": F.ceil(F.col("n") / block).cast("int"), "columns": F.ceil(F.col("m") / block).cast("int"),
    })
    row, column = F.pmod(F.xxhash64("node"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("columns")).cast("int")
    every = rows.select("cluster", row.alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), "node", "root", F.lit(False).alias("minor"))
    minor = rows.where("minor").select("cluster", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), column.alias("j"), "node", "root", "minor")
    cells = every.unionByName(minor).join(sets, "node").select("cluster", "i", "j", "node", "root", "minor", "shingles")
    cells = cells.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return good.unionByName(materialise(cells.mapInArrow(_connected(percent), "u bigint, v bigint").distinct()))
