"""SimHash near-duplicates; candidates by pigeonring filtering.

A fingerprint's 64 bits lie on a ring of distance + 1 segments. If two fingerprints differ in `distance` bits at most,
then from some segment on every chain of l consecutive segments differs in floor(l * distance / (distance + 1)) = l - 1
bits at most: the first not at all, the first two in one bit, and so on. The first two links of the chain are a join
key (equal segment, next segment as it is or with one bit set), the later ones are checked one after the other before
the full Hamming distance.

Distinct fingerprints are linked, so exact copies cost nothing, and of the links inside one key only a spanning forest
is kept: components stay the same and the number of rows linear. Keys with over BLOCK fingerprints are dealt into blocks
before they are sent anywhere, and each pair of blocks is a cell of its own, so no task gets a whole hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toroid.llm.common import broadcast_few, join_on_hot_key, materialise
from toroid.llm.components import components

SEED = 42
#: Fingerprints of a block, on average; a cell has two blocks at most, and (2 * BLOCK)**2 pairs of 8 bytes are compared at once.
BLOCK = 1024
#: Shingles hashed at once for a text.
CHUNK = 1 << 16


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text: A-Z lower-cased, shingles of words with repeats, majority of XXH64 bits.

    Fewer words than a shingle make one shingle; no words (or null) give zero.
    """
    words = (data or b"").lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(text[a:b], SEED) for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 bits fit in a byte
        ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) for each row, fp as a signed 64-bit number. Other columns are not read."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["id", "fp"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"id {id_type}, fp bigint")


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Star edges (root, node) of the components of a symmetric boolean matrix."""
    edges, seen = [], np.zeros(len(linked), bool)
    for root in range(len(linked)):
        if seen[root]:
            continue
        seen[root] = True
        frontier = np.array([root])
        while len(frontier):
            new = np.flatnonzero(linked[frontier].any(0) & ~seen)
            seen[new] = True
            edges += [(root, int(x)) for x in new]
            frontier = new
    return edges


def _chain(x: np.ndarray, turn: int, distance: int) -> np.ndarray:
    """Whether XORed fingerprints keep the budgets along the ring from segment `turn` on (the last budget is the full distance)."""
    width = 64 // (distance + 1)
    by = np.uint64(width * turn)
    ring = (x >> by) | (x << np.uint64(64 - width * turn) if turn else np.uint64(0))
    good = np.ones(x.shape, bool)
    for length in range(1, distance + 2):
        part = ring & np.uint64((1 << width * length) - 1)
        good &= np.bitwise_count(part) <= length - 1
        if not good.any():
            break
    return good


def _compare(key: int, prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Star edges among the fingerprints (any order, repeats allowed) that share a key."""
    own = np.unique(prints)
    linked = _chain(own[:, None] ^ own[None, :], key >> 58, distance)
    return [(int(own[i]), int(own[j])) for i, j in _forest(linked | linked.T)]


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


def _link_cells(distance: int):
    """Links inside cells, which are runs of rows (key, lo, hi, fp) in sorted batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, lo, hi, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
            edges, at = [], np.arange(len(starts))
            # a run of one row inside the batch links nothing; the first may go on from the last batch, the last into the next
            for i in np.flatnonzero((ends - starts > 1) | (at == 0) | (at == len(at) - 1)):
                a = starts[i]
                own = (int(keys[a]), int(lo[a]), int(hi[a]))
                if own != cell:
                    edges += _compare(cell[0], np.concatenate(held), distance) if sum(map(len, held)) > 1 else []
                    cell, held = own, []
                held.append(prints[a : ends[i]].view(np.uint64))
            yield _edges(edges)
        if sum(map(len, held)) > 1:
            yield _edges(_compare(cell[0], np.concatenate(held), distance))

    return run


def links(prints: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints (column fp) of `distance` or fewer differing bits.

    Not all such pairs, but a spanning forest of those of each cell: what is connected stays connected, and every edge
    is a chain of true links. distance is 3: at fewer or more segments of 64 bits, keys would be too rare or too common.
    """
    if distance != 3:
        raise ValueError("distance must be 3")
    width = 64 // (distance + 1)
    probes = f"transform(filter(array({', '.join(f'{1 << b}L' for b in range(width, 2 * width))}), b -> (k & b) = 0), b -> k | b)"
    keys = []
    for turn in range(distance + 1):
        ring = f"(shiftrightunsigned(fp, {width * turn}) | shiftleft(fp, {64 - width * turn}))" if turn else "fp"
        chain = f"transform(array({ring} & {(1 << 2 * width) - 1}L), k -> concat(array(k), {probes}))[0]"
        keys.append(F.expr(f"transform({chain}, k -> k | {turn << 58}L)"))
    keyed = prints.select("fp", F.explode(F.concat(*keys)).alias("key"))
    hot = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block))
    cells = keyed.select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "fp")
    if not hot.isEmpty():
        hot = broadcast_few(hot)
        blocks = F.ceil(F.col("n") / block).cast("int")
        dealt = keyed.join(hot, "key").withColumn("at", F.pmod(F.xxhash64("fp", F.lit(SEED)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        cells = cells.join(hot.select("key"), "key", "left_anti").unionByName(dealt.select("key", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), "fp"))
    cells = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return cells.mapInArrow(_link_cells(distance), "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """(id, fp, component_id) for each row of docs; component_id is the smallest id that links lead to, itself included.

    Null, empty and blank texts have fingerprint zero and link like any other. Rows that repeat an id or a text are
    all listed. An empty table gives an empty result. Null ids count in a component but never name it, unless all of
    its ids are null. Texts of any length are read whole. Other columns, whatever their names, are not read.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialise(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), distance, block))
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    placed = materialise(placed)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    total, n = placed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    named = join_on_hot_key(placed.select("fp", "n", "root"), named, ["root"], "prints", n).select("fp", "n", "component_id")
    return join_on_hot_key(prints, named, ["fp"], "n", total).select(F.col("id").alias(id_col), "fp", "component_id")
