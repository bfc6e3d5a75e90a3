"""Near copies by the Jaccard similarity of word shingles: SimHash links and MinHash bands propose pairs, whole shingle sets decide.

The first pairs are the links of simhash.links: fingerprints of three bits' distance, found by pigeonring filtering, and texts
of one fingerprint. They are confirmed on whole sets like all others, and what they connect is not compared again.

Texts of similarity 0.8 differ in about ten of the 64 bits of a SimHash, too many for segments that still tell texts
apart. Bands of ROWS minima propose a pair of similarity s with chance 1 - (1 - s**ROWS)**BANDS, which is above 0.9999
at 0.8. Every pair that is used is then compared by its whole sets.

Texts that share a band are linked in two steps. First each is compared with one text of its band (of its block, where
bands are large), which connects most of them. Then, in bands whose texts are still in several components, all texts outside
the band's largest component are compared with all texts of the band, in cells of bounded size; a cell gives a spanning
forest of the links it finds. So no pair of a band that could connect anything stays uncompared, and rows stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toroid.llm.common import broadcast_few, join_on_hot_key, materialise, rows_without
from toroid.llm.components import components
from toroid.llm.simhash import fingerprints, links

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
#: Texts of a block, on average; a cell compares two blocks.
BLOCK = 256
SEED = 42
#: Shingles hashed at once for a text.
CHUNK = 1 << 12

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(data: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles of a UTF-8 text, A-Z lower-cased.

    Fewer words than a shingle make one shingle, and so does no word (or null).
    """
    words = (data or b"").lower().split()
    text = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) < shingle:
        starts, ends = np.zeros(1, np.int64), np.array([len(text)])
    else:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(text[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets that are not empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK, None]
        least = np.minimum(least, (((part ^ (part >> np.uint64(31))) * _FACTORS) + _OFFSETS).min(0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + least[i::ROWS]
    return (keys ^ (keys >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [minima(shingle_set(t, shingle)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            keys = [band_keys(m).view(np.int64) for m in least]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, shingle).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def _check(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            good = [jaccard(np.array(a[i].values).view(np.uint64), np.array(b[i].values).view(np.uint64)) >= similarity - 1e-12 for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def connect(sets: list[np.ndarray], roots: list[str], minor: list[bool], similarity: float) -> list[tuple[int, int]]:
    """Pairs (minor, other) of at least the similarity that connect different roots, as a forest.

    One text is compared with all others at once: its shingles are marked, and the marks in each other set are summed.
    """
    parent = {r: r for r in roots}

    def find(r: str) -> str:
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
        for j in np.flatnonzero(both >= (similarity - 1e-12) * (sizes + sizes[i] - both)).tolist():
            u, v = find(roots[i]), find(roots[j])
            if u != v:
                parent[u] = v
                edges.append((i, j))
    return edges


def _connect_cells(similarity: float):
    """Links of each cell, which are runs of rows (key, i, j, node, root, minor, shingles) in sorted batches."""

    def found(rows: list[tuple]) -> list[tuple[str, str]]:
        if len({r[1] for r in rows}) < 2:
            return []
        nodes, roots, minor, sets = zip(*rows)
        return [(nodes[i], nodes[j]) for i, j in connect([s.view(np.uint64) for s in sets], list(roots), list(minor), similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            out, shingles = [], batch.column(6)
            for at, (key, i, j, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)))):
                if (key, i, j) != cell:
                    out += found(held)
                    cell, held = (key, i, j), []
                held.append((*row, np.array(shingles[at].values)))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.string()), pa.array([p[1] for p in out], pa.string())], ["u", "v"])
        out = found(held)
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.string()), pa.array([p[1] for p in out], pa.string())], ["u", "v"])

    return run


def printed_pairs(texts: DataFrame) -> DataFrame:
    """(u, v): texts (node, text) that SimHash links. Each with the first of its fingerprint, and the first ones of linked fingerprints."""
    prints = materialise(fingerprints(texts, "node"))
    first = materialise(prints.groupBy("fp").agg(F.min("id").alias("u"), F.max("id").alias("last"), F.count("*").alias("n")))
    linked = links(first.select("fp")).join(first.select(F.col("fp").alias("u"), F.col("u").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("u").alias("b")), "v")
    shared = materialise(first.where("u <> last").select("fp", "u", "n"))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    same = join_on_hot_key(prints, shared, ["fp"], "n", total).select("u", F.col("id").alias("v"))
    return materialise(linked.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(same.where("u <> v")).distinct())


def near_links(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(u, v): pairs of texts, named by their MD5, of at least the similarity; what such pairs connect, they connect."""
    texts = docs.select(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("node"), F.col(text_col).cast("string").alias("text"))
    sketches = materialise(texts.mapInArrow(_sketches(shingle), "node string, keys array<bigint>"))
    printed = printed_pairs(texts)
    keyed = sketches.select(F.explode("keys").alias("key"), "node")
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last"))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = materialise(join_on_hot_key(keyed, shared.select("key", "n", "first"), ["key"], "n", total).distinct())

    # Each text with one of its block, and one text of each block with one of the band.
    blocked = members.withColumn("at", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block)))
    centres = blocked.groupBy("key", "at").agg(F.min("node").alias("u"), F.first("first").alias("first"))
    pairs = blocked.select("key", "at", "node").join(centres, ["key", "at"]).select("u", F.col("node").alias("v")).unionByName(centres.select("first", "u").toDF("u", "v"))
    pairs = materialise(pairs.unionByName(printed).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    nodes = members.select("node").unionByName(printed.select(F.explode(F.array("u", "v")).alias("node")))
    known = broadcast_few(materialise(nodes.distinct()))
    sets = materialise(texts.join(known, "node", "left_semi").mapInArrow(_sets(shingle), "node string, shingles array<bigint>").dropDuplicates(["node"]))
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    good = materialise(both.select("u", "v", "a", "b").mapInArrow(_check(similarity), "u string, v string"))

    # Bands that are still in several components: all but the largest component against all.
    placed = materialise(members.select("key", "node").join(components(good), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    open_ = materialise(parts.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("most")).where("n > most.c").select("key", "n", (F.col("n") - F.col("most.c")).alias("m"), F.col("most.root").alias("main")))
    total = open_.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return good
    rows = join_on_hot_key(placed, open_, ["key"], "n", total).withColumns({
        "minor": F.col("root") != F.col("main"), "rows": F.ceil(F.col("n") / block).cast("int"), "columns": F.ceil(F.col("m") / block).cast("int"),
    })
    row, column = F.pmod(F.xxhash64("node"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("columns")).cast("int")
    every = rows.select("key", row.alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), "node", "root", F.lit(False).alias("minor"))
    minor = rows.where("minor").select("key", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), column.alias("j"), "node", "root", "minor")
    cells = every.unionByName(minor).join(sets, "node").select("key", "i", "j", "node", "root", "minor", "shingles")
    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return good.unionByName(materialise(cells.mapInArrow(_connect_cells(similarity), "u string, v string").distinct()))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component of near_links, the one with the smallest id, all columns kept.

    Rows are told apart by id and text, so other rows of a repeated id stay. Null ids come last, and of equal ids the
    smaller MD5 of the text stays. Equal texts are near copies, and so are all texts without a word. Rows that repeat
    both id and text leave one row. An empty table gives an empty result.
    """
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), digest.alias("node"))
    placed = rows.join(components(near_links(docs, text_col, **options)), "node", "left").select("_id", "node", F.coalesce("root", "node").alias("root"))
    placed = materialise(placed.groupBy("root", "_id", "node").agg(F.count("*").alias("n")))
    kept = placed.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "node")).alias("k")).select("k._id", "k.node")
    kept = materialise(kept.withColumnsRenamed({"_id": "_keep", "node": "_keep_node"}))
    gone = placed.join(kept, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("node") == F.col("_keep_node")), "left_anti").select("_id", "node")
    out = rows_without(docs, materialise(gone), id_col, digest)
    return out.dropDuplicates([id_col, text_col]) if placed.where("n > 1").limit(1).count() else out
