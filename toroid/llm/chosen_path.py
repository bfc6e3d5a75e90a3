"""Set similarity join by chosen paths.

A document's set (its different word shingles) is represented by POSITIONS minwise tokens. At a node of a tree a
document goes on along those of its tokens that the node's hash function chooses, two on average; whoever chooses the
same token meets in the same child. Two sets of similarity s share s * POSITIONS tokens and so 2 * s children on
average: at 0.8 more than one, so that they stay together along some path however deep the tree gets, while sets that
share little lose each other. A tree misses a pair of similarity 0.8 with chance 0.36 at most; TREES independent trees
miss one pair in a million.

Nodes of up to LEAF documents are compared exhaustively by their tokens. Larger ones first compare each document
that is similar to the node's average with the whole node and take it out; the rest branch. Nodes above NODE
documents branch in a Spark job of their own, smaller ones inside a task; one that is still as large after DEPTH jobs is dealt into cells of
two blocks, so it is compared all the same. What comes out are candidate edges, a forest for each node; set_links
confirms links on whole sets.

Equal sets are one document here, so exact copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toroid.llm.common import broadcast_few, join_on_hot_key, materialise
from toroid.llm.components import components
from toroid.llm.near_copies import shingle_set
from toroid.llm.set_links import exact_links

SHINGLE, PERCENT = 2, 80
POSITIONS, TREES = 64, 14
#: A token is chosen with chance 1 / CHOICE: CHOICE = POSITIONS / 2 makes two children on average.
CHOICE = POSITIONS // 2
#: Equal tokens of a candidate pair; a pair of similarity 0.8 has fewer in one case of ten million.
MATCHES = 33
LEAF, NODE, DEPTH, DEEP = 48, 1 << 15, 8, 24
#: Average share of equal tokens above which a document is compared with its whole node.
DENSE = 0.4
#: Token comparisons at once.
AT_ONCE = 1 << 22
SEED = 42
#: Shingles hashed at once for a text.
CHUNK = 1 << 12

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
_ROOTS = _RNG.integers(0, 1 << 63, (TREES, POSITIONS), dtype=np.uint64)
_PLACES = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(shingles: np.ndarray) -> np.ndarray:
    """The minwise hash of a set at each position."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        part = shingles[at : at + CHUNK, None]
        least = np.minimum(least, (((part ^ (part >> np.uint64(31))) * _FACTORS) + _OFFSETS).min(0))
    return _mix(least)


def sketch(least: np.ndarray) -> np.ndarray:
    """One byte of each token."""
    return (least & np.uint64(255)).astype(np.uint8)


def root_keys(least: np.ndarray) -> np.ndarray:
    """Children of all trees' roots that the tokens choose."""
    paths = _mix(_ROOTS ^ least)
    return paths[paths % np.uint64(CHOICE) == 0]


def child_keys(keys: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each chosen token of each row; keys: the node of each row."""
    paths = _mix((keys[:, None] ^ _PLACES) + sketches * np.uint64(0x9E3779B97F4A7C15))
    rows, places = np.nonzero(paths % np.uint64(CHOICE) == 0)
    return rows, paths[rows, places]


def _fits(sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    return (100 * sizes_a >= PERCENT * sizes_b) & (100 * sizes_b >= PERCENT * sizes_a)


def leaf_edges(members: np.ndarray, sketches: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Candidate edges of leaves of one size (members: leaves x size, row numbers): each row with the first one it matches, and what
    that leaves unconnected."""
    k, n = members.shape
    out = []
    for at in range(0, k, max(1, AT_ONCE // (n * n * POSITIONS))):
        own = members[at : at + max(1, AT_ONCE // (n * n * POSITIONS))]
        x, size = sketches[own], sizes[own]
        match = (x[:, :, None] == x[:, None]).sum(-1, dtype=np.uint8) >= MATCHES
        match &= _fits(size[:, :, None], size[:, None]) & np.tri(n, k=-1, dtype=bool)
        if not match.any():
            continue
        some = match.any(2)
        parent = np.where(some, match.argmax(2), np.arange(n))
        root = parent
        for _ in range(n.bit_length()):
            root = np.take_along_axis(root, root, 1)
        a, i = np.nonzero(some)
        out.append(np.stack([own[a, i], own[a, parent[a, i]]]))
        a, i, j = np.nonzero(match & (root[:, :, None] != root[:, None]))
        out.append(np.stack([own[a, i], own[a, j]]))
    return out


def whole_edges(first: np.ndarray, members: np.ndarray, sketches: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Candidate edges that connect the matches of each row of `first` among `members`, as a forest."""
    label, out = np.arange(len(members)), []
    place = np.searchsorted(members, first)
    x, size = sketches[members], sizes[members]
    for at in range(0, len(first), max(1, AT_ONCE // (len(members) * POSITIONS))):
        own = place[at : at + max(1, AT_ONCE // (len(members) * POSITIONS))]
        match = (x[own][:, None] == x[None]).sum(-1, dtype=np.uint8) >= MATCHES
        match &= _fits(size[own][:, None], size[None])
        for r, i in enumerate(own.tolist()):
            apart = np.flatnonzero(match[r] & (label != label[i]))
            if len(apart):
                labels, at_first = np.unique(label[apart], return_index=True)
                partners = apart[at_first]
                out.append(np.stack([np.full(len(partners), members[i]), members[partners]]))
                label[np.isin(label, labels)] = label[i]
    return out


def node_edges(key: int, sketches: np.ndarray, sizes: np.ndarray, pool: dict[int, list[np.ndarray]], base: int) -> list[np.ndarray]:
    """Candidate edges of a node of over LEAF documents (rows from base on); its leaves go to the pool, by size."""
    out, todo = [], [(key, np.arange(len(sketches)), 0)]
    while todo:
        key, members, depth = todo.pop()
        if len(members) <= LEAF:
            pool.setdefault(len(members), []).append(members + base)
            continue
        x = sketches[members]
        flat = x + np.arange(POSITIONS) * 256
        shared = np.bincount(flat.ravel(), minlength=POSITIONS * 256)[flat].mean(1) - 1
        dense = shared >= DENSE * (len(members) - 1) if depth < DEEP else np.ones(len(members), bool)
        if dense.any():
            out += [e + base for e in whole_edges(members[dense], members, sketches, sizes)]
            members = members[~dense]
            x = x[~dense]
        if len(members) < 2:
            continue
        rows, keys = child_keys(np.full(len(members), key, np.uint64), x)
        order = np.argsort(keys, kind="stable")
        rows, keys = rows[order], keys[order]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
        for i in np.flatnonzero(ends - starts > 1).tolist():
            todo.append((keys[starts[i]], members[rows[starts[i] : ends[i]]], depth + 1))
    return out


def _edges(nodes: np.ndarray, edges: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate(edges, 1) if edges else np.zeros((2, 0), np.int64)
    ends = nodes[both]
    both = np.unique(np.stack([ends.min(0), ends.max(0)]), axis=1) if ends.size else ends
    return pa.RecordBatch.from_arrays([pa.array(both[0].astype(np.int64)), pa.array(both[1].astype(np.int64))], ["u", "v"])


def _columns(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(batches).combine_chunks()
    key, node, size = (t.column(c).to_numpy() for c in ("key", "node", "size"))
    data = t.column("sketch").combine_chunks() if isinstance(t.column("sketch"), pa.ChunkedArray) else t.column("sketch")
    flat = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
    return key, node, flat.reshape(-1, POSITIONS), size


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate edges of the nodes, which are runs of rows (key, node, sketch, size) in batches sorted by key and node.

    Whole runs are searched together; the last run of a batch waits for the next, so memory holds a batch and one node.
    """

    def searched(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        key, node, sketches, sizes = _columns(held)
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
        count, edges, pool = ends - starts, [], {}
        for n in np.unique(count[(count > 1) & (count <= LEAF)]).tolist():
            edges += leaf_edges(starts[count == n][:, None] + np.arange(n), sketches, sizes)
        for i in np.flatnonzero(count > LEAF).tolist():
            a, b = starts[i], ends[i]
            edges += node_edges(key[a].astype(np.int64).view(np.uint64), sketches[a:b], sizes[a:b], pool, int(a))
        for n, leaves in pool.items():
            edges += leaf_edges(np.array(leaves), sketches, sizes) if n > 1 else []
        return _edges(node, edges)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # where the last run begins
        if cut:
            yield searched([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and held[-1].column(0)[0].as_py() != key[0]:
            yield searched(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield searched(held)


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, sketch, size) of the children that each row chooses."""
    for batch in batches:
        if batch.num_rows:
            key, _, sketches, _ = _columns([batch])
            rows, keys = child_keys(key.astype(np.int64).view(np.uint64), sketches)
            out = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), out.column(1), out.column(2), out.column(3)], batch.schema.names)


def _dealt(rows: DataFrame, hot: DataFrame, node: int) -> DataFrame:
    """rows of nodes too large for a task, in cells of two blocks each of which is a node of its own."""
    blocks = F.ceil(2 * F.col("n") / node).cast("int")
    dealt = rows.join(hot, "key").withColumn("at", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select(F.xxhash64("key", F.least("at", "other"), F.greatest("at", "other")).alias("key"), "node", "sketch", "size")


def candidates(sets: DataFrame, node: int = NODE, depth: int = DEPTH) -> DataFrame:
    """Edges (u, v) that connect what may be similar. sets: (node, keys, sketch, size), keys as root_keys() gives them."""
    rows, found = sets.select(F.explode("keys").alias("key"), "node", "sketch", "size"), None
    for level in range(depth + 1):
        hot = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > node))
        ready = rows
        large = not hot.isEmpty()
        if large:
            hot = broadcast_few(hot)
            ready = rows.join(hot.select("key"), "key", "left_anti")
            if level == depth:
                ready = ready.unionByName(_dealt(rows, hot, node))
        edges = ready.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_search, "u bigint, v bigint")
        edges = materialise(edges.distinct())
        found = edges if found is None else found.unionByName(edges)
        if not large or level == depth:
            return found if level == 0 else materialise(found.distinct())
        rows = materialise(rows.join(hot.select("key"), "key", "left_semi").mapInArrow(_branch, "key bigint, node bigint, sketch binary, size int"))
    return found


def _described(shingle: int):
    """(id, md5, digest, size, sketch, keys) from (id, md5, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            digests, sizes, sketches, keys = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                if not (text or b"").split():
                    digests.append(None), sizes.append(0), sketches.append(None), keys.append(None)
                    continue
                own = shingle_set(text, shingle)
                least = tokens(own)
                digests.append(hashlib.md5(own.tobytes()).digest())
                sizes.append(len(own))
                sketches.append(sketch(least).tobytes())
                keys.append(root_keys(least).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "md5", "digest", "size", "sketch", "keys"],
            )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, shingle).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.sort(x) for x in found], pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, node: int = NODE, depth: int = DEPTH) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs; component_id is the smallest id that links lead to.

    A set holds the different word shingles of a text, A-Z lower-cased; fewer words than a shingle make one shingle. Sets link when
    100 * shared >= 80 * all, confirmed on whole sets. Null, empty and blank texts have no shingle and link with nothing, not even with each
    other. Rows that repeat an id or a text are all listed; kept is true where the id is its component's. Null ids count in a
    component but never name it, unless all of its ids are null; a null id is never kept. Texts are read whole. An empty table
    gives an empty result. Other columns, whatever their names, are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("md5"), text.alias("text"))
    told = materialise(rows.mapInArrow(_described(shingle), f"id {id_type}, md5 binary, digest binary, size int, sketch binary, keys array<bigint>"))
    sets = told.where("digest is not null").groupBy("digest").agg(
        F.count("*").alias("n"), F.min("id").alias("least"), F.min("md5").alias("md5"), F.any_value("size").alias("size"), F.any_value("sketch").alias("sketch"), F.any_value("keys").alias("keys"),
    )
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()))  # numbers are fixed once they are written
    edges = candidates(sets.select("node", "keys", "sketch", "size"), node, depth)

    ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    wanted = broadcast_few(materialise(sets.join(ends, "node", "left_semi").select("md5", "node")))
    texts = rows.select("md5", "text").join(wanted, "md5").dropDuplicates(["node"])
    whole = materialise(texts.select("node", "text").mapInArrow(_sets(shingle), "node bigint, shingles array<bigint>"))
    roots = components(exact_links(edges, whole, PERCENT))

    placed = materialise(sets.select("node", "digest", "n", "least").join(roots, "node", "left").select("digest", "n", "least", F.coalesce("root", "node").alias("root")))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("sets"))
    count, total = placed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = join_on_hot_key(placed, named, ["root"], "sets", count).select("digest", "n", "component_id")
    linked = join_on_hot_key(told.where("digest is not null").select("id", "digest", "size"), named, ["digest"], "n", total).select("id", "size", "component_id")
    out = linked.unionByName(told.where("digest is null").select("id", "size", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
