"""Exact deduplication by an extendible-hash index on shared files.

Every row gets a 64-bit key of its normalised text. A directory of key prefixes starts as one bucket; it doubles (one
more bit) for as long as a bucket holds more distinct keys than its capacity, and only overfull buckets split. Runs of
adjacent buckets belong to owners, and each owner's task writes the index entries of its range of keys: for each
text its number of rows and the row that stays. Keys that one row has need no text. The texts of the other keys are sent to
the owners, who compare them byte by byte; different texts of one key form a chain. Rows look up their entry in the index.

Everything runs as DataFrame operations. Each map task collapses its copies before they are sent to an owner, so a text
that a third of all rows share reaches its owner as one row for each map task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from toroid.llm.common import ascii_lower, join_on_hot_key, materialise, rows_without

#: Distinct keys of a bucket, and of an owner. It grows with the table where the directory would have over MOST_BUCKETS.
CAPACITY, MOST_BUCKETS = 2048, 1 << 16
#: Hashes of repeated texts up to this number are broadcast to the scan (about 40 bytes each).
BROADCAST_HASHES = 1_000_000


@dataclass(frozen=True)
class Bucket:
    """All keys whose first `depth` bits are `prefix`."""

    prefix: int
    depth: int
    keys: int
    owner: int = 0


def directory_depth(keys: int, capacity: int) -> int:
    """Bits by which keys are counted: two more than buckets of `capacity` keys would need on average."""
    return max(0, -(-keys // capacity) - 1).bit_length() + 2


def build_directory(counts: dict[int, int], capacity: int, max_depth: int) -> list[Bucket]:
    """Split buckets until none has over `capacity` keys or the directory is max_depth bits deep.

    counts: number of keys by their first max_depth bits. As max_depth follows the number of keys, hashed keys leave no
    bucket overfull; one that is overfull all the same (tests shorten keys) stays whole and is read like the others.
    """
    pending, done = [Bucket(0, 0, sum(counts.values()))], []
    held: dict[tuple[int, int], int] = {}
    for prefix, n in counts.items():
        for depth in range(max_depth + 1):
            at = (depth, prefix >> (max_depth - depth))
            held[at] = held.get(at, 0) + n
    while pending:
        bucket = pending.pop()
        if bucket.keys <= capacity or bucket.depth == max_depth:
            done.append(bucket)
            continue
        for bit in (0, 1):
            prefix = bucket.prefix * 2 + bit
            pending.append(Bucket(prefix, bucket.depth + 1, held.get((bucket.depth + 1, prefix), 0)))
    done.sort(key=lambda b: b.prefix << (max_depth - b.depth))
    owned, owner, load = [], 0, 0
    for bucket in done:
        if load and load + bucket.keys > capacity:
            owner, load = owner + 1, 0
        load += bucket.keys
        owned.append(Bucket(bucket.prefix, bucket.depth, bucket.keys, owner))
    return owned


def _prefix(key: str, depth: int) -> Column:
    """The first bits of a key, as a number (depth 2 at least)."""
    return F.shiftrightunsigned(F.col(key), 64 - depth)


def _routed(rows: DataFrame, directory: list[Bucket], depth: int, owners: int) -> DataFrame:
    """rows sent to the task that owns the bucket of their _key, with the bucket's number and its owner.

    The routes are one row for each slot of the directory, 8 * MOST_BUCKETS at most, so they can be broadcast.
    """
    slots = [(prefix, number, b.owner) for number, b in enumerate(directory) for prefix in range(b.prefix << (depth - b.depth), (b.prefix + 1) << (depth - b.depth))]
    routes = F.broadcast(rows.sparkSession.createDataFrame(slots, "_p long, bucket int, owner int"))
    return rows.withColumn("_p", _prefix("_key", depth)).join(routes, "_p").drop("_p").repartition(owners, "owner")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256, chain_length, bucket, owner, and _raw.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays (null ids come last). Rows that repeat both id and text are all listed, and one of them has kept.
    chain_length is the number of different texts that share the text's key. An empty table gives an empty result;
    columns of docs other than the two named ones are not looked at. key_bits below 64 shortens keys, which tests use
    to force chains.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def key_of(norm: Column) -> Column:
        key = F.xxhash64(norm)
        return F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits) if key_bits < 64 else key

    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_raw"))
    normal = rows.withColumn("_norm", ascii_lower(F.col("_text"))).withColumn("_key", key_of(F.col("_norm")))
    entries = materialise(normal.select("_id", "_raw", "_key", F.unhex(F.sha2("_norm", 256)).alias("_sha"), F.monotonically_increasing_id().alias("_row")))

    # The directory: keys counted by their first bits, buckets split where they are overfull.
    keys = entries.agg(F.approx_count_distinct("_key")).first()[0]
    capacity = max(capacity, -(-keys // MOST_BUCKETS))
    depth = directory_depth(keys, capacity)
    counts = {r["_p"]: r["n"] for r in entries.select("_key").distinct().groupBy(_prefix("_key", depth).alias("_p")).agg(F.count("*").alias("n")).collect()}
    directory = build_directory(counts, capacity, depth)
    owners = directory[-1].owner + 1

    # Owners enter the rows of their keys, which map tasks have collapsed.
    parts = ["_key", "_sha", "_raw"]
    sent = entries.groupBy(F.spark_partition_id().alias("_task"), *parts).agg(F.count("*").alias("_n"), F.max(F.struct("_id", "_row")).alias("_keep")).drop("_task")
    entered = _routed(sent, directory, depth, owners).groupBy("owner", "bucket", *parts).agg(F.sum("_n").alias("_n"), F.max("_keep").alias("_keep"))
    entered = materialise(entered.withColumn("_rows", F.sum("_n").over(Window.partitionBy("owner", "_key"))))

    # The texts of keys with several rows go to the owners too, who compare their bytes and chain those that differ.
    total = entries.count()
    repeated = entered.where("_rows > 1").groupBy("_raw").agg(F.sum("_n").alias("_n"))
    few = repeated.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    texts = rows.select("_raw", "_text")
    texts = texts.join(F.broadcast(repeated.select("_raw")), "_raw") if few else join_on_hot_key(texts, materialise(repeated), ["_raw"], "_n", total)
    texts = texts.withColumn("_norm", ascii_lower(F.col("_text"))).withColumn("_key", key_of(F.col("_norm")))
    texts = texts.groupBy(F.spark_partition_id().alias("_task"), "_key", "_norm").agg(F.count("*").alias("_n")).drop("_task")
    chains = _routed(texts, directory, depth, owners).groupBy("owner", "_key", "_norm").agg(F.sum("_n").alias("_same"))
    chains = materialise(chains.select("owner", "_key", "_same", F.unhex(F.sha2("_norm", 256)).alias("_sha"), F.count("*").over(Window.partitionBy("owner", "_key")).alias("chain_length")))
    chains = chains.groupBy("owner", "_key", "_sha").agg(F.sum("_same").alias("_same"), F.max("chain_length").alias("chain_length"), F.count("*").alias("_texts"))

    index = entered.groupBy("owner", "bucket", "_key", "_sha").agg(F.sum("_n").alias("_n"), F.max("_keep").alias("_keep")).join(chains, ["owner", "_key", "_sha"], "left")
    size = F.coalesce("_same", F.lit(1))
    wrong = F.when((F.coalesce("_texts", F.lit(1)) > 1) | (size != F.col("_n")), F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("boolean"))
    index = index.select("owner", "bucket", "_key", "_sha", size.alias("group_size"), F.coalesce("chain_length", F.lit(1)).alias("chain_length"), F.col("_keep._id").alias("keep_id"), F.col("_keep._row").alias("_keep_row"), wrong.alias("_wrong"))
    index = materialise(index).where("_wrong is null").drop("_wrong")

    joined = join_on_hot_key(entries, index, ["_key", "_sha"], "group_size", total)
    return joined.select(
        F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long"), (F.col("_row") == F.col("_keep_row")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"), "chain_length", "bucket", "owner", "_raw",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of equal texts (see find_copies), all columns kept.

    Decisions are an id and a hash of the text. Where the rows that go are few, they are broadcast and no text moves.
    Where a row repeats both id and text, one copy stays.
    """
    decided = materialise(find_copies(docs, id_col, text_col, **options).select(F.col(id_col).alias("_at_id"), "_raw", "kept"))
    again = materialise(decided.groupBy("_at_id", "_raw").agg(F.count("*").alias("n"), F.max("kept").alias("kept")))
    out = rows_without(docs, again.where("not kept").select("_at_id", "_raw"), id_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    if again.where("kept and n > 1").limit(1).count():
        out = out.dropDuplicates([id_col, text_col])
    return out
