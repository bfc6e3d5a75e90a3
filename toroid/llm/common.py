"""Helpers that several operators share: lower-casing, and joins that withstand a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toroid.sources.shared import materialise, table

__all__ = ["BROADCAST_IDS", "HOT_LEAST", "HOT_SHARE", "LOWER", "UPPER", "WORD", "ascii_lower", "broadcast_few", "join_on_hot_key", "materialise", "rows_without", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A maximal run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot above this share of all rows, so at most 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 1e-3
HOT_LEAST = 200


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the fast built-in, which then does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def join_on_hot_key(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to groups (one row for each key; `size` is its number of rows of `rows`, `total` their sum).

    Groups above HOT_SHARE of all rows number 1 / HOT_SHARE at most, so they are broadcast and their rows stay where
    they are; the other groups are shuffled, and none of them is large enough to overload a task.
    """
    limit = max(HOT_LEAST, int(total * HOT_SHARE))
    hot = F.broadcast(groups.where(F.col(size) > limit).withColumn("_hot", F.lit(True)))
    marked = rows.join(F.broadcast(groups.where(F.col(size) > limit).select(*key).withColumn("_hot", F.lit(True))), key, "left")
    few = marked.where(F.col("_hot").isNull()).drop("_hot").join(groups.where(F.col(size) <= limit), key, how)
    many = rows.join(hot, key, "inner").drop("_hot")
    return few.unionByName(many)


#: Ids up to this number are broadcast to filter rows (about 40 bytes each).
BROADCAST_IDS = 200_000


def broadcast_few(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """df, to be broadcast if a count shows it to have few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def rows_without(rows: DataFrame, gone: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """rows but those whose (id, digest) is in gone (two columns, in that order); null ids are compared like others.

    Few are broadcast after a count; many are shuffled by both columns, which no key can make uneven, and sorted (both
    sides of that join can spill).
    """
    gone = gone.toDF("_gone_id", "_gone_digest")
    return rows.join(broadcast_few(gone), F.col(id_col).eqNullSafe(F.col("_gone_id")) & (digest == F.col("_gone_digest")), "left_anti")
