"""Rows that equal another row in all columns, found by digests of a fixed width.

Only 16 bytes of a row are shuffled, and added up before that. Whole rows are compared where digests meet, so a collision of
digests changes no result; rows whose digest no other row has stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toroid.sources.shared import materialise

#: Digests up to this number are broadcast (about 60 bytes each), and the share of all rows above which a digest always is.
BROADCAST_DIGESTS = 200_000
HOT_SHARE = 1e-3

DIGEST = ["_digest_a", "_digest_b"]


def _with_digest(df: DataFrame, bits: int) -> DataFrame:
    """df with two hashes of all columns, nulls told apart from columns beside them; NaNs are equal, and so are zeros of both signs."""
    cells = [part for c in df.columns for part in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return df.withColumns({name: F.shiftrightunsigned(F.xxhash64(F.lit(i), *cells), 64 - bits) for i, name in enumerate(DIGEST)})


def split_repeats(df: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose digest no other row has, and the other rows. df is read more than once and must not change between reads.

    Few repeated digests are broadcast after a count. Beyond that the rows are shuffled by digest, but for those of digests above
    HOT_SHARE of all rows, which number 1 / HOT_SHARE at most and are broadcast. bits: of each hash (for tests of collisions).
    """
    rows = _with_digest(df, bits)
    counts = materialise(rows.groupBy(*DIGEST).agg(F.count("*").alias("_n")).where("_n > 1"))
    few = counts.count()
    if few <= BROADCAST_DIGESTS:
        keys = F.broadcast(counts.select(*DIGEST))
        return rows.join(keys, DIGEST, "left_anti").select(*[f"`{c}`" for c in df.columns]), rows.join(keys, DIGEST, "left_semi").select(*[f"`{c}`" for c in df.columns])
    hot = F.broadcast(counts.where(F.col("_n") > df.count() * HOT_SHARE).select(*DIGEST))
    cool = rows.join(hot, DIGEST, "left_anti")
    again = rows.join(hot, DIGEST, "left_semi").unionByName(cool.join(counts, DIGEST, "left_semi"))
    return cool.join(counts, DIGEST, "left_anti").select(*[f"`{c}`" for c in df.columns]), again.select(*[f"`{c}`" for c in df.columns])


def repeat_counts(df: DataFrame, bits: int = 64) -> DataFrame:
    """One row: duplicates (rows that equal an earlier row) and duplicate_groups. Without columns all rows are equal."""
    again = split_repeats(df, bits)[1] if df.columns else df
    groups = again.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.greatest(F.col("_n") - 1, F.lit(0))), F.lit(0)).alias("duplicates"), F.count_if(F.col("_n") > 1).alias("duplicate_groups"))


def without_repeats(df: DataFrame, bits: int = 64) -> DataFrame:
    """One of each set of equal rows."""
    single, again = split_repeats(df, bits)
    return single.unionByName(again.dropDuplicates())
