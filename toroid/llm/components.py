"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toroid.llm.common import materialise

MAX_ROUNDS = 60
#: Links of a file between rounds, on average.
FILE_ROWS = 1 << 20


def _settled(links: DataFrame) -> bool:
    """Whether links (u, v) of u > v are stars: each u hangs on one v, and no v hangs on anything."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1 and hangs > 0").isEmpty()


def _few_files(links: DataFrame, rows: int) -> DataFrame:
    """links in files that follow their number of rows, one for each core at least, so that small rounds stay short."""
    return links.coalesce(max(links.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (u, v): root is the smallest node that can be reached.

    Large star hangs the larger neighbours of each node on its smallest neighbour, small star the smaller ones, until
    every node hangs on its root, which one aggregation tells; chains of n nodes take O(log n) rounds. Minima are pre-aggregated, and each round
    is written to the shared folder, so lineage stays short and a lost executor costs one round at most. A hub's links
    are one join key with one row on the other side, which adaptive execution splits over tasks (skew join). Self-links
    and repeated links are allowed; no links give an empty table.
    """
    links = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    rows = links.count()
    for _ in range(MAX_ROUNDS):
        if _settled(links):
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(_few_files(large, rows))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialise(_few_files(small.unionByName(lowest.withColumnRenamed("m", "v")).distinct(), rows))
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
