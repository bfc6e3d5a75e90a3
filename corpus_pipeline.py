"""A training corpus from raw documents, in stages that each call one operator of toroid.llm.

All stages take any documents: null and empty texts are scored, are copies of each other and are taken 0 words of; texts are
read whole, however long; rows are told apart by id and text, so rows that repeat an id with other texts are decided
apart, null ids too, and rows that repeat both leave one row; an empty table gives an empty table; further columns are kept
(the last stage replaces those named size, source_size, target, copies or taken).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toroid.llm import quality
from toroid.llm.common import materialise, rows_without, table
from toroid.llm.decontaminate import find_overlaps
from toroid.llm.exact_dedup import drop_copies
from toroid.llm.mixing import mix, take
from toroid.llm.near_copies import drop_near_copies
from toroid.llm.queries import held_out

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labels outside the held-out fifth."""
    model = quality.learn(docs.where(~held_out(5, 0)), table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    return docs.where(quality.quality_score(model, F.col("text")) >= quality.THRESHOLD)


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a five-word Jaccard similarity of 0.8 or more, the document with the smallest id."""
    return drop_near_copies(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    digest = F.md5(F.coalesce("text", F.lit("")))  # ids may repeat with other texts
    found = find_overlaps(docs.select(F.struct("doc_id", digest.alias("digest")).alias("_row"), "text"), table(spark, sf_dir, "benchmark"), "_row")
    return rows_without(docs, materialise(found.select("_row.doc_id", "_row.digest").distinct()), "doc_id", digest)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies."""
    return take(docs, materialise(mix(docs)), repeat=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality), ("exact dedup", no_exact_copies), ("near dedup", no_near_copies), ("decontamination", no_benchmark), ("mixing sources", mixed),
]

#: The classifier and the rounding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
