from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from toroid.llm.queries import ORACLE_SQL, QUERIES
from toroid.llm.simhash import near_duplicates

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, other = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    at = [other.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in other.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op2_language_id", "op4_quality", "op5_toxicity", "op8_token_counts"])
def test_one_row_for_each_document(spark, name):
    ids = sorted(r.doc_id for r in QUERIES[name](spark, SF).collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_all_queries_are_registered():
    names = entry_point.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        texts[name] = docs.count()
        if name != "mixing sources":
            assert docs.columns == columns
        if name == "exact dedup":
            low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            assert docs.select(low).distinct().count() == docs.count() == before.select(low).distinct().count()
        if name == "near dedup":
            left = near_duplicates(docs)
            assert left.select("component_id").distinct().count() == left.count()
    assert docs.where("copies < 1 or taken <> copies * size").count() == 0
    counts = list(texts.values())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "One two three. Four five six.", "en", "s"), (3, "One two three. Four five six.", "en", "s"), (None, "w " * 50000, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for at in (tmp_path, tmp_path / "none"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 4
