"""What a training run leaves behind: tables, the metadata document and the model.

A run writes everything into a folder of its own. Only when all of it is there does one small file, the manifest, name
that folder, with the lengths and checksums of its files; the manifest is written aside and moved into place. So a reader sees the
run before or the run after, never parts of both, and a run that dies in between changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> str:
    """Overwrite a table; an empty one keeps its columns (CSV: the header)."""
    writer = df.write.mode("overwrite")
    writer.parquet(path) if kind == "parquet" else writer.option("header", True).csv(path)
    return path


def write_document(spark: SparkSession, document: dict, path: str) -> str:
    """Overwrite a JSON document: one row of text."""
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_document(spark: SparkSession, path: str) -> dict:
    if not _there(spark, path):
        raise FileNotFoundError(f"Metadata not found: {path}")
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def write_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def read_model(spark: SparkSession, path: str) -> PipelineModel:
    if not _there(spark, path):
        raise FileNotFoundError(f"Model not found: {path}")
    return PipelineModel.load(path)


MANIFEST = "manifest.json"


def _files(spark: SparkSession, folder: str):
    """The file system of a folder, and the status of each file below it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found, each = [], fs.listFiles(at, True)
    while each.hasNext():
        status = each.next()
        if not status.getPath().getName().endswith(".crc"):
            found.append(status)
    return fs, found


def digests(spark: SparkSession, folder: str) -> dict[str, list]:
    """[length, MD5] of each file below a folder, by its path inside; files are read by the executors."""
    fs, found = _files(spark, folder)
    root = fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(folder)).toUri().getPath()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.md5("content").alias("md5")).collect()
    own = {spark._jvm.org.apache.hadoop.fs.Path(r["path"]).toUri().getPath()[len(root) + 1 :]: [r["length"], r["md5"]] for r in rows}
    for status in found:  # files that readers of tables leave out (_SUCCESS and the like)
        own.setdefault(status.getPath().toUri().getPath()[len(root) + 1 :], [status.getLen(), None])
    return dict(sorted(own.items()))


def new_run(out_dir: str) -> str:
    """A folder for a run, below out_dir."""
    return f"{out_dir.rstrip('/')}/runs/{uuid.uuid4().hex}"


def publish(spark: SparkSession, out_dir: str, run: str, names: dict[str, str]) -> dict:
    """Make a complete run the one that readers find; names: paths of its parts, by name."""
    document = {"run": run, "parts": names, "files": digests(spark, run)}
    path, hadoop = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    aside, final = path(f"{run}/{MANIFEST}"), path(f"{out_dir.rstrip('/')}/{MANIFEST}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), hadoop)
    out = final.getFileSystem(hadoop).create(aside, True)
    out.write(bytearray(json.dumps(document).encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, final, overwrite)
    return document


def published(spark: SparkSession, out_dir: str, verify: bool = False) -> dict[str, str]:
    """Paths of the parts of the run that out_dir's manifest names. verify: every file must be as it was published."""
    at = f"{out_dir.rstrip('/')}/{MANIFEST}"
    if not _there(spark, at):
        raise FileNotFoundError(f"No published run: {at}")
    document = json.loads(spark.read.text(at, wholetext=True).first()["value"])
    if verify:
        now = digests(spark, document["run"])
        changed = sorted(k for k, v in document["files"].items() if now.get(k) != v)
        if changed:
            raise ValueError(f"The published run {document['run']} has changed: {changed[:5]}")
    return document["parts"]
