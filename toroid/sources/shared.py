"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one is made only in local mode where that is unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("toroid.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("toroid.shared.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and is computed once. options: the writer's."""
    path = new_path(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and modification times of the files of a path: another stamp means other data."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
