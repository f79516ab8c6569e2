"""Tables that cut a plan, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir.

    Only where that is unset and everything runs in one process (tests) a temporary folder is made and set; on
    a cluster each machine would see another one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="peerglyph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/peerglyph/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop_quietly, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table through Spark's own file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session may be gone when the interpreter ends
        pass


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder; the table read again, and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
