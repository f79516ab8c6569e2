"""Text documents, recorded experiment runs and scored results, and score folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

RUN_KEY = ["model", "variant", "run"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: name and text."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))


def read_runs(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """Recorded runs of a result tree, a file each; malformed files and failed runs are passed over."""
    rows = spark.read.schema(schemas.ATTACK_RUN + ", _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).json(path)
    return rows.where("_corrupt_record is null and content is not null and error is null and model is not null").drop("_corrupt_record")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scored runs; broken lines are passed over."""
    return spark.read.schema(schemas.ATTACK_SCORE).option("mode", "DROPMALFORMED").json(path).where("model is not null")


def read_score_folder(spark: SparkSession, path: str) -> DataFrame:
    """Comparisons of all script pairs; the pair is a pair of partition columns, so one pair is one folder."""
    return spark.read.option("basePath", path).parquet(path)
