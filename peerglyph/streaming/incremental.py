"""Incremental runs: finished units are skipped, new ones are added once.

A file stream with a checkpoint replaces a log of finished work: each file of work units is taken once,
a batch's result replaces its own folders, and a run that stops goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import documents, json_files
from ..sources.sinks import write_unit


def remaining(work: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Units that aren't finished yet."""
    return work.join(finished.select(*keys).distinct(), keys, "left_anti")


def run_new(spark: SparkSession, inbox: str, schema: str, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, by: list[str]) -> int:
    """Score every new file of ``inbox`` once and write its units' folders; the rows written.

    A unit has a folder for each batch that brought rows of it (column ``batch``), so rows of one unit may come
    over several runs. A batch that fails halfway is run again on the next call, and replaces what it had written.
    """
    written = [0]

    def store(batch: DataFrame, number: int) -> None:
        write_unit(score(batch).withColumn("batch", F.lit(number)), out, [*by, "batch"])
        if json_files.exists(spark, out):
            written[0] += documents.read_score_folder(spark, out).where(F.col("batch") == number).count()  # of the written folders alone

    query = spark.readStream.schema(schema).parquet(inbox).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    return written[0]


def counters(results: DataFrame, by: list[str]) -> DataFrame:
    """A unit's counters, worked out from its rows and never carried along."""
    return results.groupBy(*by).agg(F.count("*").alias("rows"), F.count("ssim").alias("computed"), F.count_if("ssim_skipped").alias("skipped"))


def checked(summary: DataFrame, expect_high: list[str], expect_low: list[str], high_mean: float = 0.4, high_max: float = 0.75, low_mean: float = 0.5) -> bool:
    """Whether control pairs came out as they must: the likely ones high, the unlikely ones low or absent.

    ``summary`` has pair, mean_ssim and max_ssim; only the controls' rows come to the driver.
    """
    rows = {r.pair: r for r in summary.where(F.col("pair").isin(*expect_high, *expect_low)).select("pair", "mean_ssim", "max_ssim").collect()}
    good = all(p in rows and rows[p].mean_ssim > high_mean and rows[p].max_ssim > high_max for p in expect_high)
    return good and all(p not in rows or rows[p].mean_ssim < low_mean for p in expect_low)
