"""JSON sources: arrays, documents with pairs, gzip, line files and progress logs. Gzip is read by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects; a file that isn't JSON fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document in a file, plain or gzip."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_pairs(spark: SparkSession, path: str, schema: str = schemas.DISCOVERY) -> DataFrame:
    """The ``pairs`` of a document; none if the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    fields = spark.createDataFrame([], schema).schema
    whole = spark.read.schema(f"pairs array<{fields.simpleString()}>").option("multiLine", True).json(path)
    return whole.select(F.inline("pairs"))


def read_pair_lines(spark: SparkSession, path: str, key: str = "meanSsim", schema: str = schemas.DISCOVERY) -> DataFrame:
    """A document that was written with a pair on each line, read by lines.

    Lines that begin with "{" and hold ``key`` are pairs; a comma at the end is dropped, and lines that
    aren't whole JSON are passed over. Such files split if they aren't compressed, so this scales to
    score files of any size.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(F.col("line").startswith("{") & F.contains("line", F.lit(f'"{key}"')))
    parsed = lines.select(F.from_json(F.regexp_replace("line", ",$", ""), schema).alias("p"), F.col("line"))
    return parsed.where("p is not null and coalesce(p.source, p.target) is not null").select("p.*")


def read_progress(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """A log of finished units, broken lines passed over; the last line of a key counts.

    The latest line is found by a partial aggregate of (file, place, row), not by sorting all lines.
    """
    lines = spark.read.text(path).withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    rows = lines.select("_at", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where(" and ".join(f"r.`{k}` is not null" for k in keys))
    last = rows.groupBy(*(F.col(f"r.{k}").alias(k) for k in keys)).agg(F.max_by("r", "_at").alias("r"))
    return last.select("r.*")


def flatten(pairs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Pairs with ``fonts`` to one row for each comparison; ``ord`` is its place in the array."""
    keep = keep or [c for c in pairs.columns if c not in ("fonts", "summary", "bestFont")]
    rows = pairs.select(*keep, F.posexplode("fonts").alias("ord", "f"))
    return rows.select(
        *keep, "ord", F.col("f.sourceFont").alias("source_font"), F.col("f.targetFont").alias("target_font"), F.col("f.ssim").alias("ssim"), F.col("f.pHash").alias("phash"),
        F.col("f.sourceRenderStatus").alias("status"), F.col("f.sourceFallbackFont").alias("fallback_font"), F.coalesce("f.ssimSkipped", F.lit(False)).alias("ssim_skipped"),
    )


def nest(comparisons: DataFrame, keys: list[str]) -> DataFrame:
    """Back to one row for each pair, its comparisons in order in ``fonts``."""
    entry = F.struct("ord", F.col("source_font").alias("sourceFont"), F.col("target_font").alias("targetFont"), "ssim", F.col("phash").alias("pHash"), F.col("status").alias("sourceRenderStatus"), F.col("fallback_font").alias("sourceFallbackFont"), F.col("ssim_skipped").alias("ssimSkipped"))
    return comparisons.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e.dropFields("ord")).alias("fonts"))


def read_render_index(spark: SparkSession, path: str, pixels: bool = False) -> DataFrame:
    """A render index as rows: role, ch, font and metadata; the file name of the image only if asked for."""
    whole = read_document(spark, path, schemas.RENDER_INDEX)
    sides = [whole.select(F.lit(role).alias("role"), F.explode(side).alias("ch", "entries")) for role, side in (("source", "sources"), ("target", "targets"))]
    rows = sides[0].unionByName(sides[1]).select("role", "ch", F.posexplode("entries").alias("ord", "e"))
    extra = [F.col("e.png").alias("png")] if pixels else []
    return rows.select("role", "ch", "ord", F.col("e.font").alias("font"), F.col("e.category").alias("category"), F.conv("e.pHash", 16, -10).cast("long").alias("phash"), F.col("e.renderStatus").alias("status"), F.col("e.fallbackFont").alias("fallback_font"), F.col("e.inkWidth").alias("ink_w"), F.col("e.inkHeight").alias("ink_h"), *extra)


def only_characters(renders: DataFrame, wanted: DataFrame) -> DataFrame:
    """The renders of the wanted characters (column ch)."""
    return renders.join(wanted.select("ch").distinct(), "ch", "left_semi")


def script_characters(spark: SparkSession, path: str) -> DataFrame:
    """Script sets as rows: family, cp and what is known of the character."""
    rows = read_document(spark, path, schemas.SCRIPT_SETS).select(F.explode("scripts").alias("family", "s"))
    return rows.select("family", F.inline("s.characters"))
