"""Candidate building: exclusions, coverage, script sets, sequences, coverage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranges
from ..functions.codepoints import is_basic_latin, to_u_plus
from .similarity import product

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def filter_reasons(points: DataFrame, existing: DataFrame, coverage: DataFrame, inverted: bool = False) -> DataFrame:
    """Every code point with the first reason why it is no candidate, null if it is one.

    ``points`` has cp, name, gc; ``existing`` has cp of known sources; ``coverage`` has cp and family.
    ``inverted`` asks for the excluded ranges instead of leaving them out.
    """
    known = existing.select("cp").distinct().withColumn("_known", F.lit(True))
    covered = coverage.groupBy("cp").agg(F.count_distinct("family").alias("font_coverage"))
    rows = points.join(known, "cp", "left").join(covered, "cp", "left").fillna(0, ["font_coverage"]).withColumn("range", ranges.excluded_range(F.col("cp")))
    latin, seen, bare = is_basic_latin(F.col("cp")), F.col("_known").isNotNull(), F.col("font_coverage") == 0
    if inverted:
        reason = F.when(F.col("range").isNull(), "not excluded").when(latin, "latin target").when(seen, "existing source")
    else:
        reason = F.when(latin, "latin target").when(seen, "existing source").when(F.col("range").isNotNull(), "excluded range").when(bare, "no font")
    return rows.withColumn("reason", reason).drop("_known")


def candidates(reasons: DataFrame) -> DataFrame:
    """The candidates, by code point."""
    name = F.col("name") if "name" in reasons.columns else F.lit(None).cast("string")
    return reasons.where("reason is null").select(to_u_plus(F.col("cp")).alias("codepoint"), "cp", name.alias("name"), "gc", ranges.block_script(F.col("cp"), name).alias("script"), "range", "font_coverage").orderBy("cp")


def count_by(rows: DataFrame, key: str) -> DataFrame:
    """A18."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def script_set(points: DataFrame, scripts: DataFrame, coverage: DataFrame, families: DataFrame) -> DataFrame:
    """Characters of each family: in its ranges, of its Unicode scripts, letters or numbers, in some font.

    ``points`` has cp, name, gc; ``scripts`` has lo, hi, script; ``families`` as from ``ranges.families``.
    """
    letters = points.where(F.substring("gc", 1, 1).isin("L", "N"))  # W01
    named = ranges.range_join(letters, scripts.withColumnRenamed("script", "cp_script"))
    inside = ranges.range_join(named, families).where("script = cp_script")
    covered = coverage.groupBy("cp").agg(F.count_distinct("family").alias("font_coverage"))
    return inside.join(covered, "cp").select("ord", "family", "cp", "name", "gc", "font_coverage")


def sequences(spark) -> DataFrame:
    """All two-character sequences of the alphabet."""
    letters = spark.range(len(ALPHABET)).select(F.substring(F.lit(ALPHABET), F.col("id").cast("int") + 1, F.lit(1)).alias("c"))
    a, b = letters.select(F.col("c").alias("a")), letters.select(F.col("c").alias("b"))
    return a.crossJoin(b).select(F.concat("a", "b").alias("sequence"), F.array("a", "b").alias("chars"), F.lit(2).alias("length"))


def source_targets(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Every source with every target; the targets, mostly the fixed alphabet, are counted first."""
    return product(sources, targets)


def render_jobs(chars: DataFrame, coverage: DataFrame, fonts: DataFrame, fallback: DataFrame) -> DataFrame:
    """The fonts to render each character in: those that cover it, else the fallback fonts.

    ``chars`` has cp; ``coverage`` cp, family; ``fonts`` and ``fallback`` family.
    """
    covering = coverage.join(fonts.select("family"), "family").select("cp", "family").distinct()
    direct = chars.select("cp").join(covering, "cp").withColumn("fallback", F.lit(False))
    rest = chars.select("cp").join(covering.select("cp").distinct(), "cp", "left_anti")
    rest = product(rest, fallback.select("family")).withColumn("fallback", F.lit(True))
    return direct.unionByName(rest)


def coverage_statistics(chars: DataFrame, coverage: DataFrame, n_fonts: int) -> DataFrame:
    """Mean fonts a character, characters without one, and render jobs against all combinations."""
    n = chars.select("cp").join(coverage.groupBy("cp").agg(F.count_distinct("family").alias("n")), "cp", "left").fillna(0, ["n"])
    return n.agg(F.avg("n").alias("mean_fonts"), F.count_if(F.col("n") == 0).alias("uncovered"), F.sum("n").alias("jobs"), (F.count("*") * n_fonts).alias("brute_force"))


def category_counts(fonts: DataFrame) -> DataFrame:
    """A24."""
    return fonts.groupBy("category").agg(F.count("*").alias("n"))


def usable_fonts(fonts: DataFrame, categories: tuple[str, ...] = ("standard",)) -> DataFrame:
    """Available fonts of the categories."""
    return fonts.where(F.coalesce(F.col("available"), F.lit(True)) & F.col("category").isin(*categories))
