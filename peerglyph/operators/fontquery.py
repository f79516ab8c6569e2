"""Look-ups by font: best comparison of each pair, comparison of two fonts, list of fonts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import font_matches
from .summaries import best_comparison

DIFFERENT = 0.01


def query_font(sources: dict[str, DataFrame], font: str, least: float, cross: DataFrame | None = None, keys: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """For each pair its best comparison in a font, if that reaches ``least``.

    ``sources`` has comparisons by origin; ``cross`` has pairs that are known by one comparison only. The
    threshold is held against the best comparison, not against all.
    """
    out = None
    for origin, rows in sources.items():
        mine = rows.where(font_matches(F.col("source_font"), font) | font_matches(F.col("target_font"), font))
        best = best_comparison(mine, keys).where(F.col("ssim") >= least).select(*keys, "ssim", "phash", "status", "source_font", "target_font", F.lit(origin).alias("origin"))
        out = best if out is None else out.unionByName(best)
    if cross is not None:
        hit = cross.where((font_matches(F.col("source_font"), font) | font_matches(F.col("target_font"), font)) & (F.col("ssim") >= least))
        out = out.unionByName(hit.select(*keys, "ssim", "phash", F.lit("native").alias("status"), "source_font", "target_font", F.lit("cross-script").alias("origin")))
    return out


def compare_fonts(a: DataFrame, b: DataFrame, font_a: str, font_b: str, keys: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """Two query results side by side, with the difference and a note; a pair may lack a side."""
    last = lambda rows, name: rows.groupBy(*keys).agg(F.min("ssim").alias(name))  # noqa: E731  of a pair with several origins the lower one counts
    met = last(a, "ssim_a").join(last(b, "ssim_b"), list(keys), "full")
    delta = F.col("ssim_a") - F.col("ssim_b")
    note = F.when(F.col("ssim_b").isNull(), f"{font_a} only").when(F.col("ssim_a").isNull(), f"{font_b} only").when(delta > DIFFERENT, f"more confusable in {font_a}").when(delta < -DIFFERENT, f"more confusable in {font_b}").otherwise("")
    return met.withColumn("delta", delta).withColumn("abs_delta", F.coalesce(F.abs(delta), F.col("ssim_a"), F.col("ssim_b"))).withColumn("note", note).orderBy(F.col("abs_delta").desc(), *keys)


def list_fonts(comparisons: DataFrame) -> DataFrame:
    """All fonts that are in use on either side."""
    return comparisons.select(F.col("source_font").alias("font")).union(comparisons.select("target_font")).distinct()
