"""Summaries of comparisons: pair scores, bands, verdicts, extraction, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges
from ..functions.codepoints import from_u_plus
from ..functions.numbers import HIGH, IDENTICAL, MEDIUM, band

TIE = 0.05


def pair_summary(comparisons: DataFrame, keys: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """Means without nulls, distinct source fonts by status, and the number of comparisons.

    A font's status is the same in all its rows of a pair, so its first status is any of them.
    """
    return comparisons.groupBy(*keys).agg(
        F.avg("ssim").alias("mean_ssim"), F.avg("phash").alias("mean_phash"), F.count_distinct(F.when(F.col("status") == "native", F.col("source_font"))).alias("native_fonts"),
        F.count_distinct(F.when(F.col("status") == "fallback", F.col("source_font"))).alias("fallback_fonts"), F.lit(0).cast("long").alias("notdef_fonts"), F.count("*").alias("valid_fonts"),
    )


def pair_sums(comparisons: DataFrame, keys: tuple[str, ...] = ("source", "target"), least: float = IDENTICAL) -> DataFrame:
    """A01 in parts, which can be added up: comparisons, those with SSIM, their sum, and how many reach ``least``."""
    return comparisons.groupBy(*keys).agg(F.count("*").alias("n"), F.count("ssim").alias("scored"), F.coalesce(F.sum("ssim"), F.lit(0.0)).alias("ssim_sum"), F.count_if(F.col("ssim") >= least).alias("identical"))


def means_of_sums(sums: DataFrame, keys: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """Means of pairs whose comparisons were added up in parts: mean_ssim, identical, valid_fonts."""
    total = sums.groupBy(*keys).agg(F.sum("scored").alias("scored"), F.sum("ssim_sum").alias("ssim_sum"), F.sum("identical").alias("identical"), F.sum("n").alias("valid_fonts"))
    return total.select(*keys, F.when(F.col("scored") > 0, F.col("ssim_sum") / F.col("scored")).alias("mean_ssim"), "identical", "valid_fonts")


def keep_pairs(pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """Every pair; one without a comparison has null means and zero counts."""
    counts = ["native_fonts", "fallback_fonts", "notdef_fonts", "valid_fonts"]
    return pairs.join(summary, ["source", "target"], "left").fillna(0, counts)


def mark_skipped(met: DataFrame, least: float) -> DataFrame:
    """M1b keeps a comparison below the hash gate, without SSIM and marked as skipped."""
    skipped = F.col("phash") < least
    return met.withColumn("ssim_skipped", skipped).withColumn("ssim", F.when(~skipped, F.col("ssim")))


def band_counts(scores: DataFrame, high: float = HIGH, medium: float = MEDIUM, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs in each band."""
    b = band(F.col("mean_ssim"), high, medium)
    return scores.groupBy(*by).agg(*(F.count_if(b == name).alias(name) for name in ("high", "medium", "low", "noData")), F.count("*").alias("total"))


def band_counts_with_identical(scores: DataFrame, high: float = HIGH, medium: float = MEDIUM, by: tuple[str, ...] = ()) -> DataFrame:
    """As ``band_counts``, but a pair with an identical comparison (column identical) is high."""
    b = F.when(F.col("identical"), "high").otherwise(band(F.col("mean_ssim"), high, medium))
    return scores.groupBy(*by).agg(*(F.count_if(b == name).alias(name) for name in ("high", "medium", "low", "noData")), F.count("*").alias("total"))


def discoveries(comparisons: DataFrame, high: float = HIGH, identical: bool = False) -> DataFrame:
    """Pairs whose mean reaches ``high``; with ``identical``, also those with an SSIM of exactly one."""
    scored = comparisons.groupBy("source", "target").agg(F.avg("ssim").alias("mean_ssim"), F.avg("phash").alias("mean_phash"), F.coalesce(F.bool_or(F.col("ssim") == 1.0), F.lit(False)).alias("identical"), F.count("*").alias("valid_fonts"))
    test = F.coalesce(F.col("mean_ssim") >= high, F.lit(False))
    return scored.where((test | F.col("identical")) if identical else test).orderBy(F.col("mean_ssim").desc_nulls_last(), "source", "target")


def pixel_identical(comparisons: DataFrame, least: float = IDENTICAL) -> DataFrame:
    """Pairs with a comparison of at least ``least``, and how many."""
    return comparisons.where(F.col("ssim") >= least).groupBy("source", "target").agg(F.count("*").alias("n"))


def negative(scores: DataFrame) -> DataFrame:
    """Pairs with a negative mean, the least first."""
    return scores.where("mean_ssim < 0").orderBy("mean_ssim", "source", "target")


def vector_verdicts(results: DataFrame, keys: tuple[str, ...] = ("char",), tie: float = TIE) -> DataFrame:
    """For each vector, mean similarity to either reading and which is nearer.

    ``results`` has a row for each font: status, tr39_ssim, tr39_phash, nfkc_ssim, nfkc_phash.
    """
    counted = results.where("status <> 'notdef'").groupBy(*keys).agg(*(F.avg(c).alias(f"mean_{c}") for c in ("tr39_ssim", "nfkc_ssim", "tr39_phash", "nfkc_phash")), F.count("*").alias("valid_fonts"))
    gap = F.col("mean_tr39_ssim") - F.col("mean_nfkc_ssim")
    verdict = F.when(gap.isNull(), "insufficient").when(F.abs(gap) < tie, "equal").when(gap > 0, "tr39").otherwise("nfkc")
    return counted.withColumn("verdict", verdict)


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """One row, a column for each verdict."""
    return verdicts.agg(F.count("*").alias("total"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("tr39", "nfkc", "equal", "insufficient")))


def fallback_font(renders: DataFrame, references: DataFrame) -> DataFrame:
    """The first reference font (by ord) whose pixels are the same as a render's, null if none.

    Both have ch and pixels; the digests are joined, not the pixels.
    """
    digest = F.sha2("pixels", 256)
    known = references.select("ch", digest.alias("digest"), F.col("font").alias("r_font"), "ord").groupBy("ch", "digest").agg(F.min_by("r_font", "ord").alias("fallback_font"))
    return renders.withColumn("digest", digest).join(known, ["ch", "digest"], "left").drop("digest")


def top(scores: DataFrame, n: int, by: str = "mean_ssim", highest: bool = True, ties: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """The first n; Spark keeps n rows a task and never sorts all."""
    order = F.col(by).desc_nulls_last() if highest else F.col(by).asc_nulls_last()
    return scores.where(F.col(by).isNotNull()).orderBy(order, *ties).limit(n)


def top_details(comparisons: DataFrame, same: int = 8, cross: int = 6) -> DataFrame:
    """Of each pair, the best comparisons of either mode, with their rank; rows are cut to k before the shuffle."""
    marked = comparisons.where("ssim is not null").withColumn("mode", F.when(F.col("source_font") == F.col("target_font"), "same").otherwise("cross"))
    place = F.row_number().over(Window.partitionBy("source", "target", "mode").orderBy(F.col("ssim").desc(), "source_font", "target_font"))
    ranked = marked.withColumn("rank", place).where(F.col("rank") <= max(same, cross))
    return ranked.where(F.col("rank") <= F.when(F.col("mode") == "same", same).otherwise(cross))


def median_and_mean(scores: DataFrame) -> DataFrame:
    """Median and mean of pair means, and how many there are."""
    return scores.agg(F.median("mean_ssim").alias("median"), F.avg("mean_ssim").alias("mean"), F.count("mean_ssim").alias("n"))


def font_coverage(comparisons: DataFrame, high: float = HIGH) -> DataFrame:
    """Same-font comparisons of each font, how many are high, and their share."""
    rows = comparisons.where("source_font = target_font and ssim is not null")
    return rows.groupBy(F.col("source_font").alias("font")).agg(F.count("*").alias("total"), F.count_if(F.col("ssim") >= high).alias("high"), (F.count_if(F.col("ssim") >= high) / F.count("*")).alias("share"))


def same_or_cross(comparisons: DataFrame) -> DataFrame:
    """Comparisons of either mode, those with data, and their mean."""
    mode = F.when(F.col("source_font") == F.col("target_font"), "same").otherwise("cross").alias("mode")
    return comparisons.groupBy(mode).agg(F.count("*").alias("total"), F.count("ssim").alias("with_data"), F.avg("ssim").alias("mean"))


def by_group(scores: DataFrame, group: Column) -> DataFrame:
    """Pairs of each group, those with data, and the mean of their means."""
    return scores.groupBy(group.alias("group")).agg(F.count("*").alias("pairs"), F.count("mean_ssim").alias("with_data"), F.avg("mean_ssim").alias("mean"))


def by_report_group(scores: DataFrame, u_plus: str = "source_cp") -> DataFrame:
    return by_group(scores, ranges.report_group(from_u_plus(F.col(u_plus))))


def best_comparison(comparisons: DataFrame, keys: tuple[str, ...] = ("source", "target"), order: str = "ord") -> DataFrame:
    """The comparison of greatest SSIM of each pair; the first in order wins ties."""
    rows = comparisons.where("ssim is not null")
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col("ssim"), (-F.col(order)).alias("o")))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def script_pair_summary(scores: DataFrame, high: float = HIGH, medium: float = MEDIUM, keep: int = 5) -> DataFrame:
    """Bands of each script pair and its best pairs.

    Best pairs are cut to ``keep`` by rank before they are gathered, so no array grows with the data.
    """
    by = ["script_a", "script_b"]
    counts = band_counts(scores, high, medium, tuple(by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("mean_ssim").desc(), "source", "target"))
    best = scores.where("mean_ssim is not null").withColumn("rank", place).where(F.col("rank") <= keep)
    lists = best.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source", "target", "mean_ssim"))), lambda x: F.concat(x["source"].cast("string"), F.lit(">"), x["target"].cast("string"))).alias("best"))
    return counts.join(lists, by, "left")


def range_breakdown(scores: DataFrame, candidates: DataFrame, high: float = HIGH, medium: float = MEDIUM) -> DataFrame:
    """Pairs and bands of each range, and its number of candidates, zero if unknown."""
    b = band(F.col("mean_ssim"), high, medium)
    scored = scores.groupBy("range").agg(F.count("*").alias("scored"), *(F.count_if(b == name).alias(name) for name in ("high", "medium", "low")))
    counts = candidates.groupBy("range").agg(F.count("*").alias("candidates"))
    return scored.join(counts, "range", "left").fillna(0, ["candidates"])


def verified(bands: DataFrame) -> DataFrame:
    """Whether no pair is high."""
    return bands.agg((F.sum("high") == 0).alias("verification_passed"), F.sum("high").alias("high"), F.sum("total").alias("total"))
