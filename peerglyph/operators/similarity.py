"""Filtered similarity joins of renders.

A render row has ch, font, phash (64 bits), ord (its place in the index, unique) and what the gates need.
Pixels stay out of the joins: gates run on numbers alone, and ``with_ssim`` (or a join back by ord) brings
pixels in for the rows that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashes
from ..functions.numbers import ratio_within
from . import blocks

M1B_HASH, HASH, SEQUENCE_HASH = 0.2, 0.3, 0.5
WIDTH_RATIO, INK_SHARE = 1.5, 0.03
HAN_BITS = 44


def side(renders: DataFrame, prefix: str) -> DataFrame:
    """Columns with a prefix, for one side of a join."""
    return renders.select(*(F.col(c).alias(f"{prefix}_{c}") for c in renders.columns))


def hash_similarity() -> Column:
    return hashes.similarity(F.col("s_phash"), F.col("t_phash"))


def product(rows: DataFrame, asked: DataFrame, most: int = 200_000) -> DataFrame:
    """Every row with every row of the set that is asked about, which is counted first.

    Up to ``most`` of them (rows of a few numbers or names) are sent to all tasks. More are dealt to blocks of
    that size, ``rows`` are repeated for each block, and the two are joined by block, so that no task ever
    holds more than ``most`` and no nested loop over whole tables is planned.
    """
    blocks = max(1, -(-asked.count() // most))
    if blocks == 1:
        return rows.crossJoin(F.broadcast(asked))
    block = F.pmod(F.xxhash64(*asked.columns), F.lit(blocks)).cast("int")
    repeated = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return repeated.join(asked.withColumn("_block", block), "_block").drop("_block")


def all_pairs(sources: DataFrame, targets: DataFrame, most: int = 200_000) -> DataFrame:
    """Every source (columns s_...) with every target (t_...), the targets being the set that is asked about."""
    return product(side(sources, "s"), side(targets, "t"), most)


def same_font(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Every source with every target in the same font, with ``phash``, their similarity.

    An equality join on the font; a font that many characters have is a skewed key, which adaptive
    execution splits.
    """
    return side(sources, "s").join(side(targets, "t"), F.col("s_font") == F.col("t_font")).withColumn("phash", hash_similarity())


def pair_same_font(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """J02 for given pairs (source, target): their renders in the same font."""
    s, t = side(sources, "s"), side(targets, "t")
    return pairs.join(s, pairs.source == F.col("s_ch")).join(t, (pairs.target == F.col("t_ch")) & (F.col("s_font") == F.col("t_font"))).withColumn("phash", hash_similarity())


def pair_cross_font(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """For given pairs, each source render with all renders of the pair's target."""
    s, t = side(sources, "s"), side(targets, "t")
    return pairs.join(s, pairs.source == F.col("s_ch")).join(t, pairs.target == F.col("t_ch")).withColumn("phash", hash_similarity())


def best_target_font(sources: DataFrame, targets: DataFrame, least: float = HASH) -> DataFrame:
    """For each source render and target character, the target font of the most similar hash.

    The first in target order wins ties, similarity zero never wins, and the gate comes after the choice.
    Two passes: the winner of each group is found by a partial aggregate over numbers, so only one row a
    group and task is shuffled, and never a sort of all candidates.
    """
    s, t = sources.select("ch", "font", "ord", "phash"), targets.select("ch", "font", "ord", "phash")
    met = all_pairs(s, t).withColumn("phash", hash_similarity()).where("phash > 0")
    winner = F.max_by(F.struct("t_font", "t_ord"), F.struct(F.col("phash"), (-F.col("t_ord")).alias("o")))
    best = met.groupBy("s_ch", "s_font", "s_ord", "t_ch").agg(winner.alias("w"), F.max("phash").alias("phash"))
    return best.where(F.col("phash") >= least).select("s_ch", "s_font", "s_ord", "t_ch", F.col("w.t_font").alias("t_font"), F.col("w.t_ord").alias("t_ord"), "phash")


def best_in_script(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each render of side A, the most similar render of side B in another font, one for the whole script.

    Renders meet in cells, of which each sends one row for a render of side A; no candidates are sorted.
    """
    return blocks.best(a, b).select("s_ch", "s_font", "s_ord", "t_ch", "t_font", "t_ord", "phash")


def with_near_render(b: DataFrame, a: DataFrame, bits: int = HAN_BITS, most: float = WIDTH_RATIO, most_rows: int = 200_000) -> DataFrame:
    """Characters of side B of which some render is near some render of side A (in hash and width).

    Both widths come from the same column. A radius of 44 of 64 bits leaves nothing to block on; distinct
    (hash, width) pairs of side A, whose number does not grow with copies, are met instead of its rows. Up to
    ``most_rows`` of them are sent to all tasks, which stop at the first that is near; more are met in blocks.
    """
    near = a.select("phash", "ink_w").distinct()
    if near.count() > most_rows:
        met = all_pairs(b.select("ch", "phash", "ink_w"), near, most_rows)
        return met.where((hashes.hamming(F.col("s_phash"), F.col("t_phash")) <= bits) & ratio_within(F.col("s_ink_w"), F.col("t_ink_w"), most)).select(F.col("s_ch").alias("ch")).distinct()
    near = F.broadcast(side(near, "a"))
    test = (hashes.hamming(F.col("phash"), F.col("a_phash")) <= bits) & ratio_within(F.col("ink_w"), F.col("a_ink_w"), most)
    return b.join(near, test, "left_semi").select("ch").distinct()


def gate_hash(met: DataFrame, least: float) -> DataFrame:
    """Before anything that reads pixels."""
    return met.where(F.col("phash") >= least)


def gate_width(met: DataFrame, most: float = WIDTH_RATIO) -> DataFrame:
    """On ink widths; an unknown width passes."""
    return met.where(ratio_within(F.col("s_ink_w"), F.col("t_ink_w"), most))


def skip_causes(met: DataFrame, least: float, most: float | None = None) -> DataFrame:
    """Each comparison's mode and the cause why it isn't computed, if any, in gate order."""
    cause = F.when(F.col("phash") < least, "phash")
    if most is not None:
        cause = cause.when(~ratio_within(F.col("s_ink_w"), F.col("t_ink_w"), most), "width")
    return met.withColumn("mode", F.when(F.col("s_font") == F.col("t_font"), "same").otherwise("cross")).withColumn("cause", cause)


def with_global_ssim(met: DataFrame, pixels: DataFrame) -> DataFrame:
    """P20 over one window, for rows that passed the gates; ``pixels`` has ord, px, mean and var."""
    a, b = side(pixels.select("ord", "px", "mean", "var"), "pa"), side(pixels.select("ord", "px", "mean", "var"), "pb")
    joined = met.join(a, F.col("s_ord") == F.col("pa_ord")).join(b, F.col("t_ord") == F.col("pb_ord"))
    ssim = hashes.global_ssim(F.col("pa_mean"), F.col("pa_var"), F.col("pb_mean"), F.col("pb_var"), hashes.dot(F.col("pa_px"), F.col("pb_px")))
    return joined.withColumn("ssim", ssim).drop(*(f"{p}_{c}" for p in ("pa", "pb") for c in ("ord", "px", "mean", "var")))


def with_own_ssim(met: DataFrame, least: float) -> DataFrame:
    """P20 for rows that carry the pixels of both renders, where they reach the hash gate; pixels are dropped."""
    ssim = hashes.global_ssim(F.col("s_mean"), F.col("s_var"), F.col("t_mean"), F.col("t_var"), hashes.dot(F.col("s_px"), F.col("t_px")))
    return met.withColumn("ssim", F.when(F.col("phash") >= least, ssim)).drop("s_px", "t_px")


def comparisons(met: DataFrame) -> DataFrame:
    """The comparison fact: source, target, source_font, target_font, ssim, phash, status, fallback_font, ssim_skipped."""
    have = met.columns
    return met.select(
        F.col("s_ch").alias("source"), F.col("t_ch").alias("target"), F.col("s_font").alias("source_font"), F.col("t_font").alias("target_font"), F.col("ssim") if "ssim" in have else F.lit(None).cast("double").alias("ssim"), "phash",
        F.col("s_status").alias("status") if "s_status" in have else F.lit("native").alias("status"), F.col("s_fallback_font").alias("fallback_font") if "s_fallback_font" in have else F.lit(None).cast("string").alias("fallback_font"),
        F.col("ssim_skipped") if "ssim_skipped" in have else F.lit(False).alias("ssim_skipped"),
    )


def script_pairs(scripts: DataFrame, late: str = "Han") -> DataFrame:
    """Unordered pairs of scripts (ord, script); ``late`` always stands on side B."""
    a, b = side(scripts, "a"), side(scripts, "b")
    met = a.join(b, F.col("a_ord") < F.col("b_ord"))
    swap = F.col("a_script") == late
    return met.select(F.when(swap, F.col("b_script")).otherwise(F.col("a_script")).alias("script_a"), F.when(swap, F.col("a_script")).otherwise(F.col("b_script")).alias("script_b"), "a_ord", "b_ord")


def order_script_pairs(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """Pairs of a priority list (rank, script_a, script_b, either way round) first, the others in order."""
    key = lambda: (F.least("script_a", "script_b").alias("x"), F.greatest("script_a", "script_b").alias("y"))
    ranked = pairs.select("*", *key()).join(first.select("rank", *key()), ["x", "y"], "left")
    return ranked.orderBy(F.col("rank").asc_nulls_last(), "a_ord", "b_ord").select("script_a", "script_b", "rank")
