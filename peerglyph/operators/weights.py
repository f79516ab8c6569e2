"""Edge weights, per-font risk, glyph reuse, identifier properties, size ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import HIGH, IDENTICAL, clamp, percentile_or_zero, ratio, round_half_up

PROPERTIES = ("xid_start", "xid_continue", "idna_pvalid", "tr39_allowed")
#: Edges of the size ratio histogram, half open.
RATIO_EDGES = ((1.0, 1.25), (1.25, 1.5), (1.5, 2.0), (2.0, 3.0), (3.0, None))
SIZE_RATIO = 2.0


def edge_weights(comparisons: DataFrame, keys: tuple[str, ...] = ("source", "target"), extra: dict[str, Column] | None = None) -> DataFrame:
    """Same-font and cross-font maxima, 95th percentiles and means, danger, stable danger and cost.

    One aggregate; zero where there is nothing; all is rounded last.
    """
    x = F.col("ssim")
    same, cross = F.when(F.col("source_font") == F.col("target_font"), x), F.when(F.col("source_font") != F.col("target_font"), x)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    raw = comparisons.groupBy(*keys).agg(
        *(f.alias(n) for side, v in (("same", same), ("cross", cross)) for n, f in ((f"{side}_max", zero(F.max(v))), (f"{side}_p95", percentile_or_zero(v, 0.95)), (f"{side}_mean", zero(F.avg(v))), (f"{side}_n", F.count(v)))),
        percentile_or_zero(x, 0.95).alias("stable_danger"),
    )
    out = rounded_weights(raw, keys)
    for name, value in (extra or {}).items():
        out = out.withColumn(name, value)
    return out


def rounded_weights(raw: DataFrame, keys: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """The columns of ``edge_weights`` from what comparisons of each pair give."""
    raw = raw.withColumn("danger", F.greatest("same_max", "cross_max")).withColumn("cost", clamp(1 - F.col("stable_danger")))
    return raw.select(*keys, *(round_half_up(F.col(c)).alias(c) if not c.endswith("_n") else F.col(c) for c in ("same_max", "same_p95", "same_mean", "same_n", "cross_max", "cross_p95", "cross_mean", "cross_n", "danger", "stable_danger", "cost")))


def cross_script_edges(pairs: DataFrame) -> DataFrame:
    """Edges of cross-script pairs, known by their best comparison and mean; the cost comes from the rounded mean."""
    out = pairs.select("source", "target", round_half_up(F.col("best_ssim")).alias("danger"), round_half_up(F.coalesce("mean_ssim", "best_ssim")).alias("stable_danger"), F.col("valid_fonts").alias("same_n"))
    zero = [F.lit(0.0).alias(c) for c in ("cross_max", "cross_p95", "cross_mean")]
    return out.select("source", "target", F.col("danger").alias("same_max"), F.col("stable_danger").alias("same_p95"), F.col("stable_danger").alias("same_mean"), "same_n", *zero, F.lit(0).cast("long").alias("cross_n"), "danger", "stable_danger", round_half_up(clamp(1 - F.col("stable_danger"))).alias("cost"))


def new_cross_script(cross: DataFrame, existing: DataFrame, order: str = "ord") -> DataFrame:
    """Cross-script pairs that no edge has in either direction; of repeated ones the first in order."""
    pair = lambda: (F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y"))
    known = existing.select(*pair()).distinct()
    fresh = cross.select("*", *pair()).join(known, ["x", "y"], "left_anti")
    rest = [c for c in cross.columns if c != order]
    return fresh.groupBy("x", "y").agg(F.min_by(F.struct(*rest), order).alias("p"), F.min(order).alias(order)).select("p.*", order)


def with_flags(edges: DataFrame, reuse: DataFrame, properties: DataFrame, keys: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """Glyph reuse and identifier properties of each edge, false if unknown. Each lookup has a key once."""
    out = edges.join(reuse.select(*keys, "glyph_reuse"), list(keys), "left").join(properties.select(*keys, *PROPERTIES), list(keys), "left")
    return out.fillna(False, ["glyph_reuse", *PROPERTIES])


def later_wins(lookups: list[DataFrame], keys: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """One lookup out of several; a key of a later one replaces it in earlier ones."""
    out = None
    for k, lookup in enumerate(lookups):
        part = lookup.withColumn("_k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in lookups[0].columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_k").alias("r")).select(*keys, "r.*")


def all_edges(tr39: DataFrame, novel: DataFrame, cross: DataFrame) -> DataFrame:
    """All edges with their origin, by danger, then by source."""
    tagged = [e.withColumn("origin", F.lit(tag)).withColumn("in_tr39", F.lit(tag == "tr39")) for tag, e in (("tr39", tr39), ("novel", novel), ("cross-script", cross))]
    return tagged[0].unionByName(tagged[1], True).unionByName(tagged[2], True).orderBy(F.col("danger").desc(), "source", "target")


def weight_summary(edges: DataFrame) -> DataFrame:
    """Edges by cost, the range of costs, and flags if there are any."""
    c = F.col("cost")
    flags = [F.count_if(f).alias(f) for f in ("glyph_reuse", "xid_continue", "idna_pvalid") if f in edges.columns]
    return edges.agg(F.count("*").alias("edges"), F.count_if(c == 0).alias("zero"), F.count_if((c > 0) & (c < 0.1)).alias("low"), F.count_if((c >= 0.1) & (c < 0.3)).alias("moderate"), F.count_if(c >= 0.3).alias("higher"), F.min(c).alias("least_cost"), F.max(c).alias("most_cost"), *flags)


def font_edges(comparisons: DataFrame, keys: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """Of each target font and pair the best comparison, rounded."""
    rows = comparisons.where("ssim is not null and status <> 'notdef'")
    best = rows.groupBy("target_font", *keys).agg(F.max("ssim").alias("raw"), F.max_by("source_font", F.struct("ssim", "source_font")).alias("source_font"))
    return best.select("target_font", *keys, round_half_up(F.col("raw")).alias("ssim"), "source_font")


def font_summary(edges: DataFrame, high: float = HIGH) -> DataFrame:
    """Pairs of each font, those at high risk, and the danger rate."""
    return edges.groupBy(F.col("target_font").alias("font")).agg(F.count("*").alias("total_pairs"), F.count_if(F.col("ssim") >= high).alias("high_risk"), round_half_up(F.count_if(F.col("ssim") >= high) / F.count("*")).alias("danger_rate"))


def median_font(summary: DataFrame) -> DataFrame:
    """The font in the middle by falling danger rate (not a median of its pair count).

    One row a font: a small table, ordered in one place.
    """
    place = F.row_number().over(Window.orderBy(F.col("danger_rate").desc(), "font"))
    middle = F.floor(F.count("*").over(Window.partitionBy()) / 2) + 1
    return summary.select("*", place.alias("place"), middle.alias("middle")).where("place = middle").select("font", "total_pairs", "danger_rate")


def glyph_reuse(comparisons: DataFrame, glyphs: DataFrame, least: float = IDENTICAL) -> DataFrame:
    """For pairs that are identical in a font, whether the font has one glyph for both.

    ``comparisons`` has source_cp and target_cp (numbers) and fonts; ``glyphs`` has family, cp, glyph. A
    missing glyph counts as a coincidence of pixels.
    """
    same = comparisons.where((F.col("source_font") == F.col("target_font")) & (F.col("ssim") >= least)).select("source_cp", "target_cp", F.col("source_font").alias("family"))
    s = glyphs.select("family", F.col("cp").alias("source_cp"), F.col("glyph").alias("source_glyph"))
    t = glyphs.select("family", F.col("cp").alias("target_cp"), F.col("glyph").alias("target_glyph"))
    checked = same.join(s, ["family", "source_cp"], "left").join(t, ["family", "target_cp"], "left").withColumn("reuse", F.coalesce(F.col("source_glyph") == F.col("target_glyph"), F.lit(False)))
    return checked.groupBy("source_cp", "target_cp").agg(F.count("*").alias("checked"), F.count_if("reuse").alias("reused"), F.count_if(~F.col("reuse")).alias("coincidences"), F.bool_or("reuse").alias("glyph_reuse"))


def annotate(points: DataFrame, property_ranges: dict[str, DataFrame]) -> DataFrame:
    """Points (column cp) with a flag for each property's ranges (lo, hi)."""
    from ..functions.ranges import range_join

    for name, found in property_ranges.items():
        have = range_join(points.select("cp").distinct(), found.select("lo", "hi")).select("cp").distinct().withColumn(name, F.lit(True))
        points = points.join(have, "cp", "left").fillna(False, [name])
    return points


def property_counts(annotated: DataFrame, names: tuple[str, ...] = PROPERTIES) -> DataFrame:
    """Points with each property and with all of them."""
    both = F.lit(True)
    for n in names:
        both = both & F.col(n)
    return annotated.agg(F.count("*").alias("total"), *(F.count_if(n).alias(n) for n in names), F.count_if(both).alias("every"))


def size_ratios(best: DataFrame, ink: DataFrame, most: float = SIZE_RATIO) -> DataFrame:
    """Width and height ratios of each pair's best comparison; both renders must have ink.

    ``ink`` has ch, font, ink_w, ink_h. Ratios are rounded to two places, flags come from the exact ones.
    """
    s = ink.select(F.col("ch").alias("source"), F.col("font").alias("source_font"), F.col("ink_w").alias("sw"), F.col("ink_h").alias("sh"))
    t = ink.select(F.col("ch").alias("target"), F.col("font").alias("target_font"), F.col("ink_w").alias("tw"), F.col("ink_h").alias("th"))
    met = best.join(s, ["source", "source_font"]).join(t, ["target", "target_font"])
    w, h = ratio(F.col("sw"), F.col("tw")), ratio(F.col("sh"), F.col("th"))
    return met.where(w.isNotNull() & h.isNotNull()).select(*best.columns, "sw", "sh", "tw", "th", round_half_up(w, 2).alias("width_ratio"), round_half_up(h, 2).alias("height_ratio"), ((w > most) | (h > most)).alias("flagged"))


def ratio_histogram(ratios: DataFrame) -> DataFrame:
    """Pairs in each half-open bucket of either ratio; an empty bucket is zero.

    One pass: a count for each bucket, turned into rows.
    """
    names = [(low, high, f"[{low}, {high})" if high else f">= {low}") for low, high in RATIO_EDGES]
    inside = lambda c, low, high: (F.col(c) >= low) & (F.col(c) < high if high else F.lit(True))
    counts = ratios.agg(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(name).alias("bucket"), F.count_if(inside("width_ratio", low, high)).alias("width"), F.count_if(inside("height_ratio", low, high)).alias("height")) for k, (low, high, name) in enumerate(names))).alias("rows"))
    return counts.select(F.inline("rows"))
