"""Scoring jobs over renders, and their queries on the vectors of the driver's tables.

A vector of 64 numbers is an 8 x 8 render: the character is its number modulo 50, the font the rest.
Characters below 20 are targets, the others sources; three of four fonts are standard. Similarities are
low on these data, so the queries state thresholds of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes
from ..functions.codepoints import to_u_plus
from ..functions.numbers import band, round_half_up
from ..operators import blocks
from ..operators import similarity as sim
from ..operators import summaries as summ
from ..operators import weights as wt
from ..sources import scratch
from ..sources.fonts import coverage, glyph_table, installed
from ..sources.outlines import ship
from ..sources.renders import Draw, bitmap, from_vectors
from .catalog import query, table
from .jobs import build_index, extract_scripts
from .jobs import score_scripts as score_script_pair

HASH, HIGH, MEDIUM = 0.5, 0.05, 0.0


def renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_vectors(table(spark, sf_dir, "embeddings"))


def sides(r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without pixels: standard sources, other sources, standard targets."""
    light = r.drop("px", "bits")
    return light.where("not is_target and standard"), light.where("not is_target and not standard"), light.where("is_target and standard")


# Jobs


def same_and_crossed(r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C09's same-font comparisons of standard fonts (with pixels, not yet scored), other sources, standard targets."""
    sources, others, targets = (r.drop("bits").where(w) for w in ("not is_target and standard", "not is_target and not standard", "is_target and standard"))
    return sim.same_font(sources, targets), others, targets


def score_pairs(r: DataFrame, least: float, high: float | None = None) -> DataFrame:
    """All same-font comparisons of standard fonts and all cross-font ones of other sources; those below
    the hash gate are kept without SSIM.

    Same-font renders bring their pixels along, cross-font ones meet in cells: no comparison is shuffled.
    """
    same, others, targets = same_and_crossed(r)
    skipped = lambda met: sim.comparisons(met.withColumn("ssim_skipped", F.col("phash") < least))
    return skipped(sim.with_own_ssim(same, least)).unionByName(skipped(blocks.scored(others, targets, least)))


def pair_sums(r: DataFrame, least: float) -> DataFrame:
    """Sums of C09's comparisons by pair and mode, some rows for each: cells add their own comparisons up."""
    same, others, targets = same_and_crossed(r)
    known = summ.pair_sums(sim.comparisons(sim.with_own_ssim(same, least)))
    return known.withColumn("mode", F.lit("same")).unionByName(blocks.sums(others, targets, least, summ.IDENTICAL).withColumn("mode", F.lit("cross")))


def font_bests(r: DataFrame, least: float) -> DataFrame:
    """Of C09's comparisons all same-font ones and, of each pair, the best of each font on either side: all that the
    look-up of any fonts' best comparisons can find (``blocks.font_bests``)."""
    same, others, targets = same_and_crossed(r)
    skipped = lambda met: sim.comparisons(met.withColumn("ssim_skipped", F.col("phash") < least))
    return skipped(sim.with_own_ssim(same, least)).unionByName(skipped(blocks.font_bests(others, targets, least)))


def score_candidates(r: DataFrame, least: float) -> DataFrame:
    """Same-font comparisons and, for other sources, the best target font; rows below the gate are dropped."""
    sources, others, targets = sides(r)
    same = sim.gate_hash(sim.same_font(sources, targets), least).select("s_ch", "s_font", "s_ord", "t_ch", "t_font", "t_ord", "phash")
    met = same.unionByName(sim.best_target_font(others, targets, least))
    return sim.comparisons(sim.with_global_ssim(met, r))


def score_scripts(r: DataFrame, least: float, size: int = 10) -> DataFrame:
    """All pairs of scripts (tens of characters): same-font comparisons and, of each side A render, the best
    side B render in another font; hash and width gates."""
    r = r.drop("bits").withColumn("script", F.floor(F.col("ch") / size).cast("int"))
    same = sim.side(r, "s").join(sim.side(r, "t"), (F.col("s_font") == F.col("t_font")) & (F.col("s_script") < F.col("t_script"))).withColumn("phash", sim.hash_similarity())
    best = blocks.best(r, r, ("script", "ink_w"), "script")
    gated = lambda met: sim.gate_width(sim.gate_hash(met, least))
    columns = ["s_ch", "s_font", "t_ch", "t_font", "phash", "ssim"]
    return sim.with_own_ssim(gated(same), least).select(columns).unionByName(sim.with_global_ssim(gated(best), r).select(columns))


# The same in SQL

BASE = """
with r0 as (select vec_id as ord, cast(vec_id % 50 as int) as ch, cast(vec_id // 50 as int) as font, [x::double for x in embedding] as px from embeddings),
r1 as (select *, list_sum(px) / 64 as mean from r0),
r2 as (select *, list_dot_product(px, px) / 64 - mean * mean as var, array_to_string(list_transform(px, lambda x: case when x > mean then '1' else '0' end), '') as bits from r1),
r as (select *, font % 4 <> 3 as standard, ch < 20 as is_target,
  list_max([y for y in range(8) if contains(substr(bits, (8 * y + 1)::int, 8), '1')]) - list_min([y for y in range(8) if contains(substr(bits, (8 * y + 1)::int, 8), '1')]) + 1 as ink_h,
  list_max([i % 8 for i in range(64) if substr(bits, (i + 1)::int, 1) = '1']) - list_min([i % 8 for i in range(64) if substr(bits, (i + 1)::int, 1) = '1']) + 1 as ink_w from r2),
cross_all as (select s.ch as source, t.ch as target, s.font as source_font, t.font as target_font, s.ord as s_ord, t.ord as t_ord, 1 - bit_count(xor(s.bits::bit, t.bits::bit)) / 64.0::double as phash,
  s.standard as s_standard, t.standard as t_standard, s.is_target as s_is_target, t.is_target as t_is_target, s.ink_w as s_ink_w, t.ink_w as t_ink_w, list_dot_product(s.px, t.px) / 64 - s.mean * t.mean as cov, s.mean as ma, t.mean as mb, s.var as va, t.var as vb
  from r s, r t),
allp as (select *, ((2 * ma * mb + 0.0001::double) * (2 * cov + 0.0009::double)) / ((ma * ma + mb * mb + 0.0001::double) * (va + vb + 0.0009::double)) as ssim from cross_all),
m1 as (select source, target, source_font, target_font, phash, case when phash >= 0.5 then ssim end as ssim, phash < 0.5 as ssim_skipped, 'native' as status from allp
  where not s_is_target and t_is_target and t_standard and ((s_standard and source_font = target_font) or not s_standard)),
best as (select * from (select *, row_number() over (partition by source, source_font, target order by phash desc, t_ord) as o from allp where not s_is_target and not s_standard and t_is_target and t_standard and phash > 0) where o = 1),
m2 as (select source, target, source_font, target_font, phash, ssim, 'native' as status from allp where not s_is_target and s_standard and t_is_target and t_standard and source_font = target_font and phash >= 0.5
  union all select source, target, source_font, target_font, phash, ssim, 'native' from best where phash >= 0.5)
"""


def _job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_pairs(renders(spark, sf_dir), HASH)


def _job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_candidates(renders(spark, sf_dir), HASH)


def _round(rows: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return rows.withColumns({n: F.round(n, places) for n in names})


# Queries: kernels on 8 x 8 renders


@query(BASE + "select s.ord, s.bits from r s")
def P17_average_hash(spark, sf_dir):
    return renders(spark, sf_dir).select("ord", "bits")


@query(BASE + "select ord, lower(lpad(hex(bits::bit::blob), 16, '0')) as phash_hex from (select ord, bits from r)")
def F25_hash_hex(spark, sf_dir):
    return renders(spark, sf_dir).select("ord", hashes.to_hex(hashes.from_hex(hashes.to_hex(F.col("phash")))).alias("phash_hex"))


@query(BASE + "select ord, cast(ink_w as int) as ink_w, cast(ink_h as int) as ink_h from r")
def P07_ink_size(spark, sf_dir):
    return renders(spark, sf_dir).select("ord", "ink_w", "ink_h")


@query(BASE + "select source, target, source_font as font, phash from allp where source_font = target_font and not s_is_target and t_is_target and s_standard")
def J02_same_font(spark, sf_dir):
    sources, _, targets = sides(renders(spark, sf_dir))
    return sim.same_font(sources, targets).select(F.col("s_ch").alias("source"), F.col("t_ch").alias("target"), F.col("s_font").alias("font"), "phash")


@query(BASE + "select source, target, font, phash from (select source, target, source_font as font, phash, s_is_target a, t_is_target b, s_standard c, target_font from allp) where font = target_font and not a and b and c and phash >= 0.5")
def W06_hash_gate(spark, sf_dir):
    sources, _, targets = sides(renders(spark, sf_dir))
    return sim.gate_hash(sim.same_font(sources, targets), HASH).select(F.col("s_ch").alias("source"), F.col("t_ch").alias("target"), F.col("s_font").alias("font"), "phash")


@query(BASE + "select source, target, source_font as font from allp where source_font = target_font and not s_is_target and t_is_target and s_standard and greatest(s_ink_w, t_ink_w) / least(s_ink_w, t_ink_w)::double <= 1.1")
def W07_width_gate(spark, sf_dir):
    sources, _, targets = sides(renders(spark, sf_dir))
    return sim.gate_width(sim.same_font(sources, targets), 1.1).select(F.col("s_ch").alias("source"), F.col("t_ch").alias("target"), F.col("s_font").alias("font"))


@query(BASE + "select source, target, source_font as font, round(ssim, 6) as ssim from allp where source_font = target_font and not s_is_target and t_is_target and s_standard and phash >= 0.5")
def P20_global_ssim(spark, sf_dir):
    r = renders(spark, sf_dir)
    sources, _, targets = sides(r)
    met = sim.with_global_ssim(sim.gate_hash(sim.same_font(sources, targets), HASH), r)
    return met.select(F.col("s_ch").alias("source"), F.col("t_ch").alias("target"), F.col("s_font").alias("font"), F.round("ssim", 6).alias("ssim"))


@query(BASE + "select source, target, source_font, target_font, phash from allp where not s_is_target and not s_standard and t_is_target and t_standard")
def J03_cross_font(spark, sf_dir):
    _, others, targets = sides(renders(spark, sf_dir))
    pairs = sim.product(others.select(F.col("ch").alias("source")).distinct(), targets.select(F.col("ch").alias("target")).distinct())
    return sim.pair_cross_font(pairs, others, targets).select("source", "target", F.col("s_font").alias("source_font"), F.col("t_font").alias("target_font"), "phash")


@query(BASE + "select source, target, source_font, target_font, phash from best where phash >= 0.3")
def J04_best_target_font(spark, sf_dir):
    _, others, targets = sides(renders(spark, sf_dir))
    return sim.best_target_font(others, targets).select(F.col("s_ch").alias("source"), F.col("t_ch").alias("target"), F.col("s_font").alias("source_font"), F.col("t_font").alias("target_font"), "phash")


@query(BASE + "select source, source_font, target, target_font, phash from (select *, row_number() over (partition by source, source_font order by phash desc, t_ord) as o from allp where not s_is_target and t_is_target and source_font <> target_font) where o = 1")
def J06_best_in_script(spark, sf_dir):
    r = renders(spark, sf_dir)
    best = sim.best_in_script(r.where("not is_target"), r.where("is_target"))
    return best.select(F.col("s_ch").alias("source"), F.col("s_font").alias("source_font"), F.col("t_ch").alias("target"), F.col("t_font").alias("target_font"), "phash")


@query(BASE + "select distinct source as ch from allp where not s_is_target and t_is_target and (1 - phash) * 64 <= 17 and greatest(s_ink_w, t_ink_w) / least(s_ink_w, t_ink_w)::double <= 1.5")
def J07_near_semi_join(spark, sf_dir):
    r = renders(spark, sf_dir)
    return sim.with_near_render(r.where("not is_target"), r.where("is_target"), 17)


@query(
    BASE
    + """, x as (select *, source // 10 as sa, target // 10 as sb from allp where source // 10 < target // 10),
b as (select * exclude (o) from (select *, row_number() over (partition by s_ord, sb order by phash desc, t_ord) as o from x where source_font <> target_font) where o = 1)
select source, target, source_font, target_font, phash, round(ssim, 6) as ssim from (select * from x where source_font = target_font union all select * from b)
where phash >= 0.5 and greatest(s_ink_w, t_ink_w) / least(s_ink_w, t_ink_w)::double <= 1.5"""
)
def C12_score_scripts(spark, sf_dir):
    return score_scripts(renders(spark, sf_dir), HASH).select(F.col("s_ch").alias("source"), F.col("t_ch").alias("target"), F.col("s_font").alias("source_font"), F.col("t_font").alias("target_font"), "phash", F.round("ssim", 6).alias("ssim"))


@query(BASE + "select source, target, source_font, target_font, phash, round(ssim, 6) as ssim, ssim_skipped from m1")
def C09_score_pairs(spark, sf_dir):
    return _round(_job1(spark, sf_dir).select("source", "target", "source_font", "target_font", "phash", "ssim", "ssim_skipped"), "ssim")


@query(BASE + "select source, target, source_font, target_font, phash, round(ssim, 6) as ssim from m2")
def C10_score_candidates(spark, sf_dir):
    return _round(_job2(spark, sf_dir).select("source", "target", "source_font", "target_font", "phash", "ssim"), "ssim")


# Queries: summaries

SUMMARY = "select source, target, round(avg(ssim), 6) as mean_ssim, round(avg(phash), 6) as mean_phash, count(distinct source_font) as native_fonts, cast(0 as bigint) as fallback_fonts, cast(0 as bigint) as notdef_fonts, count(*) as valid_fonts from {0} group by source, target"


@query(BASE + SUMMARY.format("m1"))
def A01_pair_summary(spark, sf_dir):
    return _round(summ.pair_summary(_job1(spark, sf_dir)), "mean_ssim", "mean_phash")


@query(BASE + f", s as ({SUMMARY.format('m2')}), p as (select range::int as source, 3 as target from range(15, 60)) select p.source, p.target, mean_ssim, mean_phash, coalesce(native_fonts, 0) as native_fonts, coalesce(fallback_fonts, 0) as fallback_fonts, coalesce(notdef_fonts, 0) as notdef_fonts, coalesce(valid_fonts, 0) as valid_fonts from p left join s on p.source = s.source and p.target = s.target")
def J01_every_pair(spark, sf_dir):
    pairs = spark.range(15, 60).select(F.col("id").cast("int").alias("source"), F.lit(3).alias("target"))
    return _round(summ.keep_pairs(pairs, summ.pair_summary(_job2(spark, sf_dir))), "mean_ssim", "mean_phash")


BANDS = "select count(*) filter (m >= 0.05) as high, count(*) filter (m >= 0 and m < 0.05) as medium, count(*) filter (m < 0) as low, count(*) filter (m is null) as \"noData\", count(*) as total"


@query(BASE + f"{BANDS} from (select avg(ssim) as m from m1 group by source, target)")
def A02_band_counts(spark, sf_dir):
    return summ.band_counts(summ.pair_summary(_job1(spark, sf_dir)), HIGH, MEDIUM)


@query(BASE + ", p as (select avg(ssim) as m, max(ssim) >= 0.12 as i from m1 group by source, target) select count(*) filter (i or m >= 0.05) as high, count(*) filter (not i and m >= 0 and m < 0.05) as medium, count(*) filter (not i and m < 0) as low, count(*) filter (m is null) as \"noData\", count(*) as total from p")
def A03_bands_with_identical(spark, sf_dir):
    scores = _job1(spark, sf_dir).groupBy("source", "target").agg(F.avg("ssim").alias("mean_ssim"), F.coalesce(F.max("ssim") >= 0.12, F.lit(False)).alias("identical"))
    return summ.band_counts_with_identical(scores, HIGH, MEDIUM)


@query(BASE + "select source, target, round(avg(ssim), 6) as mean_ssim, count(*) as valid_fonts from m1 group by source, target having avg(ssim) >= 0.05")
def W11_discoveries(spark, sf_dir):
    return _round(summ.discoveries(_job1(spark, sf_dir), HIGH), "mean_ssim").select("source", "target", "mean_ssim", "valid_fonts")


@query(BASE + ", c as (select source, target, case when source = 25 and target < 4 and source_font = 0 then 1.0::double else ssim end as ssim from m1) select source, target, round(avg(ssim), 6) as mean_ssim, coalesce(bool_or(ssim = 1), false) as identical, count(*) as valid_fonts from c group by source, target having avg(ssim) >= 0.05 or bool_or(ssim = 1)")
def W10_discoveries_or_identical(spark, sf_dir):
    marked = _job1(spark, sf_dir).withColumn("ssim", F.when((F.col("source") == 25) & (F.col("target") < 4) & (F.col("source_font") == 0), 1.0).otherwise(F.col("ssim")))
    return _round(summ.discoveries(marked, HIGH, identical=True), "mean_ssim").select("source", "target", "mean_ssim", "identical", "valid_fonts")


@query(BASE + "select source, target, count(*) as n from m1 where ssim >= 0.1 group by source, target")
def W12_pixel_identical(spark, sf_dir):
    return summ.pixel_identical(_job1(spark, sf_dir), 0.1)


@query(BASE + "select source, target, round(m, 6) as mean_ssim from (select source, target, avg(ssim) as m from m1 group by source, target) where m < 0")
def W13_negative(spark, sf_dir):
    return _round(summ.negative(summ.pair_summary(_job1(spark, sf_dir))), "mean_ssim").select("source", "target", "mean_ssim")


@query(BASE + "select source, target, round(m, 6) as mean_ssim from (select source, target, avg(ssim) as m from m1 group by source, target) where m is not null order by m desc, source, target limit 20")
def L01_top_pairs(spark, sf_dir):
    return _round(summ.top(summ.pair_summary(_job1(spark, sf_dir)), 20), "mean_ssim").select("source", "target", "mean_ssim")


@query(BASE + "select source, target, round(m, 6) as mean_ssim from (select source, target, avg(ssim) as m from m1 group by source, target) where m is not null order by m, source, target limit 30")
def L01_bottom_pairs(spark, sf_dir):
    return _round(summ.top(summ.pair_summary(_job1(spark, sf_dir)), 30, highest=False), "mean_ssim").select("source", "target", "mean_ssim")


@query(BASE + "select source, target, mode, rank, source_font, target_font from (select *, case when source_font = target_font then 'same' else 'cross' end as mode, cast(row_number() over (partition by source, target, source_font = target_font order by ssim desc, source_font, target_font) as int) as rank from m1 where ssim is not null) where rank <= case mode when 'same' then 3 else 2 end")
def L02_top_details(spark, sf_dir):
    return summ.top_details(_job1(spark, sf_dir), 3, 2).select("source", "target", "mode", "rank", "source_font", "target_font")


@query(BASE + "select round(median(m), 6) as median, round(avg(m), 6) as mean, count(m) as n from (select avg(ssim) as m from m1 group by source, target)")
def A12_median_and_mean(spark, sf_dir):
    return _round(summ.median_and_mean(summ.pair_summary(_job1(spark, sf_dir))), "median", "mean")


@query(BASE + "select source_font as font, count(*) as total, count(*) filter (ssim >= 0.05) as high, round(count(*) filter (ssim >= 0.05) / count(*)::double, 6) as share from m1 where source_font = target_font and ssim is not null group by source_font")
def A13_font_coverage(spark, sf_dir):
    return _round(summ.font_coverage(_job1(spark, sf_dir), HIGH), "share")


@query(BASE + "select case when source_font = target_font then 'same' else 'cross' end as mode, count(*) as total, count(ssim) as with_data, round(avg(ssim), 6) as mean from m1 group by 1")
def A14_same_or_cross(spark, sf_dir):
    return _round(summ.same_or_cross(_job1(spark, sf_dir)), "mean")


@query(BASE + "select g as \"group\", count(*) as pairs, count(m) as with_data, round(avg(m), 6) as mean from (select case when 250 + source * 20 <= 591 then 'Latin Extended' when 250 + source * 20 between 880 and 1023 then 'Greek' when 250 + source * 20 between 1024 and 1327 then 'Cyrillic' else 'Other BMP' end as g, avg(ssim) as m from m1 group by source, target) group by g")
def A15_by_script_group(spark, sf_dir):
    scores = summ.pair_summary(_job1(spark, sf_dir)).withColumn("source_cp", to_u_plus(250 + F.col("source") * 20))
    return _round(summ.by_report_group(scores), "mean")


@query(BASE + ", s as (select source // 10 as sa, target // 10 as sb, source, target, avg(ssim) as m from m1 group by source, target), k as (select *, row_number() over (partition by sa, sb order by m desc, source, target) as o from s where m is not null) select a.*, b.best from (select sa as script_a, sb as script_b, count(*) filter (m >= 0.05) as high, count(*) filter (m >= 0 and m < 0.05) as medium, count(*) filter (m < 0) as low, count(*) filter (m is null) as \"noData\", count(*) as total from s group by sa, sb) a left join (select sa, sb, string_agg(source || '>' || target, ' ' order by o) as best from k where o <= 5 group by sa, sb) b on script_a = sa and script_b = sb")
def A20_script_pair_summary(spark, sf_dir):
    scores = summ.means_of_sums(pair_sums(renders(spark, sf_dir), HASH)).withColumn("script_a", F.floor(F.col("source") / 10).cast("int")).withColumn("script_b", F.floor(F.col("target") / 10).cast("int"))
    return summ.script_pair_summary(scores, HIGH, MEDIUM).withColumn("best", F.concat_ws(" ", "best"))


@query(BASE + ", s as (select 'R' || (source // 7) as range, avg(ssim) as m from m1 group by source, target), c as (select 'R' || (range // 7) as range, count(*) as candidates from range(20, 45) group by 1) select s.range, count(*) as scored, count(*) filter (m >= 0.05) as high, count(*) filter (m >= 0 and m < 0.05) as medium, count(*) filter (m < 0) as low, coalesce(max(candidates), 0) as candidates from s left join c on s.range = c.range group by s.range")
def A19_range_breakdown(spark, sf_dir):
    label = lambda c: F.concat(F.lit("R"), F.floor(c / 7).cast("string"))
    scores = summ.pair_summary(_job1(spark, sf_dir)).withColumn("range", label(F.col("source")))
    return summ.range_breakdown(scores, spark.range(20, 45).select(label(F.col("id")).alias("range")), HIGH, MEDIUM)


@query(BASE + f"select high = 0 as verification_passed, high, total from ({BANDS} from (select avg(ssim) as m from m1 group by source, target))")
def A26_verified(spark, sf_dir):
    return summ.verified(A02_band_counts(spark, sf_dir))


@query(BASE + "select case when source_font = target_font then 'same' else 'cross' end as mode, case when phash < 0.5 then 'phash' when greatest(s_ink_w, t_ink_w) / least(s_ink_w, t_ink_w)::double > 1.1 then 'width' end as cause, count(*) as n from allp where not s_is_target and t_is_target and t_standard group by 1, 2")
def A25_skip_causes(spark, sf_dir):
    r = renders(spark, sf_dir)
    _, _, targets = sides(r)
    met = sim.all_pairs(r.where("not is_target").drop("px", "bits"), targets).withColumn("phash", sim.hash_similarity())
    return sim.skip_causes(met, HASH, 1.1).groupBy("mode", "cause").agg(F.count("*").alias("n"))


@query(BASE + ", v as (select source as char, avg(case when target = 1 then ssim end) as t, avg(case when target = 2 then ssim end) as n, count(*) as valid_fonts from allp where not s_is_target and target in (1, 2) and source_font = target_font group by source) select char, round(t, 6) as mean_tr39_ssim, round(n, 6) as mean_nfkc_ssim, case when t - n is null then 'insufficient' when abs(t - n) < 0.05 then 'equal' when t > n then 'tr39' else 'nfkc' end as verdict from v")
def A04_vector_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("char", "mean_tr39_ssim", "mean_nfkc_ssim", "verdict")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = renders(spark, sf_dir)
    light = r.drop("px", "bits")
    met = sim.with_global_ssim(sim.same_font(light.where("not is_target"), light.where("ch in (1, 2)")), r)
    pick = lambda t, c: F.when(F.col("t_ch") == t, F.col(c))
    results = met.select(F.col("s_ch").alias("char"), F.lit("native").alias("status"), pick(1, "ssim").alias("tr39_ssim"), pick(1, "phash").alias("tr39_phash"), pick(2, "ssim").alias("nfkc_ssim"), pick(2, "phash").alias("nfkc_phash"))
    return _round(summ.vector_verdicts(results), "mean_tr39_ssim", "mean_nfkc_ssim")


@query(BASE + ", v as (select avg(case when target = 1 then ssim end) - avg(case when target = 2 then ssim end) as g from allp where not s_is_target and target in (1, 2) and source_font = target_font group by source) select count(*) as total, count(*) filter (g >= 0.05) as tr39, count(*) filter (g <= -0.05) as nfkc, count(*) filter (abs(g) < 0.05) as equal, count(*) filter (g is null) as insufficient from v")
def A05_verdict_counts(spark, sf_dir):
    return summ.verdict_counts(_verdicts(spark, sf_dir))


# Queries: weights

UP = "floor({0} * 10000 + 0.5) / 10000"
EDGES = ", e0 as (select source, target, {side}, coalesce(quantile_cont(ssim, 0.95), 0) as stable from m1 group by source, target), e as (select source, target, {rounded}, same_n, cross_n, {danger} as danger, {stable} as stable_danger, {cost} as cost from e0)".format(
    side=", ".join(f"coalesce(max(ssim) filter ({c}), 0) as {s}_max, coalesce(quantile_cont(ssim, 0.95) filter ({c}), 0) as {s}_p95, coalesce(avg(ssim) filter ({c}), 0) as {s}_mean, count(ssim) filter ({c}) as {s}_n" for s, c in (("same", "source_font = target_font"), ("cross", "source_font <> target_font"))),
    rounded=", ".join(f"{UP.format(f'{s}_{m}')} as {s}_{m}" for s in ("same", "cross") for m in ("max", "p95", "mean")),
    danger=UP.format("greatest(same_max, cross_max)"),
    stable=UP.format("stable"),
    cost=UP.format("greatest(0, least(1, 1 - stable))"),
)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    same, others, targets = same_and_crossed(renders(spark, sf_dir))
    return wt.rounded_weights(blocks.pair_weights(others, targets, sim.comparisons(sim.with_own_ssim(same, HASH)), HASH))


@query(BASE + EDGES + "select * from e")
def A06_edge_weights(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(BASE + EDGES + "select count(*) as edges, count(*) filter (cost = 0) as zero, count(*) filter (cost > 0 and cost < 0.1) as low, count(*) filter (cost >= 0.1 and cost < 0.3) as moderate, count(*) filter (cost >= 0.3) as higher, min(cost) as least_cost, max(cost) as most_cost from e")
def A08_weight_summary(spark, sf_dir):
    return wt.weight_summary(_edges(spark, sf_dir))


CROSS = ", x as (select row_number() over (order by source, target, source_font, target_font) as ord, source, target, ssim, source_font, target_font from m2), c as (select target as source, source as target, max(ssim) as best_ssim, avg(ssim) as mean_ssim, count(*) as valid_fonts from m2 group by source, target)"


def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _job2(spark, sf_dir).groupBy(F.col("target").alias("source"), F.col("source").alias("target")).agg(F.max("ssim").alias("best_ssim"), F.avg("ssim").alias("mean_ssim"), F.count("*").alias("valid_fonts"))


@query(BASE + CROSS + f" select source, target, {UP.format('best_ssim')} as danger, {UP.format('coalesce(mean_ssim, best_ssim)')} as stable_danger, {UP.format(f'greatest(0, least(1, 1 - {UP.format("coalesce(mean_ssim, best_ssim)")}))')} as cost, valid_fonts as same_n from c")
def A07_cross_script_edges(spark, sf_dir):
    return wt.cross_script_edges(_cross(spark, sf_dir)).select("source", "target", "danger", "stable_danger", "cost", "same_n")


DOUBLED = ", cand as (select source, target, source * 100 + target as ord from (select distinct source, target from m1) union all select target, source, 100000 + source * 100 + target from (select distinct source, target from m1 where source < 30)), known as (select distinct source, target from m1 where source % 3 = 0 and target % 2 = 0)"


@query(BASE + DOUBLED + " select source, target, ord from (select *, row_number() over (partition by least(source, target), greatest(source, target) order by ord) as o from cand c where not exists (select 1 from known k where least(k.source, k.target) = least(c.source, c.target) and greatest(k.source, k.target) = greatest(c.source, c.target))) where o = 1")
def J11_new_cross_script(spark, sf_dir):
    pairs = _job1(spark, sf_dir).select("source", "target").distinct()
    cand = pairs.withColumn("ord", F.col("source") * 100 + F.col("target")).unionByName(pairs.where("source < 30").select(F.col("target").alias("source"), F.col("source").alias("target"), (100000 + F.col("source") * 100 + F.col("target")).alias("ord")))
    return wt.new_cross_script(cand, pairs.where("source % 3 = 0 and target % 2 = 0"))


@query(BASE + EDGES + ", f as (select source, target, coalesce(source % 7 = 0, false) as g from (select distinct source, target from m1 where target < 5)) select e.source, e.target, coalesce(g, false) as glyph_reuse, coalesce(case when e.target < 9 then e.source % 2 = 0 end, false) as xid_start, e.target < 9 as xid_continue, false as idna_pvalid, e.target < 9 and e.source > 30 as tr39_allowed from e left join f on e.source = f.source and e.target = f.target")
def J10_flags(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    pairs = edges.select("source", "target")
    reuse = wt.later_wins([pairs.where("target < 5").withColumn("glyph_reuse", F.lit(True)), pairs.where("target < 5").withColumn("glyph_reuse", F.col("source") % 7 == 0)])
    properties = pairs.where("target < 9").select("*", (F.col("source") % 2 == 0).alias("xid_start"), F.lit(True).alias("xid_continue"), F.lit(False).alias("idna_pvalid"), (F.col("source") > 30).alias("tr39_allowed"))
    return wt.with_flags(edges, reuse, properties).select("source", "target", "glyph_reuse", *wt.PROPERTIES)


@query(BASE + EDGES + ", e2 as (select 'tr39' as origin, source, target, danger, cost from e where source < 30 union all select 'novel', source, target, danger, cost from e where source between 30 and 40 union all select 'cross-script', source, target, danger, cost from e where source > 40) select *, origin = 'tr39' as in_tr39 from e2")
def U01_all_edges(spark, sf_dir):
    e = _edges(spark, sf_dir).select("source", "target", "danger", "cost")
    return wt.all_edges(e.where("source < 30"), e.where("source between 30 and 40"), e.where("source > 40"))


FONT = f", fe as (select target_font, source, target, {UP.format('max(ssim)')} as ssim, max(ssim) as raw, arg_max(source_font, (ssim, source_font)) as source_font from m1 where ssim is not null group by target_font, source, target)"


@query(BASE + FONT + "select target_font, source, target, ssim, source_font from fe")
def N02_font_edges(spark, sf_dir):
    return wt.font_edges(_job1(spark, sf_dir))


@query(BASE + FONT + f"select target_font as font, count(*) as total_pairs, count(*) filter (ssim >= 0.05) as high_risk, {UP.format('count(*) filter (ssim >= 0.05) / count(*)::double')} as danger_rate from fe group by target_font")
def A09_font_summary(spark, sf_dir):
    return wt.font_summary(wt.font_edges(_job1(spark, sf_dir)), HIGH)


@query(BASE + FONT + f", fs as (select target_font as font, count(*) as total_pairs, {UP.format('count(*) filter (ssim >= 0.05) / count(*)::double')} as danger_rate from fe group by target_font) select font, total_pairs, danger_rate from (select *, row_number() over (order by danger_rate desc, font) as o, count(*) over () as n from fs) where o = n // 2 + 1")
def A11_median_font(spark, sf_dir):
    return wt.median_font(wt.font_summary(wt.font_edges(_job1(spark, sf_dir)), HIGH))


BEST1 = ", b1 as (select * from (select *, row_number() over (partition by source, target order by ssim desc, source_font * 1000 + target_font) as o from m1 where ssim is not null) where o = 1)"
RATIOS = BEST1 + f", i as (select ch, font, ink_w, ink_h from r), q as (select b1.source, b1.target, greatest(a.ink_w, b.ink_w) / least(a.ink_w, b.ink_w)::double as w, greatest(a.ink_h, b.ink_h) / least(a.ink_h, b.ink_h)::double as h from b1 join i a on a.ch = b1.source and a.font = source_font join i b on b.ch = b1.target and b.font = target_font), z as (select source, target, {UP.format('w').replace('10000', '100')} as width_ratio, {UP.format('h').replace('10000', '100')} as height_ratio, w > 1.15 or h > 1.15 as flagged from q)"


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = _job1(spark, sf_dir).withColumn("ord", F.col("source_font") * 1000 + F.col("target_font"))
    return wt.size_ratios(summ.best_comparison(ordered), renders(spark, sf_dir).select("ch", "font", "ink_w", "ink_h"), 1.15)


@query(BASE + RATIOS + "select source, target, width_ratio, height_ratio, flagged from z")
def J16_size_ratios(spark, sf_dir):
    return _ratios(spark, sf_dir).select("source", "target", "width_ratio", "height_ratio", "flagged")


@query(BASE + RATIOS + ", h(ord, bucket, lo, hi) as (values (0, '[1.0, 1.25)', 1.0, 1.25), (1, '[1.25, 1.5)', 1.25, 1.5), (2, '[1.5, 2.0)', 1.5, 2.0), (3, '[2.0, 3.0)', 2.0, 3.0), (4, '>= 3.0', 3.0, 1e9)) select h.ord, bucket, count(*) filter (width_ratio >= lo and width_ratio < hi) as width, count(*) filter (height_ratio >= lo and height_ratio < hi) as height from h, z group by h.ord, bucket")
def A21_ratio_histogram(spark, sf_dir):
    return wt.ratio_histogram(_ratios(spark, sf_dir))


@query(BASE + RATIOS + "select case when source < 30 then 'TR39' when source < 40 then 'M2' else 'M2b' end as milestone, count(*) as pairs, count(*) filter (flagged) as flagged from z group by 1")
def A22_flagged(spark, sf_dir):
    milestone = F.when(F.col("source") < 30, "TR39").when(F.col("source") < 40, "M2").otherwise("M2b").alias("milestone")
    return _ratios(spark, sf_dir).groupBy(milestone).agg(F.count("*").alias("pairs"), F.count_if("flagged").alias("flagged"))


@query(BASE + "select source as source_cp, target as target_cp, count(*) as checked, count(*) filter (source_font % 2 = 0) as reused, count(*) filter (source_font % 2 <> 0) as coincidences, bool_or(source_font % 2 = 0) as glyph_reuse from m1 where source_font = target_font and ssim >= 0.05 group by source, target")
def A16_glyph_reuse(spark, sf_dir):
    facts = _job1(spark, sf_dir).withColumnsRenamed({"source": "source_cp", "target": "target_cp"})
    # fonts of even number have one glyph for all characters, the others have none for sources
    glyphs = renders(spark, sf_dir).where("font % 2 = 0 or is_target").select(F.col("font").alias("family"), F.col("ch").alias("cp"), F.lit(7).alias("glyph"))
    return wt.glyph_reuse(facts, glyphs, HIGH)


# Rows only: windowed similarity of pair-normalised bitmaps


def _draw(spark: SparkSession, most: int) -> tuple[DataFrame, Draw]:
    """Fonts (font, family, category, path) of this machine, the first by name, and how they draw; without any, stand-ins."""
    rows = installed(spark).where("category = 'standard'").orderBy("family").limit(most).collect()
    if not rows:
        fonts = spark.range(most).select(F.concat(F.lit("F"), F.col("id").cast("string")).alias("family"))
        return fonts.select(F.col("family").alias("font"), "family", F.lit("standard").alias("category"), F.lit("").alias("path")), bitmap
    fonts = spark.createDataFrame([(r.family, r.family, r.category, r.path) for r in rows], "font string, family string, category string, path string")
    return fonts, ship(spark, fonts)


@query()
def C07_render_index(spark, sf_dir):
    """The render index of Latin, Greek and Cyrillic letters in the fonts of this machine that cover them."""
    fonts, draw = _draw(spark, 4)
    points = spark.range(0x61, 0x7B).unionByName(spark.range(0x3B1, 0x3CA)).unionByName(spark.range(0x430, 0x450)).select(F.col("id").cast("int").alias("cp"))
    covered = coverage(glyph_table(spark, fonts)) if draw is not bitmap else points.crossJoin(fonts.select("family"))
    none = fonts.select("family", "category").limit(0)
    return build_index(points, covered, fonts, none, draw).drop("pixels")


@query()
def C12_font_scripts(spark, sf_dir):
    """Cyrillic letters that look like Latin ones in the fonts of this machine, with their best comparison."""
    fonts, draw = _draw(spark, 4)
    points = spark.range(0x61, 0x7B).unionByName(spark.range(0x430, 0x450)).select(F.col("id").cast("int").alias("cp"))
    covered = coverage(glyph_table(spark, fonts)) if draw is not bitmap else points.crossJoin(fonts.select("family"))
    index, _ = scratch.keep(build_index(points, covered, fonts, fonts.select("family", "category").limit(0), draw), "index")
    latin = F.col("ch").between("a", "z")
    cross = score_script_pair(index.where(~latin), index.where(latin)).withColumns({"script_a": F.lit("Cyrillic"), "script_b": F.lit("Latin")})
    return extract_scripts(cross).select("source", "target", F.round("mean_ssim", 6).alias("mean_ssim"), "identical", "valid_fonts")


@query()
def C11_score_sequences(spark, sf_dir):
    """M4: all sequences with all characters of the same font, gates, windowed SSIM, summary, in fonts of this machine."""
    from ..functions.pixels import measure, score_pairs
    from ..operators.candidates import ALPHABET, sequences
    from ..sources.renders import SEQUENCE_CANVAS, render

    letters = spark.range(len(ALPHABET)).select(F.substring(F.lit(ALPHABET), F.col("id").cast("int") + 1, F.lit(1)).alias("ch"))
    fonts, draw = _draw(spark, 3)
    wanted = sequences(spark).select(F.col("sequence").alias("ch"))
    jobs = lambda texts: texts.crossJoin(F.broadcast(fonts.select("font"))).repartition(spark.sparkContext.defaultParallelism, "ch")  # noqa: E731  the alphabet in some fonts
    # drawn and measured once; comparisons are spread by pair, as there are few fonts and the kernel is what takes time
    s, _ = scratch.keep(measure(render(jobs(wanted), draw, *SEQUENCE_CANVAS)).where("status = 'native'"), "sequences")
    t, _ = scratch.keep(measure(render(jobs(letters), draw)).where("status = 'native'"), "letters")
    light = lambda r, p: sim.side(r.select("ch", "font", "phash", "ink_w"), p)
    met = sim.gate_width(sim.gate_hash(light(s, "s").join(light(t, "t"), F.col("s_font") == F.col("t_font")).withColumn("phash", sim.hash_similarity()), sim.SEQUENCE_HASH))
    pixels = lambda r, p, name: r.select(F.col("ch").alias(f"{p}_ch"), F.col("font").alias(f"{p}_font"), *(F.col(c).alias(f"{name}_{c}") for c in ("pixels", "width", "height")))
    pairs = met.select("s_ch", "t_ch", "s_font", "t_font", "phash").repartition(4 * spark.sparkContext.defaultParallelism, "s_ch")
    joined = pairs.join(pixels(s, "s", "a"), ["s_ch", "s_font"]).join(F.broadcast(pixels(t, "t", "b")), ["t_ch", "t_font"])  # an alphabet in some fonts
    scored = score_pairs(joined, least_ink=sim.INK_SHARE).where("not ink_skipped")
    return summ.pair_summary(sim.comparisons(scored))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice 0: the best-scoring pairs over same-font renders, from vectors to a top list."""
    r = renders(spark, sf_dir)
    sources, _, targets = sides(r)
    facts = sim.comparisons(sim.with_global_ssim(sim.gate_hash(sim.same_font(sources, targets), HASH), r))
    scores = summ.pair_summary(facts)
    return summ.top(scores.where(F.col("mean_ssim") >= HIGH), 20).select("source", "target", F.round("mean_ssim", 6).alias("mean_ssim"), F.round("mean_phash", 6).alias("mean_phash"), "native_fonts", "valid_fonts")


query(BASE + "select source, target, round(avg(ssim), 6) as mean_ssim, round(avg(phash), 6) as mean_phash, count(distinct source_font) as native_fonts, count(*) as valid_fonts from allp where source_font = target_font and not s_is_target and t_is_target and s_standard and phash >= 0.5 group by source, target having avg(ssim) >= 0.05 order by avg(ssim) desc, source, target limit 20", "C13_flagship")(flagship)


@query()
def P21_windowed_ssim(spark, sf_dir):
    """Windowed SSIM of all pairs of 62 characters in four fonts, normalised together: the kernel's throughput."""
    from ..functions.pixels import score_pairs
    from ..operators.candidates import ALPHABET
    from ..sources.renders import render

    chars = spark.range(len(ALPHABET)).select(F.substring(F.lit(ALPHABET), F.col("id").cast("int") + 1, F.lit(1)).alias("ch"))
    drawn = render(chars.crossJoin(spark.range(4).select(F.concat(F.lit("F"), F.col("id").cast("string")).alias("font"))), bitmap).where("status = 'native'").select("ch", "font", "pixels", "width", "height")
    a, b = (drawn.withColumnsRenamed({c: f"{s}_{c}" for c in ("ch", "pixels", "width", "height")}) for s in "ab")
    # spread by pair: there are few fonts, and the kernel is what takes time
    pairs = a.join(b, "font").repartition(spark.sparkContext.defaultParallelism, "a_ch", "b_ch")
    return score_pairs(pairs).select("font", F.col("a_ch").alias("source"), F.col("b_ch").alias("target"), F.round("ssim", 6).alias("ssim"))
