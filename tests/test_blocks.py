"""Comparisons in cells: the same as met one by one, however the sides are dealt, and none of them is shuffled."""

import random

import numpy as np
from pyspark.sql import functions as F

from peerglyph.operators import blocks, similarity, summaries
from peerglyph.plans import scorejobs

KIND = "ch int, font int, ord long, phash long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some(spark, n, first, seed):
    rng = random.Random(seed)
    hashes = [rng.getrandbits(6) - 32 for _ in range(4)]
    return spark.createDataFrame([(first + k % 3, rng.choice([0, 1, 2, None]), 1000 * first + k, rng.choice([*hashes, None])) for k in range(n)], KIND)


def test_best_in_another_font_is_found_in_cells(spark):
    """ties, unknown hashes and fonts; candidates are neither joined row by row nor sorted."""
    a, b = some(spark, 40, 1, 1), some(spark, 60, 7, 2)
    want = {}
    for s in a.collect():
        met = [t for t in b.collect() if None not in (s.font, t.font) and s.font != t.font]
        bits = lambda t, s=s: 99 if None in (s.phash, t.phash) else ((s.phash ^ t.phash) % 2**64).bit_count()
        if met:
            t = min(met, key=lambda t: (bits(t), t.ord))
            want[s.ord] = (t.ord, None if bits(t) == 99 else 1 - bits(t) / 64)
    for sizes in ({}, {"worth": 50}, {"most": 7}):
        assert {r.s_ord: (r.t_ord, r.phash) for r in blocks.best(a, b, **sizes).collect()} == want
    assert "NestedLoop" not in (p := plan(similarity.best_in_script(a, b))) and "Join" not in p


def test_percentiles_are_exact_however_few_numbers_are_kept():
    """with ties and a bulk in one narrow step, numbers are counted in ever smaller steps, not kept."""
    rng = random.Random(5)
    for numbers in ([rng.gauss(0, 0.1) for _ in range(4000)], [0.25] * 3000 + [rng.random() for _ in range(300)], [0.5 + 1e-9 * rng.random() for _ in range(2000)] + [-1.0, 1.0], [0.1], [-0.5] * 500):
        x = np.array(numbers)
        for kept in (10, 100, 10_000):
            assert abs(blocks.percentile(lambda x=x: iter(np.array_split(x, 7)), len(x), 0.95, kept) - np.percentile(x, 95)) < 1e-12
    assert blocks.percentile(lambda: iter([]), 0, 0.95) == 0.0


def test_weights_come_from_cells_without_shuffled_comparisons(spark, sf_dir):
    """no buffers of all values; few kept numbers give the same."""
    edges = scorejobs.A06_edge_weights(spark, sf_dir)
    assert "ObjectHashAggregate" not in plan(edges)
    same, others, targets = scorejobs.same_and_crossed(scorejobs.renders(spark, sf_dir))
    known = similarity.comparisons(similarity.with_own_ssim(same, 0.5))
    few = {(r.source, r.target): (r.cross_p95, r.stable_danger, r.same_n, r.cross_n) for r in blocks.pair_weights(others, targets, known, 0.5, kept=3).collect()}
    for r in edges.collect():
        p95, stable, *counts = few[r.source, r.target]
        assert abs(r.cross_p95 - p95) < 6e-5 and abs(r.stable_danger - stable) < 6e-5 and counts == [r.same_n, r.cross_n]


def test_pairs_are_added_up_in_cells(spark, sf_dir):
    """the same means as from single comparisons, in one cell and in many, and no product of rows."""
    r = scorejobs.renders(spark, sf_dir)
    want = {(x.source, x.target): (x.m, x.n) for x in scorejobs.score_pairs(r, 0.5).groupBy("source", "target").agg(F.avg("ssim").alias("m"), F.count("*").alias("n")).collect()}
    got = {(x.source, x.target): (x.mean_ssim, x.valid_fonts) for x in summaries.means_of_sums(scorejobs.pair_sums(r, 0.5)).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == n and (got[k][0] == m or abs(got[k][0] - m) < 1e-12) for k, (m, n) in want.items())
    _, others, targets = scorejobs.same_and_crossed(r)
    total = lambda rows: tuple(rows.agg(F.sum("n"), F.sum("scored"), F.sum("identical")).first())
    assert total(blocks.sums(others, targets, 0.5, 0.1, worth=500)) == total(blocks.sums(others, targets, 0.5, 0.1)) == total(blocks.sums(others, targets, 0.5, 0.1, most=20))
    assert "NestedLoop" not in plan(scorejobs.A20_script_pair_summary(spark, sf_dir))


def test_scripts_are_met_in_cells(spark, sf_dir):
    """pixels join the winners alone, and candidates aren't sorted."""
    p = plan(scorejobs.C12_score_scripts(spark, sf_dir))
    assert p.count("FlatMapGroupsInArrow") and "NestedLoop" not in p
    r = scorejobs.renders(spark, sf_dir).withColumn("script", F.floor(F.col("ch") / 10).cast("int"))
    found = [{(x.s_ord, x.t_script): (x.t_ord, x.phash) for x in blocks.best(r, r, ("script",), "script", **kw).collect()} for kw in ({}, {"worth": 5_000})]
    assert found[0] == found[1] and len(found[0]) == 1000  # of 100 renders each: 4 + 3 + 2 + 1 later scripts


def test_comparisons_in_cells_are_those_of_the_joins(spark, sf_dir):
    """every source with every target once, with the very same SSIM as by joins, and no product of rows."""
    assert "NestedLoop" not in plan(scorejobs.C09_score_pairs(spark, sf_dir))
    r = scorejobs.renders(spark, sf_dir).where("ord < 200").withColumn("phash", F.when(F.col("ord") != 157, F.col("phash"))).withColumn("px", F.when(F.col("ord") == 158, F.array(F.lit(0.5))).when(F.col("ord") == 159, F.array(F.lit(None).cast("double"))).otherwise(F.col("px")))
    _, others, targets = scorejobs.same_and_crossed(r)
    met = similarity.all_pairs(*(x.select("ch", "font", "ord", "phash", "px", "mean", "var") for x in (others, targets))).withColumn("phash", similarity.hash_similarity())
    rows = lambda df: sorted(map(repr, df.select("s_ch", "s_font", "t_ch", "t_font", "phash", "ssim").collect()))
    want = rows(similarity.with_own_ssim(met, 0.5))
    assert len(want) == 30 * 60
    assert rows(blocks.scored(others, targets, 0.5)) == rows(blocks.scored(others, targets, 0.5, worth=300)) == want


def test_report_meets_comparisons_once(spark, sf_dir):
    """its sections read the kept sums of pairs; none of them meets all comparisons again."""
    from peerglyph.plans import filejobs

    p = plan(filejobs.C22_report(spark, sf_dir))
    assert "NestedLoop" not in p and "FlatMapGroupsInArrow" not in p


def test_best_of_any_fonts_is_among_the_bests_of_each(spark, sf_dir):
    """Look-ups find in the kept comparisons what they find in all of them."""
    r = scorejobs.renders(spark, sf_dir)
    _, others, targets = scorejobs.same_and_crossed(r)
    every = blocks.scored(others, targets, 0.5).where("ssim is not null")
    ask = lambda rows, fonts: {(x.s_ch, x.t_ch): tuple(x.b) for x in rows.where(F.col("s_font").isin(fonts) | F.col("t_font").isin(fonts)).groupBy("s_ch", "t_ch").agg(F.max_by(F.struct("s_font", "t_font", "ssim"), F.struct("ssim", (-F.col("s_font") * 1000 - F.col("t_font")).alias("o"))).alias("b")).collect()}
    for kw in ({}, {"worth": 500}):
        few = blocks.font_bests(others, targets, 0.5, **kw)
        assert few.count() < every.count()
        for fonts in ([3], [0, 1], [7, 2]):
            assert ask(few, fonts) == ask(every, fonts)


def test_fonts_are_compared_without_keeping_all_comparisons(spark, sf_dir, monkeypatch):
    """F8: what is kept is less than all comparisons."""
    from peerglyph.plans import fontjobs

    kept = []
    keep = fontjobs.scratch.keep
    monkeypatch.setattr(fontjobs.scratch, "keep", lambda rows, name: kept.append(keep(rows, name)) or kept[-1])
    fontjobs.J14_compare_fonts(spark, sf_dir)
    assert 0 < kept[0][0].count() < scorejobs.score_pairs(scorejobs.renders(spark, sf_dir), 0.5).count()
