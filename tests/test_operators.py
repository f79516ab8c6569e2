"""Ties, nulls and properties that the queries on the driver's tables don't reach."""

from math import comb

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peerglyph.functions import hashes, labels, numbers
from peerglyph.operators import experiments, similarity, summaries, weights
from peerglyph.streaming import incremental

FACT = "source string, target string, source_font string, target_font string, ssim double, phash double, status string, ssim_skipped boolean"


def facts(spark, *rows):
    return spark.createDataFrame([(s, t, sf, tf, x, 0.5, "native", x is None) for s, t, sf, tf, x in rows], FACT)


def renders(spark, *rows):
    return spark.createDataFrame([(c, f, o, h, 5, 5) for c, f, o, h in rows], "ch string, font string, ord long, phash long, ink_w int, ink_h int")


def test_best_target_font_takes_the_first_of_equal_ones_and_never_similarity_zero(spark):
    sources = renders(spark, ("x", "S", 100, 0), ("y", "S", 101, -1))
    targets = renders(spark, ("a", "T2", 2, 1), ("a", "T1", 1, 2), ("a", "T3", 3, 3), ("b", "T1", 4, 0))
    got = {(r.s_ch, r.t_ch): (r.t_font, r.phash) for r in similarity.best_target_font(sources, targets, 0.0).collect()}
    assert got[("x", "a")] == ("T1", 1 - 1 / 64)  # T1 and T2 differ in one bit; T1 stands first
    assert got[("x", "b")] == ("T1", 1.0)
    assert ("y", "b") not in got  # all 64 bits differ


def test_best_in_script_needs_another_font(spark):
    best = similarity.best_in_script(renders(spark, ("x", "F", 1, 0)), renders(spark, ("a", "F", 2, 0), ("b", "G", 3, 7), ("c", "H", 4, 1))).collect()
    assert [(r.t_ch, r.t_font) for r in best] == [("c", "H")]


def test_width_gate_lets_unknown_widths_pass(spark):
    met = spark.createDataFrame([(10, 5), (10, 9), (None, 5), (0, 5)], "s_ink_w int, t_ink_w int")
    assert similarity.gate_width(met).count() == 3


def test_summary_counts_and_bands(spark):
    rows = facts(spark, ("x", "a", "F", "F", 0.9), ("x", "a", "F", "G", None), ("y", "a", "F", "F", 0.3), ("z", "a", "F", "F", None), ("w", "a", "F", "F", 0.7), ("v", "a", "F", "F", -0.2))
    scores = summaries.pair_summary(rows)
    x = scores.where("source = 'x'").first()
    assert (x.mean_ssim, x.native_fonts, x.valid_fonts, x.notdef_fonts) == (0.9, 1, 2, 0)
    b = summaries.band_counts(scores).first()
    assert (b.high, b.medium, b.low, b.noData, b.total) == (2, 1, 1, 1, 5)
    kept = summaries.keep_pairs(spark.createDataFrame([("q", "a"), ("x", "a")], "source string, target string"), scores).where("source = 'q'").first()
    assert kept.mean_ssim is None and kept.valid_fonts == 0


def test_identical_comparisons_count_only_where_asked(spark):
    rows = facts(spark, ("x", "a", "F", "F", 1.0), ("x", "a", "G", "G", 0.0))
    assert summaries.discoveries(rows).count() == 0
    assert summaries.discoveries(rows, identical=True).count() == 1


def test_vector_verdicts(spark):
    rows = [("a", "native", 0.9, 0.5), ("b", "native", 0.5, 0.52), ("c", "native", 0.1, 0.5), ("d", "notdef", 0.1, 0.5), ("e", "native", None, 0.5)]
    df = spark.createDataFrame([(c, s, t, 0.5, n, 0.5) for c, s, t, n in rows], "char string, status string, tr39_ssim double, tr39_phash double, nfkc_ssim double, nfkc_phash double")
    assert {r.char: r.verdict for r in summaries.vector_verdicts(df).collect()} == {"a": "tr39", "b": "equal", "c": "nfkc", "e": "insufficient"}


def test_fallback_fonts_are_found_by_their_pixels(spark):
    r = spark.createDataFrame([("a", bytearray(b"xyz")), ("b", bytearray(b"xyz"))], "ch string, pixels binary")
    refs = spark.createDataFrame([("a", "G", 2, bytearray(b"xyz")), ("a", "H", 1, bytearray(b"xyz")), ("b", "G", 1, bytearray(b"q"))], "ch string, font string, ord int, pixels binary")
    assert {x.ch: x.fallback_font for x in summaries.fallback_font(r, refs).collect()} == {"a": "H", "b": None}


@given(st.lists(st.floats(-1, 1), min_size=1, max_size=6), st.lists(st.floats(-1, 1), max_size=6))
@settings(max_examples=8, deadline=None)
def test_edge_weights_keep_their_bounds(spark, same, cross):
    rows = [("x", "a", "F", "F", float(v)) for v in same] + [("x", "a", "F", "G", float(v)) for v in cross]
    e = weights.edge_weights(facts(spark, *rows)).first()
    assert 0 <= e.cost <= 1 and (e.same_n, e.cross_n) == (len(same), len(cross))
    assert e.danger >= e.stable_danger - 1e-4 or e.danger == 0


def test_cross_script_pairs_come_once_whichever_way_round(spark):
    cross = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("c", "d", 3), ("e", "f", 4)], "source string, target string, ord int")
    known = spark.createDataFrame([("d", "c")], "source string, target string")
    assert sorted((r.source, r.target) for r in weights.new_cross_script(cross, known).collect()) == [("a", "b"), ("e", "f")]


def test_rounding_halves_go_up(spark):
    got = spark.range(1).select(numbers.round_half_up(F.lit(-0.00005)).alias("a"), numbers.round_half_up(F.lit(0.00025)).alias("b")).first()
    assert got.a == 0.0 and got.b == pytest.approx(0.0003)


def test_hash_hex_round_trip(spark):
    row = spark.createDataFrame([("ffffffffffffffff",), ("00000000000000a1",)], "h string").select("h", hashes.to_hex(hashes.from_hex(F.col("h"))).alias("g")).collect()
    assert all(r.h == r.g for r in row)


def test_font_names(spark):
    rows = spark.createDataFrame([("NotoSansOldItalic-Regular.ttf",), ("NotoSansArmenian.ttc",)], "f string").select(labels.noto_family(F.col("f")).alias("n"))
    assert [r.n for r in rows.collect()] == ["Noto Sans Old Italic", "Noto Sans Armenian"]


def test_fisher_exact():
    assert experiments.fisher_exact(3, 1, 1, 3) == pytest.approx((1 + 16 + 16 + 1) / comb(8, 4))
    assert experiments.fisher_exact(0, 0, 0, 0) == 1.0


def test_hash_gate_stands_below_the_pixel_kernel(spark):
    """Only rows that pass the gate reach Python."""
    from peerglyph.functions.pixels import score_pairs

    pairs = spark.createDataFrame([(1, 0.1, b"", 0, 0, b"", 0, 0)], "k int, phash double, a_pixels binary, a_width int, a_height int, b_pixels binary, b_width int, b_height int")
    plan = score_pairs(similarity.gate_hash(pairs, 0.3))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("Filter")


def test_renders_are_pruned_in_joins(spark, sf_dir):
    """Hash joins read no pixels again: the vectors are read once a side, and SSIM joins them by their number."""
    from peerglyph.plans import scorejobs

    sources, _, targets = scorejobs.sides(scorejobs.renders(spark, sf_dir))
    assert "px" not in similarity.same_font(sources, targets).columns


def test_incremental_runs_take_each_unit_once(spark, tmp_path):
    schema = "unit string, ssim double, ssim_skipped boolean"
    inbox, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    run = lambda: incremental.run_new(spark, inbox, schema, lambda b: b, out, state, ["unit"])
    spark.createDataFrame([("a", 0.5, False), ("a", None, True)], schema).write.parquet(inbox)
    assert run() == 2 and run() == 0
    spark.createDataFrame([("b", 0.7, False)], schema).write.mode("append").parquet(inbox)
    assert run() == 1
    done = spark.read.parquet(out)
    assert sorted((r.unit, r.rows, r.computed, r.skipped) for r in incremental.counters(done, ["unit"]).collect()) == [("a", 2, 1, 1), ("b", 1, 1, 0)]
    spark.createDataFrame([("b", 0.1, False), ("b", 0.2, False)], schema).write.mode("append").parquet(inbox)
    assert run() == 2  # more rows of a unit that a former run has written
    assert sorted((r.unit, r.rows) for r in incremental.counters(spark.read.parquet(out), ["unit"]).collect()) == [("a", 2), ("b", 3)]
    work = spark.createDataFrame([("a",), ("c",)], "unit string")
    assert [r.unit for r in incremental.remaining(work, done, ["unit"]).collect()] == ["c"]


def test_control_pairs_decide(spark):
    rows = spark.createDataFrame([("rn/m", 0.5, 0.8), ("ww/n", 0.2, 0.4)], "pair string, mean_ssim double, max_ssim double")
    assert incremental.checked(rows, ["rn/m"], ["ww/n", "mm/n"])
    assert not incremental.checked(rows, ["rn/m", "cl/d"], [])
    assert not incremental.checked(rows, [], ["rn/m"])


def test_code_points_are_counted(spark):
    from collections import Counter

    from peerglyph.functions.codepoints import count_code_points

    texts = ["abca", None, "", "é中\U00010348\U00010348", "a" * 5000]
    got = {r.cp: r.n for r in count_code_points(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    assert got == Counter(ord(c) for t in texts if t for c in t)
    assert count_code_points(spark.createDataFrame([], "t string"), "t").count() == 0


def test_all_pairs_in_blocks_are_all_pairs(spark):
    sources, targets = renders(spark, *((f"s{k}", "F", k, k) for k in range(5))), renders(spark, *((f"t{k}", "G", 100 + k, 3 * k) for k in range(23)))
    whole = {(r.s_ch, r.t_ch) for r in similarity.all_pairs(sources, targets).collect()}
    blocks = [(r.s_ch, r.t_ch) for r in similarity.all_pairs(sources, targets, most=4).collect()]
    assert len(blocks) == 5 * 23 and set(blocks) == whole
    plan = similarity.all_pairs(sources, targets, most=4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    near = [{r.ch for r in similarity.with_near_render(targets, sources, 1, most_rows=n).collect()} for n in (2, 1000)]
    assert near[0] == near[1] and 0 < len(near[0]) < 23
