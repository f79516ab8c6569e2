"""Whole jobs on generated bitmaps and small files."""

import json

import pytest
from pyspark.sql import functions as F

from peerglyph.__main__ import main
from peerglyph.operators import summaries
from peerglyph.operators import weights as wt
from peerglyph.plans import jobs
from peerglyph.sources.renders import SEQUENCE_CANVAS, bitmap, render
from peerglyph.functions.pixels import measure


@pytest.fixture(scope="module")
def index(spark):
    def draw(text, font, width, height):
        """Cyrillic a, e and o look like their Latin twins; other characters are on their own."""
        twins = {"а": "a", "е": "e", "о": "o"}
        return bitmap("".join(twins.get(c, c) for c in text), font, width, height)

    chars = spark.createDataFrame([(ord(c),) for c in "aeoxаеож"], "cp int")
    fonts = spark.createDataFrame([("A", "standard"), ("B", "standard"), ("N", "noto")], "family string, category string")
    cover = chars.crossJoin(fonts.select("family")).where(~((F.col("family") == "B") & (F.col("cp") == 0x43E)) & (F.col("cp") != 0x436))
    fallback = spark.createDataFrame([("Z", "symbol")], "family string, category string")
    return jobs.build_index(chars, cover, fonts, fallback, draw).cache()


def test_index_has_covering_fonts_else_the_fallback(index):
    rows = {(r.ch, r.font): r for r in index.collect()}
    assert ("о", "B") not in rows and rows[("ж", "Z")].fallback_font == "Z" and ("ж", "A") not in rows
    assert all(r.width == r.height == 48 and r.ink_w > 0 for r in rows.values())
    assert len({r.ord for r in rows.values()}) == len(rows) == 7 * 3 - 1 + 1


def test_given_pairs(spark, index):
    pairs = spark.createDataFrame([("а", "a"), ("е", "e"), ("ж", "x"), ("а", "x")], "source string, target string")
    facts = jobs.score_pairs(pairs, index).cache()
    scores = {(r.source, r.target): r for r in summaries.pair_summary(facts).collect()}
    same = facts.where("source_font = target_font and source = 'а' and target = 'a'").collect()
    assert len(same) == 2 and all(r.ssim == pytest.approx(1) for r in same)
    assert scores[("а", "a")].valid_fonts == 4 and scores[("а", "x")].mean_ssim < 0.9
    assert summaries.discoveries(facts, identical=True).where("source = 'а' and target = 'a'").count() == 1
    assert set(jobs.report(facts.withColumn("source_cp", F.lit("U+0430")))) >= {"distribution", "median", "top", "groups"}
    assert jobs.report(facts.withColumn("source_cp", F.lit("U+0430")))["groups"].first().group == "Cyrillic"


def test_candidates_scripts_and_verdicts(spark, index, tmp_path):
    cyrillic, latin = index.where("ch in ('а', 'е', 'о')"), index.where("ch in ('a', 'e', 'o', 'x')")
    facts = jobs.score_candidates(cyrillic, latin)
    best = {r.source: r.target for r in summaries.best_comparison(facts.withColumn("ord", F.lit(0)), ("source",)).collect()}
    assert best == {"а": "a", "е": "e", "о": "o"}
    for prefilter in (False, True):
        cross = jobs.score_scripts(cyrillic, latin, prefilter=prefilter).withColumns({"script_a": F.lit("Cyrillic"), "script_b": F.lit("Latin")})
        found = jobs.extract_scripts(cross).collect()
        assert {("а", "a"), ("е", "e"), ("о", "o")} <= {(r.source, r.target) for r in found} and all(r.best_ssim <= 1.000001 for r in found)
    vectors = spark.createDataFrame([("а", "x", "a")], "char string, tr39 string, nfkc string")
    verdict = summaries.vector_verdicts(jobs.divergence(vectors, index)).first()
    assert verdict.verdict == "nfkc" and verdict.valid_fonts == 3
    rows = jobs.extract(facts, f"file://{tmp_path}/x", identical=True)
    assert rows.count() == spark.read.json(f"file://{tmp_path}/x").select(F.explode("fonts")).count() > 0


def test_sequences(spark):
    fonts = spark.createDataFrame([("A",), ("B",)], "font string")
    index = lambda texts, *canvas: measure(render(spark.createDataFrame([(t,) for t in texts], "ch string").crossJoin(fonts), bitmap, *canvas)).withColumns({"ord": F.xxhash64("ch", "font"), "category": F.lit("standard"), "fallback_font": F.lit(None).cast("string")})
    facts = jobs.score_sequences(index(["ab", "cd"], *SEQUENCE_CANVAS), index(["a", "b", "m"]), least=0.0)
    assert facts.columns[:4] == ["source", "target", "source_font", "target_font"]
    assert all(-1 <= r.ssim <= 1 for r in facts.collect())


def test_edges_and_fonts(spark):
    schema = "source string, target string, source_font string, target_font string, ssim double, phash double, status string"
    tr39 = spark.createDataFrame([("а", "a", "F", "F", 0.9, 0.9, "native"), ("а", "a", "G", "F", 0.8, 0.9, "native")], schema)
    novel = spark.createDataFrame([("ж", "x", "F", "F", 0.2, 0.5, "native")], schema)
    cross = spark.createDataFrame([("a", "а", 0.9, 0.8, 2), ("б", "b", 0.75, 0.7, 2)], "source string, target string, best_ssim double, mean_ssim double, valid_fonts long")
    reuse = spark.createDataFrame([("а", "a", True)], "source string, target string, glyph_reuse boolean")
    props = spark.createDataFrame([("а", "a", True, True, False, True)], "source string, target string, " + ", ".join(f"{p} boolean" for p in wt.PROPERTIES))
    edges = jobs.edge_table(tr39, novel, cross, [reuse], [props]).collect()
    assert [(e.source, e.origin, e.in_tr39) for e in edges] == [("а", "tr39", True), ("б", "cross-script", False), ("ж", "novel", False)]
    assert edges[0].glyph_reuse and edges[0].same_max == 0.9 and not edges[2].xid_start and edges[1].cost == 0.3
    table, summary = jobs.font_table({"tr39": tr39, "novel": novel}, [props])
    assert [(r.source, r.ssim) for r in table.collect()] == [("а", 0.9), ("ж", 0.2)]
    assert (summary.first().total_pairs, summary.first().high_risk, summary.first().danger_rate) == (2, 1, 0.5)


def test_excluded_report(spark):
    scores = spark.createDataFrame([("U+4E00", "s", "t", 0.8), ("U+4E01", "s2", "t", None), ("U+AC00", "s3", "t", 0.1)], "source_cp string, source string, target string, mean_ssim double")
    candidates = spark.createDataFrame([(0x4E00,), (0x4E01,), (0x4E02,)], "cp int")
    out = jobs.excluded_report(scores, candidates)
    rows = {r.range: r for r in out["ranges"].collect()}
    assert (rows["CJK Unified Ideographs"].scored, rows["CJK Unified Ideographs"].candidates, rows["Hangul Syllables"].candidates) == (2, 3, 0)
    assert not out["verified"].first().verification_passed


def test_command_line(spark, tmp_path):
    font = lambda s, t, x: {"sourceFont": s, "targetFont": t, "ssim": x, "pHash": 0.5, "sourceRenderStatus": "native", "sourceFallbackFont": None, "ssimSkipped": False}
    pairs = [{"source": "а", "sourceCodepoint": "U+0430", "target": "a", "fonts": [font("Arial", "Arial", 0.9), font("Georgia", "Georgia", 0.75), font("Noto", "Arial", 0.95)]}]
    (tmp_path / "t.json").write_text(json.dumps({"pairs": pairs}))
    (tmp_path / "x.json").write_text(json.dumps({"pairs": [{"charA": "б", "codepointA": "U+0431", "scriptA": "Cyrillic", "charB": "6", "codepointB": "U+0036", "scriptB": "Latin", "bestFont": {"sourceFont": "Arial", "targetFont": "Arial", "ssim": 0.72, "pHash": 0.9}}]}))
    files = ["--tr39", f"file://{tmp_path}/t.json", "--novel", f"file://{tmp_path}/none.json"]
    got = json.loads(main(["aria", "--json", "--cross-script", f"file://{tmp_path}/x.json", *files], spark))
    assert [(r["ssim"], r["origin"]) for r in got["pairs"]] == [(0.95, "tr39"), (0.72, "cross-script")]
    assert main(["--list-fonts", *files], spark).split("\n") == ["Arial", "Georgia", "Noto"]
    assert "more confusable in Arial" in main(["Arial", "--compare", "Georgia", *files], spark)
    with pytest.raises(SystemExit):
        main(files, spark)


def test_scripts_on_the_command_line(spark, index, tmp_path):
    script = F.when(F.col("ch") > "z", "Cyrillic").when(F.col("ch") < "f", "Latin").otherwise("Other")
    index.withColumn("script", script).write.parquet(f"file://{tmp_path}/index")
    given = ["scripts", "--index", f"file://{tmp_path}/index", "--out", f"file://{tmp_path}/out"]
    assert main([*given, "--dry-run"], spark).split("\n") == ["Cyrillic Latin", "Cyrillic Other", "Latin Other"]
    assert main([*given, "--dry-run", "--script", "Other"], spark).split("\n") == ["Cyrillic Other", "Latin Other"]
    assert main([*given, "--pair", "Latin", "Cyrillic"], spark) == "Cyrillic Latin"
    found = spark.read.parquet(f"file://{tmp_path}/out")
    assert {(r.script_a, r.script_b) for r in found.collect()} == {("Cyrillic", "Latin")} and found.where("source = 'а' and target = 'a'").count()
    assert main([*given, "--dry-run"], spark).split("\n") == ["Cyrillic Other", "Latin Other"]
    assert main([*given, "--dry-run", "--fresh"], spark).split("\n")[0] == "Cyrillic Latin"
    with pytest.raises(SystemExit):
        main(["--list-fonts"], spark)


def test_runs_on_the_command_line(spark, tmp_path):
    (tmp_path / "r" / "m1").mkdir(parents=True)
    for run in (1, 2):
        (tmp_path / f"r/m1/run-{run}.json").write_text(json.dumps({"model": "m1", "variant": "clean", "run": run, "content": "text", "error": None}))
    (tmp_path / "v").mkdir()
    for name in ("a-clean.txt", "a-flood.txt", "b-clean.txt"):
        (tmp_path / "v" / name).write_text("x")
    given = ["runs", "--results", f"file://{tmp_path}/r", "--variants", f"file://{tmp_path}/v", "--times", "2"]
    assert main([*given, "--models", "m2"], spark).split("\n") == ["m1 flood 1", "m1 flood 2", "m2 clean 1", "m2 clean 2", "m2 flood 1", "m2 flood 2"]
    assert main([*given, "--models", "m2", "--suite", "b", "--model", "2"], spark).split("\n") == ["m2 clean 1", "m2 clean 2"]
    (tmp_path / "s.jsonl").write_text(json.dumps({"model": "m1", "variant": "clean", "run": 1}) + "\n")
    scored = ["unscored", "--results", f"file://{tmp_path}/r", "--scores", f"file://{tmp_path}/s.jsonl"]
    assert main(scored, spark) == "m1 clean 2" and main([*scored, "--rescore"], spark) == "m1 clean 1\nm1 clean 2"
