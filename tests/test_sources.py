"""Sources and sinks on small files."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerglyph.functions.pixels import encode_png
from peerglyph.sources import documents, fonts, json_files, renders, schemas, sinks, unicode_files

FONT = {"sourceFont": "A", "targetFont": "A", "ssim": 1, "pHash": 0.5, "sourceRenderStatus": "native", "sourceFallbackFont": None, "ssimSkipped": False}
SUMMARY = {"meanSsim": 0.9, "meanPHash": 0.5, "nativeFontCount": 1, "fallbackFontCount": 0, "notdefFontCount": 0, "validFontCount": 2}
PAIR = {"source": "а", "sourceCodepoint": "U+0430", "target": "a", "fonts": [FONT, FONT | {"targetFont": "B", "ssim": None, "ssimSkipped": True}], "summary": SUMMARY}


def test_documents_with_pairs(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"meta": {"n": 1}, "pairs": [PAIR, PAIR | {"source": "\U00010348"}]}, indent=1))
    rows = json_files.read_pairs(spark, f"file://{tmp_path}/d.json")
    assert [r.source for r in rows.orderBy("source").collect()] == ["а", "\U00010348"]
    assert json_files.read_pairs(spark, f"file://{tmp_path}/none.json").count() == 0
    flat = json_files.flatten(rows)
    assert flat.count() == 4 and flat.where("ssim = 1.0").count() == 2
    again = json_files.nest(flat, ["source", "target"]).where("source = 'а'").first()
    assert [f.targetFont for f in again.fonts] == ["A", "B"] and again.fonts[1].ssimSkipped


def test_arrays_must_be_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"source": "x", "sourceCodepoint": "U+0078", "target": "y"}]))
    assert json_files.read_array(spark, f"file://{tmp_path}/a.json", schemas.PAIRS).first().target == "y"
    (tmp_path / "b.json").write_text("[{broken")
    with pytest.raises(Exception):
        json_files.read_array(spark, f"file://{tmp_path}/b.json", schemas.PAIRS).collect()


def test_pair_lines_in_gzip(spark, tmp_path):
    lines = ['{"meta": {},', '"pairs": [', json.dumps(PAIR) + ",", json.dumps(PAIR | {"target": "b"}), '{"source": "broken", "meanSsim', "]", "}"]
    with gzip.open(tmp_path / "s.json.gz", "wt") as f:
        f.write("\n".join(lines))
    rows = json_files.read_pair_lines(spark, f"file://{tmp_path}/s.json.gz")
    assert sorted(r.target for r in rows.collect()) == ["a", "b"]


def test_progress_keeps_the_last_line_of_a_key(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"seq": "ab", "n": 1}\n{"seq": "cd", "n": 2}\n{"seq": "ab", "n": 3}\n{"seq": "ef", "n')
    rows = json_files.read_progress(spark, f"file://{tmp_path}/p.jsonl", "seq string, n int", ["seq"])
    assert sorted((r.seq, r.n) for r in rows.collect()) == [("ab", 3), ("cd", 2)]


def test_render_index_and_script_sets(spark, tmp_path):
    entry = {"font": "A", "category": "standard", "pHash": "ff00000000000001", "renderStatus": "native", "fallbackFont": None, "png": "src_61_A.png", "inkWidth": 3}
    (tmp_path / "i.json").write_text(json.dumps({"meta": {"x": "1"}, "sources": {"а": [entry]}, "targets": {"a": [entry, entry | {"font": "B"}]}}))
    light = json_files.read_render_index(spark, f"file://{tmp_path}/i.json")
    assert "png" not in light.columns and light.count() == 3
    assert light.where("role = 'source'").first().phash == int("ff00000000000001", 16) - 2**64
    wanted = spark.createDataFrame([("a",)], "ch string")
    assert json_files.only_characters(light, wanted).count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"meta": {}, "scripts": {"Greek": {"description": "", "characterCount": 1, "characters": [{"codepoint": "U+0391", "char": "Α", "name": "ALPHA", "generalCategory": "Lu", "fontCoverage": 2}]}}}))
    assert json_files.script_characters(spark, f"file://{tmp_path}/s.json").first().family == "Greek"


def test_experiment_files(spark, tmp_path):
    base = {"model": "m", "provider": "p", "variant": "v", "run": 1, "usage": {"in": 5}, "content": "text", "error": None}
    (tmp_path / "m" / "v").mkdir(parents=True)
    (tmp_path / "m/v/run-1.json").write_text(json.dumps(base))
    (tmp_path / "m/v/run-2.json").write_text(json.dumps(base | {"run": 2, "content": None, "error": "x"}))
    (tmp_path / "m/v/run-3.json").write_text("{broken")
    assert [r.run for r in documents.read_runs(spark, f"file://{tmp_path}").collect()] == [1]
    (tmp_path / "s.jsonl").write_text(json.dumps({"model": "m", "variant": "v", "run": 1, "detectedAnomalies": True}) + "\n{broken\n")
    assert documents.read_scores(spark, f"file://{tmp_path}/s.jsonl").count() == 1
    (tmp_path / "clean.txt").write_text("a\nb")
    assert documents.read_documents(spark, f"file://{tmp_path}/clean.txt").first() == ("clean.txt", "a\nb")


def test_characters_of_any_plane(spark):
    rows = unicode_files.characters_of(spark.createDataFrame([(0x61,), (0x430,), (0x10348,)], "cp int"))
    assert [r.ch for r in rows.orderBy("cp").collect()] == ["a", "а", "\U00010348"]


def test_images(spark, tmp_path):
    image = np.arange(12, dtype=np.uint8).reshape(3, 4)
    (tmp_path / "a.png").write_bytes(encode_png(image.tobytes(), 4, 3))
    (tmp_path / "b.png").write_bytes(b"broken")
    got = {r.name: r for r in renders.read_images(spark, f"file://{tmp_path}").collect()}
    assert bytes(got["a.png"].pixels) == image.tobytes() and got["b.png"].pixels is None
    named = sinks.image_names(spark.createDataFrame([("а", "My  Font")], "ch string, font string")).first()
    assert named.png == "src_430_My-Font.png"
    encoded = sinks.encode_images(spark.createDataFrame([("x.png", image.tobytes(), 4, 3)], "png string, pixels binary, width int, height int")).first()
    assert bytes(encoded.content) == encode_png(image.tobytes(), 4, 3)


def test_strips_of_renders(spark, tmp_path):
    cell = lambda v: np.full((48, 48), v, np.uint8).tobytes()
    rendered = spark.createDataFrame([("а", "My Font", cell(10)), ("a", "My Font", cell(20)), ("а", "B", cell(30))], "ch string, font string, pixels binary")
    vectors = spark.createDataFrame([("а", "a", "x")], "char string, tr39 string, nfkc string")
    found = {r.png: r for r in sinks.triptychs(vectors, rendered).collect()}
    assert set(found) == {"U430_My-Font.png", "U430_B.png"} and {(r.width, r.height) for r in found.values()} == {(144, 64)}
    image = np.frombuffer(found["U430_My-Font.png"].pixels, np.uint8).reshape(64, 144)
    assert (image[:16] == 255).all() and (image[16:, :48] == 10).all() and (image[16:, 48:96] == 20).all() and (image[16:, 96:] == 255).all()
    assert sinks.write_images(sinks.triptychs(vectors, rendered), f"file://{tmp_path}/strips") == 2
    assert (renders.decode_png((tmp_path / "strips" / "U430_B.png").read_bytes())[16:, :48] == 30).all()


def test_files_are_fetched_once(tmp_path):
    from peerglyph.sources.fetch import ensure_file

    (tmp_path / "there.txt").write_text("one")
    url = f"file://{tmp_path}/there.txt"
    path = ensure_file(url, str(tmp_path / "kept"))
    (tmp_path / "there.txt").write_text("two")
    assert ensure_file(url, str(tmp_path / "kept")) == path and open(path).read() == "one"
    with pytest.raises(OSError):
        ensure_file(f"file://{tmp_path}/none.txt", str(tmp_path / "kept"))
    assert [p.name for p in (tmp_path / "kept").iterdir()] == ["there.txt"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    document = json.loads(sinks.to_document({"x": 1}, rows))
    assert document["meta"] == {"x": 1} and len(document["pairs"]) == 2
    with pytest.raises(ValueError):
        sinks.to_document({}, rows, most=1)
    sinks.write_lines(rows, f"file://{tmp_path}/l")
    sinks.append_lines(rows, f"file://{tmp_path}/j")
    sinks.append_lines(rows, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/l").count() == 2 and spark.read.json(f"file://{tmp_path}/j").count() == 4
    sinks.write_unit(rows, f"file://{tmp_path}/u", ["k"])
    sinks.write_unit(rows.where("k = 'a'").withColumn("n", F.lit(9)), f"file://{tmp_path}/u", ["k"])
    assert sorted((r.k, r.n) for r in documents.read_score_folder(spark, f"file://{tmp_path}/u").collect()) == [("a", 9), ("b", 2)]
    assert sinks.table_lines(rows, {"k": 3, "n": 2})[0] == "k   n "


def test_fonts_of_this_machine(spark):
    found = fonts.list_fonts(spark)
    if not found.count():
        pytest.skip("no fontconfig")
    chosen = fonts.system_fonts(found, ("/",))
    glyphs = fonts.glyph_table(spark, chosen).cache()
    assert glyphs.where("cp = 97").count() == chosen.count() == glyphs.select("family").distinct().count()
    assert glyphs.where("glyph = 0").count() == 0
    assert fonts.coverage(glyphs).where("cp = 97").count() == chosen.count()


def test_character_maps_of_broken_fonts_are_empty():
    assert list(fonts.character_map(b"\0\1\0\0" + b"\0" * 20)) == []
