"""The rasteriser, on figures and on fonts of this machine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerglyph.functions import pixels as px
from peerglyph.plans import jobs
from peerglyph.sources import fonts, outlines, renders
from peerglyph.streaming import incremental


def square(left, top, right, bottom):
    return np.array([[left, top], [right, top], [right, bottom], [left, bottom]], float)


def test_shares_of_pixels_are_exact():
    got = outlines.rasterise([square(1, 2, 3.5, 4.25)], 6, 6)
    want = np.zeros((6, 6))
    want[2:4, 1:3], want[2:4, 3], want[4, 1:3], want[4, 3] = 1, 0.5, 0.25, 0.125
    assert (got == np.floor(255 * (1 - want) + 0.5)).all()


def test_winding_makes_holes_and_joins_overlaps():
    hole = outlines.rasterise([square(0, 0, 6, 6), square(2, 2, 4, 4)[::-1]], 6, 6)
    assert (hole[2:4, 2:4] == 255).all() and (hole == 0).sum() == 32
    both = outlines.rasterise([square(0, 0, 4, 4), square(2, 2, 6, 6)], 6, 6)
    assert (both == 0).sum() == 28
    assert (outlines.rasterise([], 4, 4) == 255).all()
    assert (outlines.rasterise([square(-5, -5, 20, 20)], 4, 4) == 0).all()


def test_curves_are_quadratic():
    # a corner off the curve between two points on it: the curve passes halfway to it
    line = outlines._flatten(np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float), np.array([True, False, True, True]))
    assert np.abs(line - [1.5, 0.5]).sum(axis=1).min() < 1e-9
    ring = outlines._flatten(np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float), np.zeros(4, bool))
    assert any((p == [2, 0]).all() for p in ring) and ring.min() >= 0 and ring.max() <= 4


@pytest.fixture(scope="module")
def machine(spark):
    rows = fonts.installed(spark).where("category = 'standard'")
    cyrillic = fonts.coverage(fonts.glyph_table(spark, rows)).where("cp = 1072").select("family") if rows.count() else rows.select("family")
    rows = rows.join(cyrillic, "family").orderBy("family").limit(3).cache()
    if not rows.count():
        pytest.skip("no fonts here")
    return rows


def test_letters_of_this_machine(spark, machine):
    draw = outlines.ship(spark, machine)
    font = machine.first().family
    a, other = (renders.drawn(c, font, draw) for c in ("a", "x"))
    assert a.shape == (64, 64) and (a != other).any()
    assert any((renders.drawn("a", f.family, draw) == renders.drawn("а", f.family, draw)).all() for f in machine.collect())
    assert renders.drawn(" ", font, draw) is None and renders.drawn("\U0010fff0", font, draw) is None and draw("a", "no such font", 64, 64) is None
    top, bottom, left, right = px.ink_bounds(a[None])[0].tolist()
    assert 20 < (left + right) / 2 < 44 and 20 < (top + bottom) / 2 < 50 and 10 < right - left < 40
    # an accent is composed: it has the letter's ink and more above it
    accented = renders.drawn("é", font, draw)
    assert px.ink_bounds(accented[None])[0, 0] < px.ink_bounds(renders.drawn("e", font, draw)[None])[0, 0]
    wide = renders.drawn("rn", font, draw, *renders.SEQUENCE_CANVAS)
    assert wide.shape == (64, 128)


def test_fonts_that_are_no_fonts_draw_nothing(spark, tmp_path):
    (tmp_path / "x.ttf").write_bytes(b"\0\1\0\0" + b"\0" * 30)
    rows = spark.createDataFrame([("X", str(tmp_path / "x.ttf")), ("Y", str(tmp_path / "none.ttf"))], "family string, path string")
    draw = outlines.ship(spark, rows)
    assert draw("a", "X", 64, 64) is None and draw("a", "Y", 64, 64) is None
    with pytest.raises(ValueError):
        outlines.ship(spark, rows, most=1)


def test_real_look_alikes_are_found(spark, machine):
    draw = outlines.ship(spark, machine)
    points = spark.createDataFrame([(ord(c),) for c in "aceoxpbdhk" + "асеохрбджк"], "cp int")
    index = jobs.build_index(points, fonts.coverage(fonts.glyph_table(spark, machine)), machine, machine.limit(0), draw).cache()
    latin = F.col("ch").between("a", "z")
    cross = jobs.score_scripts(index.where(~latin), index.where(latin)).withColumns({"script_a": F.lit("Cyrillic"), "script_b": F.lit("Latin")})
    found = {(r.source, r.target) for r in jobs.extract_scripts(cross).where("identical").collect()}
    assert {("а", "a"), ("с", "c"), ("е", "e"), ("о", "o"), ("х", "x"), ("р", "p")} <= found and ("ж", "k") not in found


def test_control_sequences_of_the_gate(spark, machine):
    """Of control pairs, "rn" and "m" come out nearer than "cl" and "k" in every font."""
    draw = outlines.ship(spark, machine)
    pairs = [(f.family, s, t) for f in machine.collect() for s, t in (("rn", "m"), ("cl", "k"))]
    rows = []
    for font, s, t in pairs:
        a, b = px.normalise_pair(renders.drawn(s, font, draw, *renders.SEQUENCE_CANVAS), renders.drawn(t, font, draw))
        rows.append((f"{s}/{t}", float(px.ssim(a[None], b[None])[0])))
    summary = spark.createDataFrame(rows, "pair string, ssim double").groupBy("pair").agg(F.avg("ssim").alias("mean_ssim"), F.max("ssim").alias("max_ssim"))
    assert incremental.checked(summary, ["rn/m"], ["cl/k"], high_mean=0.0, high_max=0.1, low_mean=0.3)
    by = {r.pair: r.mean_ssim for r in summary.collect()}
    assert by["rn/m"] > by["cl/k"]


