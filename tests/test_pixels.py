"""Pixel kernels against what follows from their definitions and against slow versions."""

import zlib
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peerglyph.functions import pixels as px
from peerglyph.sources import renders as rd


def canvas(*boxes, side=64):
    out = np.full((side, side), 255, np.uint8)
    for top, left, height, width in boxes:
        out[top : top + height, left : left + width] = 0
    return out


BAR, SHIFTED, DOT, BLANK = canvas((10, 30, 40, 4)), canvas((14, 33, 40, 4)), canvas((30, 30, 2, 2)), canvas()


def slow_ssim(a, b, window):
    values = []
    for y in range(a.shape[0] - window + 1):
        for x in range(a.shape[1] - window + 1):
            p, q = a[y : y + window, x : x + window].astype(float), b[y : y + window, x : x + window].astype(float)
            c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
            cov = ((p - p.mean()) * (q - q.mean())).mean()
            values.append((2 * p.mean() * q.mean() + c1) * (2 * cov + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (p.var() + q.var() + c2)))
    return np.mean(values)


def test_ssim_of_equal_renders_is_one_and_it_is_symmetric():
    a, b = px.normalise(BAR)[None], px.normalise(canvas((10, 10, 30, 12)))[None]
    assert px.ssim(a, a)[0] == pytest.approx(1)
    assert px.ssim(a, b)[0] == pytest.approx(px.ssim(b, a)[0])


@pytest.mark.parametrize("window", [7, 11])
def test_ssim_is_that_of_a_slow_version(window):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (2, 24, 24)).astype(np.uint8)
    assert px.ssim(a[None], b[None], window)[0] == pytest.approx(slow_ssim(a, b, window), abs=1e-6)


def test_ink_bounds_and_coverage():
    assert px.ink_bounds(np.stack([BAR, BLANK, DOT])).tolist() == [[10, 49, 30, 33], [-1, -1, -1, -1], [30, 31, 30, 31]]
    assert px.ink_coverage(np.stack([BAR, BLANK])).tolist() == [160 / 4096, 0]
    faint = BLANK.copy()
    faint[0, 0] = 245
    assert px.ink_bounds(faint[None])[0, 0] == -1  # 245 is no ink, 244 is
    faint[0, 0] = 244
    assert px.ink_bounds(faint[None])[0, 0] == 0


def test_placeholder_boxes():
    box = canvas((10, 10, 20, 20))
    box[12:28, 12:28] = 255
    assert px.is_placeholder_box(box)
    assert not px.is_placeholder_box(canvas((10, 10, 14, 14)))  # too small
    assert not px.is_placeholder_box(BAR) and not px.is_placeholder_box(BLANK)
    cross = canvas((10, 20, 30, 4), (22, 10, 4, 30))
    assert not px.is_placeholder_box(cross)


@given(st.integers(1, 40), st.integers(1, 60))
@settings(deadline=None, max_examples=50)
def test_resize_weights_sum_to_one(src, dst):
    assert np.allclose(px.resize_weights(src, dst).sum(axis=1), 1)


def test_resize_by_hand():
    # four to three: centres at 1/6, 1.5 and 2 5/6
    w = px.resize_weights(4, 3)
    t = 1 / 6
    near = [float(px.catmull_rom(np.float64(t - k))) for k in (-1, 0, 1, 2)]
    assert w[0].tolist() == pytest.approx([near[0] + near[1], near[2], near[3], 0])
    assert w[1].tolist() == pytest.approx([-0.0625, 0.5625, 0.5625, -0.0625])
    assert px.resize(np.array([[0, 0, 255, 255]], np.uint8), 3, 1).tolist()[0][1] == 128
    flat = np.full((5, 7), 93, np.uint8)
    assert (px.resize(flat, 11, 3) == 93).all()


def test_normalised_renders_are_square_and_fill_it():
    out = px.normalise(BAR)
    assert out.shape == (48, 48)
    assert (out < 245).any(axis=1).sum() == 48
    assert (px.normalise(BLANK) == 255).all()


def test_pairs_keep_relative_height():
    a, b = px.normalise_pair(BAR, SHIFTED)
    assert px.ink_bounds(a[None])[0, 0] < px.ink_bounds(b[None])[0, 0]
    assert not np.array_equal(a, b) and np.array_equal(px.normalise(BAR), px.normalise(SHIFTED))
    low = canvas((60, 10, 4, 4))
    assert all(x.shape == (48, 48) for x in px.normalise_pair(low, canvas((0, 10, 4, 30))))
    blank, other = px.normalise_pair(BLANK, BAR)
    assert (blank == 255).all() and np.array_equal(other, px.normalise(BAR))


def test_average_hash():
    left = np.zeros((1, 8, 8), np.uint8)
    left[0, 0, 0] = 255
    assert px.average_hash(left)[0] == -(2**63)  # the first pixel is the highest bit
    assert px.average_hash(np.full((1, 48, 48), 7, np.uint8))[0] == 0
    assert px.average_hash(BAR[None])[0] != px.average_hash(DOT[None])[0]


def test_png_round_trip_and_filters():
    image = np.random.default_rng(2).integers(0, 256, (9, 13)).astype(np.uint8)
    assert np.array_equal(px.decode_png(px.encode_png(image.tobytes(), 13, 9)), image)
    rgba = np.random.default_rng(3).integers(0, 256, (6, 5, 4)).astype(int)
    raw = bytearray()
    for y in range(6):  # each row by another filter, as the format defines them
        kind = y % 5
        raw.append(kind)
        for x in range(5):
            for c in range(4):
                a = rgba[y, x - 1, c] if x else 0
                b = rgba[y - 1, x, c] if y else 0
                d = rgba[y - 1, x - 1, c] if x and y else 0
                p = a + b - d
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d
                raw.append((rgba[y, x, c] - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
    chunk = lambda n, body: struct.pack(">I", len(body)) + n + body + b"\0\0\0\0"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(raw))) + chunk(b"IEND", b"")
    assert np.array_equal(px.decode_png(data), px.luma(rgba))
    with pytest.raises(ValueError):
        px.decode_png(b"no image")


def test_renders_tell_missing_glyphs():
    box = canvas((10, 10, 30, 30))
    box[12:38, 12:38] = 255
    pictures = {"a": BAR, "b": box, "c": DOT, rd.REPLACEMENT: DOT}
    draw = lambda text, font, w, h: pictures.get(text)
    assert rd.drawn("a", "F", draw) is not None
    assert rd.drawn("b", "F", draw) is None and rd.drawn("c", "F", draw) is None and rd.drawn("d", "F", draw) is None
    assert rd.drawn(" ", "F", rd.bitmap) is None


def test_scores_in_batches(spark):
    rows = [(k, a.tobytes(), 64, 64, b.tobytes() if b is not None else None, 64, 64) for k, (a, b) in enumerate([(BAR, BAR), (BAR, SHIFTED), (BAR, DOT), (BAR, None), (BLANK, BAR)])]
    pairs = spark.createDataFrame(rows, "k int, a_pixels binary, a_width int, a_height int, b_pixels binary, b_width int, b_height int")
    got = {r.k: r for r in px.score_pairs(pairs, least_ink=0.03).collect()}
    assert got[0].ssim == pytest.approx(1) and 0 < got[1].ssim < 1
    assert got[3].ssim is None and not got[3].ink_skipped
    assert got[4].ssim is None and got[4].ink_skipped
    assert px.score_pairs(pairs).columns == ["k", "ssim", "ink_skipped"]


def test_measured_renders(spark):
    rows = spark.createDataFrame([("bar", BAR.tobytes(), 64, 64), ("blank", BLANK.tobytes(), 64, 64), ("none", None, 64, 64)], "ch string, pixels binary, width int, height int")
    got = {r.ch: r for r in px.measure(rows).collect()}
    assert (got["bar"].ink_w, got["bar"].ink_h) == (4, 40) and got["blank"].ink_w is None and got["none"].phash is None
    assert px.normalise_renders(rows).where("ch = 'bar'").first().width == 48


def test_stacks_give_what_single_renders_give():
    """Pairs and renders of many sizes at once, against one at a time; blanks among them."""
    rng = np.random.default_rng(12)
    images = []
    for k in range(40):
        h, w = [(64, 64), (64, 128), (32, 40)][k % 3]
        image = np.full((h, w), 255, np.uint8)
        if k % 7:
            y, x = rng.integers(0, h - 8), rng.integers(0, w - 8)
            image[y : y + rng.integers(1, 20), x : x + rng.integers(1, 20)] = rng.integers(0, 200)
        images.append(image)
    a, b = rng.integers(0, 40, 120), rng.integers(0, 40, 120)
    left, right = px.normalise_pairs(images, a, b)
    for k in range(120):
        one, two = px.normalise_pair(images[a[k]], images[b[k]])
        assert (left[k] == one).all() and (right[k] == two).all()
    assert all((x == px.normalise(y)).all() for x, y in zip(px.normalise_all(images), images, strict=True))
