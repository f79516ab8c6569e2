"""Pixel kernels on grey renders, in numpy, and the table functions that run them in Arrow batches.

A render is rows of bytes, 0 black to 255 white. Kernels take stacks of renders; where sizes differ, as in the
normalisation, those of the same sizes make a stack, and equal work in a batch is done once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIDE = 48
WHITE = 255
INK_THRESHOLD = 10
DARK = 200


def round_half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


# Images to grey


def luma(rgb: np.ndarray) -> np.ndarray:
    """BT.709 luma of (..., 3 or more) channels, rounded; alpha is left aside."""
    return round_half_up(rgb[..., :3].astype(float) @ np.array([0.2126, 0.7152, 0.0722])).astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """An 8-bit PNG without interlacing, as grey pixels."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, width, height, kind = 8, [], 0, 0, 0
    while at < len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlace or kind not in (0, 2, 4, 6):
                raise ValueError("only plain 8-bit images")
        elif name == b"IDAT":
            packed.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, width * channels), np.uint8)
    for y in range(height):
        line, above = raw[y, 1:], out[y]
        match raw[y, 0]:
            case 0:
                out[y + 1] = line
            case 2:
                out[y + 1] = line + above
            case 1:
                out[y + 1] = np.cumsum(line.reshape(width, channels), axis=0, dtype=np.uint8).ravel()
            case mode:
                row, up = out[y + 1], above.tolist()
                for x, v in enumerate(line.tolist()):
                    left = int(row[x - channels]) if x >= channels else 0
                    if mode == 3:
                        guess = (left + up[x]) // 2
                    else:
                        corner = up[x - channels] if x >= channels else 0
                        _, _, guess = min((abs(up[x] - corner), 0, left), (abs(left - corner), 1, up[x]), (abs(left + up[x] - 2 * corner), 2, corner))
                    row[x] = (v + guess) & 255
    pixels = out[1:].reshape(height, width, channels)
    return pixels[..., 0] if kind in (0, 4) else luma(pixels)


def encode_png(pixels: bytes, width: int, height: int) -> bytes:
    """Grey pixels as a PNG."""
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(pixels, np.uint8).reshape(height, width)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


# ink


def ink(stack: np.ndarray, threshold: int = INK_THRESHOLD) -> np.ndarray:
    return stack < WHITE - threshold


def ink_bounds(stack: np.ndarray, threshold: int = INK_THRESHOLD) -> np.ndarray:
    """Top, bottom, left, right of each render's ink, inclusive; all -1 without ink."""
    marks = ink(stack, threshold)
    rows, cols = marks.any(axis=2), marks.any(axis=1)
    h, w = stack.shape[1:]
    out = np.stack([rows.argmax(1), h - 1 - rows[:, ::-1].argmax(1), cols.argmax(1), w - 1 - cols[:, ::-1].argmax(1)], axis=1)
    out[~rows.any(axis=1)] = -1
    return out


def ink_coverage(stack: np.ndarray, threshold: int = INK_THRESHOLD) -> np.ndarray:
    """Share of inked pixels."""
    return ink(stack, threshold).mean(axis=(1, 2))


def is_placeholder_box(pixels: np.ndarray) -> bool:
    """Dark ink whose bounding box is at least 15 wide and high and mostly dark along all four edges."""
    dark = pixels < DARK
    if not dark.any():
        return False
    ys, xs = np.flatnonzero(dark.any(axis=1)), np.flatnonzero(dark.any(axis=0))
    box = dark[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
    if min(box.shape) < 15:
        return False
    return all(edge.mean() > 0.75 for edge in (box[0], box[-1], box[:, 0], box[:, -1]))


# normalisation


def catmull_rom(t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    near, far = ((1.5 * t - 2.5) * t) * t + 1, ((-0.5 * t + 2.5) * t - 4) * t + 2
    return np.where(t <= 1, near, np.where(t <= 2, far, 0.0))


@lru_cache(maxsize=4096)
def resize_weights(src: int, dst: int) -> np.ndarray:
    """The (dst, src) matrix of a one-dimensional resize: centres mapped, edges repeated, rows summing to one."""
    centre = (np.arange(dst) + 0.5) * src / dst - 0.5
    low = np.floor(centre).astype(int)
    out = np.zeros((dst, src))
    for k in (-1, 0, 1, 2):
        np.add.at(out, (np.arange(dst), np.clip(low + k, 0, src - 1)), catmull_rom(centre - low - k))
    return out / out.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Across, then down; rounded and cut to bytes after either."""
    across = np.clip(round_half_up(pixels.astype(float) @ resize_weights(pixels.shape[1], width).T), 0, 255)
    return np.clip(round_half_up(resize_weights(pixels.shape[0], height) @ across), 0, 255).astype(np.uint8)


def crop(pixels: np.ndarray, top: int, left: int, height: int, width: int) -> np.ndarray:
    """A rectangle; rows below the canvas are white."""
    out = np.full((height, width), WHITE, np.uint8)
    part = pixels[top : top + height, left : left + width]
    out[: part.shape[0], : part.shape[1]] = part
    return out


def pad(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Centred on white, an odd remainder to the right and below."""
    h, w = pixels.shape
    out = np.full((side, side), WHITE, np.uint8)
    out[(side - h) // 2 : (side - h) // 2 + h, (side - w) // 2 : (side - w) // 2 + w] = pixels
    return out


def _fit(pixels: np.ndarray, scale: float, side: int) -> np.ndarray:
    h, w = (max(1, int(round_half_up(np.float64(n * scale)))) for n in pixels.shape)
    return pad(resize(pixels, w, h), side)


def normalise(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A render's ink alone, fitted into a square; white if there is none."""
    top, bottom, left, right = ink_bounds(pixels[None])[0].tolist()
    if top < 0:
        return np.full((side, side), WHITE, np.uint8)
    h, w = bottom - top + 1, right - left + 1
    return _fit(crop(pixels, top, left, h, w), min(side / w, side / h), side)


def _boxes(images: list[np.ndarray]) -> np.ndarray:
    """``ink_bounds`` of renders of any size; those of one size are worked on as a stack."""
    out = np.full((len(images), 4), -1)
    by_size: dict[tuple[int, int], list[int]] = {}
    for k, x in enumerate(images):
        by_size.setdefault(x.shape, []).append(k)
    for at in by_size.values():
        out[at] = ink_bounds(np.stack([images[k] for k in at]))
    return out


def _fitted(images: list[np.ndarray], jobs: np.ndarray, side: int) -> np.ndarray:
    """Squares with cut-outs of renders, resized and centred on white.

    A job is (render, top, left, height, width, new height, new width); rows below a canvas are white. Equal jobs are
    done once, and jobs of the same sizes as a stack.
    """
    jobs, which = np.unique(jobs, axis=0, return_inverse=True)
    out = np.full((len(jobs), side, side), WHITE, np.uint8)
    sizes, group = np.unique(jobs[:, 3:], axis=0, return_inverse=True)
    order = np.argsort(group, kind="stable")
    for (h, w, new_h, new_w), at in zip(sizes.tolist(), np.split(order, np.cumsum(np.bincount(group, minlength=len(sizes)))[:-1]), strict=True):
        stack = np.stack([crop(images[k], top, left, h, w) for k, top, left in jobs[at, :3].tolist()]).astype(float)
        across = np.clip(round_half_up(stack @ resize_weights(w, new_w).T), 0, 255)
        down = np.clip(round_half_up(resize_weights(h, new_h) @ across), 0, 255).astype(np.uint8)
        y, x = (side - new_h) // 2, (side - new_w) // 2
        out[at, y : y + new_h, x : x + new_w] = down
    return out[which]


def _new_sizes(sizes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.maximum(1, round_half_up(sizes * scale)).astype(np.int64)


def normalise_all(images: list[np.ndarray], side: int = SIDE) -> np.ndarray:
    """P09, P15 for a list of renders: squares with each render's ink alone; white if there is none."""
    out = np.full((len(images), side, side), WHITE, np.uint8)
    box = _boxes(images)
    have = np.flatnonzero(box[:, 0] >= 0)
    if len(have):
        top, bottom, left, right = box[have].T
        h, w = bottom - top + 1, right - left + 1
        scale = np.minimum(side / w, side / h)
        out[have] = _fitted(images, np.stack([have, top, left, h, w, _new_sizes(h, scale), _new_sizes(w, scale)], axis=1), side)
    return out


def normalise_pairs(images: list[np.ndarray], a: np.ndarray, b: np.ndarray, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """P11 (P10): pairs of renders, given by their places in a list, each on one scale, with their places about the
    canvas middle kept.

    Both are cut to the union of their vertical extents, each to its own horizontal one; the larger of
    all sizes fills the square. A blank render stays white and the other is fitted alone.
    """
    box = _boxes(images)
    sides = np.stack([a, b], axis=1)
    out = np.empty((*sides.shape, side, side), np.uint8)
    both = (box[sides, 0] >= 0).all(axis=1)
    if not both.all():
        alone = normalise_all(images, side)
        out[~both] = alone[sides[~both]]
    pair = sides[both]
    if len(pair):
        heights = np.array([x.shape[0] for x in images])[pair]
        top, bottom, left, right = np.moveaxis(box[pair], 2, 0)
        middle = heights / 2
        high, low = (top - middle).min(axis=1), (bottom - middle).max(axis=1)
        tops = np.maximum(0, np.floor(middle + high[:, None])).astype(np.int64)
        bottoms = np.minimum(heights - 1, np.ceil(middle + low[:, None])).astype(np.int64)
        h = np.repeat((bottoms - tops + 1).max(axis=1)[:, None], 2, axis=1)
        w = right - left + 1
        scale = np.minimum(side / w.max(axis=1), side / h[:, 0])[:, None]
        jobs = np.stack([pair, tops, left, h, w, _new_sizes(h, scale), _new_sizes(w, scale)], axis=2)
        out[both] = _fitted(images, jobs.reshape(-1, 7), side).reshape(len(pair), 2, side, side)
    return out[:, 0], out[:, 1]


def normalise_pair(a: np.ndarray, b: np.ndarray, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """``normalise_pairs`` of one pair."""
    left, right = normalise_pairs([a, b], np.array([0]), np.array([1]), side)
    return left[0], right[0]


# Hashes and similarity


def average_hash(stack: np.ndarray) -> np.ndarray:
    """Renders down to 8 x 8, a bit for each cell above the mean, the first in the highest bit.

    Sides that eight divides are averaged over whole blocks, others resized.
    """
    n, h, w = stack.shape
    if h % 8 == 0 and w % 8 == 0:
        tiny = round_half_up(stack.reshape(n, 8, h // 8, 8, w // 8).mean(axis=(2, 4)))
    else:
        tiny = np.stack([resize(x, 8, 8) for x in stack]).astype(float)
    bits = tiny.reshape(n, 64) > tiny.reshape(n, 64).mean(axis=1, keepdims=True)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def _window_sums(stack: np.ndarray, window: int) -> np.ndarray:
    total = np.zeros((stack.shape[0], stack.shape[1] + 1, stack.shape[2] + 1))
    np.cumsum(np.cumsum(stack, axis=1), axis=2, out=total[:, 1:, 1:])
    return total[:, window:, window:] - total[:, :-window, window:] - total[:, window:, :-window] + total[:, :-window, :-window]


def ssim(a: np.ndarray, b: np.ndarray, window: int = 11, span: float = 255.0, k1: float = 0.01, k2: float = 0.03) -> np.ndarray:
    """Mean structural similarity of two stacks over uniform windows, by summed-area tables."""
    a, b = a.astype(float), b.astype(float)
    n = window * window
    ma, mb = _window_sums(a, window) / n, _window_sums(b, window) / n
    va, vb = _window_sums(a * a, window) / n - ma * ma, _window_sums(b * b, window) / n - mb * mb
    cov = _window_sums(a * b, window) / n - ma * mb
    c1, c2 = (k1 * span) ** 2, (k2 * span) ** 2
    return (((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean(axis=(1, 2))


def _image(pixels: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width)


def _images(batch: pd.DataFrame, name: str = "") -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows of a batch that have a render, and the renders."""
    have = np.flatnonzero(batch[f"{name}pixels"].notna().to_numpy())
    columns = (batch[f"{name}{c}"].to_numpy()[have] for c in ("pixels", "width", "height"))
    return have, [_image(p, int(w), int(h)) for p, w, h in zip(*columns, strict=True)]


def measure(renders: DataFrame) -> DataFrame:
    """Renders (with pixels, width, height) with their hash, ink size, coverage and placeholder flag."""
    columns = renders.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[columns].reset_index(drop=True)
            have, images = _images(batch)
            rows = np.full((len(batch), 5), None, object)
            by_size: dict[tuple[int, int], list[int]] = {}
            for k, x in enumerate(images):
                by_size.setdefault(x.shape, []).append(k)
            for at in by_size.values():
                stack = np.stack([images[k] for k in at])
                box = ink_bounds(stack)
                size = lambda low, high: [high - low + 1 if low >= 0 else None for low, high in zip(low.tolist(), high.tolist(), strict=True)]
                found = (average_hash(stack).tolist(), size(box[:, 2], box[:, 3]), size(box[:, 0], box[:, 1]), ink_coverage(stack).tolist(), [is_placeholder_box(x) for x in stack])
                for column, values in enumerate(found):
                    rows[have[at], column] = values
            yield pd.concat([batch, pd.DataFrame(rows, columns=["phash", "ink_w", "ink_h", "coverage", "placeholder"], dtype=object)], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in renders.schema)
    return renders.mapInPandas(work, f"{fields}, phash long, ink_w int, ink_h int, coverage double, placeholder boolean")


def normalise_renders(renders: DataFrame, side: int = SIDE) -> DataFrame:
    """Renders with pixels normalised to a square."""
    columns = renders.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[columns].copy()
            have, images = _images(batch)
            pixels = np.full(len(batch), None, object)
            for k, x in zip(have.tolist(), normalise_all(images, side) if images else (), strict=True):
                pixels[k] = x.tobytes()
            batch["pixels"] = pixels
            batch["width"] = batch["height"] = side
            yield batch.astype({"width": "int32", "height": "int32"})

    return renders.mapInPandas(work, renders.schema)


def score_pairs(pairs: DataFrame, paired: bool = True, least_ink: float = 0.0, window: int = 11, side: int = SIDE) -> DataFrame:
    """SSIM of each row's two renders (a_pixels, a_width, a_height and b_ likewise), and ink_skipped.

    ``paired`` normalises the two together; otherwise they are taken as they are and must have one size.
    A pair of which either has less ink than ``least_ink`` isn't scored; a missing render gives null. The
    pixel columns are dropped.
    """
    pixel = {f"{s}_{c}" for s in "ab" for c in ("pixels", "width", "height")}
    keep = [c for c in pairs.columns if c not in pixel]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):  # bounds the stacks that are scored at once
                part = batch.iloc[at : at + 1024]
                have = np.flatnonzero((part.a_pixels.notna() & part.b_pixels.notna()).to_numpy())
                value, skipped = np.full(len(part), np.nan), np.zeros(len(part), bool)
                if len(have):
                    a, b = _stacks(part.iloc[have])
                    thin = (ink_coverage(a) < least_ink) | (ink_coverage(b) < least_ink)
                    value[have] = np.where(thin, np.nan, ssim(a, b, min(window, *a.shape[1:])))
                    skipped[have] = thin
                out = part[keep].copy()
                out["ssim"] = pd.Series(value, index=out.index).astype(object).where(~np.isnan(value), None)
                out["ink_skipped"] = skipped
                yield out

    def _stacks(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The renders of either side; one that many rows have is worked on once."""
        known: dict[tuple[bytes, int, int], int] = {}
        places = [np.array([known.setdefault((bytes(p), int(w), int(h)), len(known)) for p, w, h in zip(part[f"{s}_pixels"], part[f"{s}_width"], part[f"{s}_height"], strict=True)]) for s in "ab"]
        images = [_image(*x) for x in known]
        if paired:
            return normalise_pairs(images, *places, side)
        return np.stack([images[k] for k in places[0]]), np.stack([images[k] for k in places[1]])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pairs.schema if f.name not in pixel)
    return pairs.mapInPandas(work, f"{fields}ssim double, ink_skipped boolean")
