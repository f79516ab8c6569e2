"""Rendering from TrueType outlines: a rasteriser for the ``draw`` interface of ``renders``.

A glyph's contours are quadratic curves, given as points on and off the curve. They are cut into short lines;
for each of ``LINES`` sample lines a pixel row, crossings in order with their direction give the stretches inside
(non-zero winding), and each pixel takes the exact share of every stretch. Sizes and places are those of the
interface: 48 pixels an em, centred by advance width, the middle between ascent and descent at half height.

Fonts with other outlines (CFF) draw nothing. Font files are read where the task runs: ``ship`` sends them there.
"""

from __future__ import annotations

import os
import struct
from functools import lru_cache

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ..functions.pixels import WHITE
from .fonts import character_map

#: Fixed value: pixels an em, on the canvas of a character and of a sequence.
SIZE = 48
LINES, STEPS = 8, 6
#: Bits of a component's flags in a composed glyph.
WORDS, PLACES, SCALED, MORE, TWO_SCALES, MATRIX = 1, 2, 8, 32, 64, 128
#: Font files that are sent to executors at most.
MOST_FONTS = 2000


class Face:
    """The first face of a TrueType file."""

    def __init__(self, data: bytes):
        self.data = data
        base = struct.unpack_from(">I", data, 12)[0] if data[:4] == b"ttcf" else 0
        self.tables = {data[at : at + 4]: struct.unpack_from(">I", data, at + 8)[0] for at in range(base + 12, base + 12 + 16 * struct.unpack_from(">H", data, base + 4)[0], 16)}
        head, hhea = self.tables[b"head"], self.tables[b"hhea"]
        self.em = struct.unpack_from(">H", data, head + 18)[0]
        self.long = struct.unpack_from(">h", data, head + 50)[0] != 0
        self.ascent, self.descent = struct.unpack_from(">hh", data, hhea + 4)
        self.metrics = struct.unpack_from(">H", data, hhea + 34)[0]
        self.glyphs = dict(character_map(data)) if b"glyf" in self.tables else {}

    def advance(self, glyph: int) -> int:
        return struct.unpack_from(">H", self.data, self.tables[b"hmtx"] + 4 * min(glyph, self.metrics - 1))[0]

    def contours(self, glyph: int, depth: int = 0) -> list[np.ndarray]:
        """Closed lines of points (x, y), in units of the em."""
        loca, glyf = self.tables[b"loca"], self.tables[b"glyf"]
        low, high = struct.unpack_from(">II", self.data, loca + 4 * glyph) if self.long else (2 * x for x in struct.unpack_from(">HH", self.data, loca + 2 * glyph))
        if low == high or depth > 8:
            return []
        at = glyf + low
        n = struct.unpack_from(">h", self.data, at)[0]
        return self._simple(at + 10, n) if n >= 0 else self._composed(at + 10, depth)

    def _simple(self, at: int, n: int) -> list[np.ndarray]:
        data = self.data
        ends = struct.unpack_from(f">{n}H", data, at)
        total = ends[-1] + 1 if n else 0
        at += 2 * n
        at += 2 + struct.unpack_from(">H", data, at)[0]  # instructions aren't run
        flags = bytearray()
        while len(flags) < total:
            flag = data[at]
            again = data[at + 1] if flag & 8 else 0
            flags += bytes([flag]) * (1 + again)
            at += 2 if flag & 8 else 1
        axes = []
        for short, same in ((2, 16), (4, 32)):
            value, values = 0, []
            for flag in flags[:total]:
                if flag & short:
                    value += data[at] if flag & same else -data[at]
                    at += 1
                elif not flag & same:
                    value += struct.unpack_from(">h", data, at)[0]
                    at += 2
                values.append(value)
            axes.append(values)
        points = np.array(axes, float).T
        on = np.array([bool(f & 1) for f in flags[:total]], bool)
        cuts = [0, *(e + 1 for e in ends)]
        return [line for a, b in zip(cuts, cuts[1:], strict=False) if len(line := _flatten(points[a:b], on[a:b])) > 2]

    def _composed(self, at: int, depth: int) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        more = True
        while more:
            flags, glyph = struct.unpack_from(">HH", self.data, at)
            at += 4
            kind = ("hh" if flags & PLACES else "HH") if flags & WORDS else ("bb" if flags & PLACES else "BB")
            dx, dy = struct.unpack_from(f">{kind}", self.data, at)
            at += struct.calcsize(f">{kind}")
            turn = np.eye(2)
            if flags & SCALED:
                turn = turn * (struct.unpack_from(">h", self.data, at)[0] / 16384)
                at += 2
            elif flags & TWO_SCALES:
                turn = np.diag([x / 16384 for x in struct.unpack_from(">hh", self.data, at)])
                at += 4
            elif flags & MATRIX:
                turn = np.array([x / 16384 for x in struct.unpack_from(">hhhh", self.data, at)]).reshape(2, 2)
                at += 8
            # parts that are placed by matching points stay where they are
            shift = np.array([dx, dy], float) if flags & PLACES else np.zeros(2)
            out += [line @ turn + shift for line in self.contours(glyph, depth + 1)]
            more = bool(flags & MORE)
        return out


def _flatten(points: np.ndarray, on: np.ndarray) -> np.ndarray:
    """A contour as a closed line; between two points off the curve lies one on it, halfway."""
    n = len(points)
    if n < 2:
        return points
    whole, kinds = [], []
    for k in range(n):
        whole.append(points[k])
        kinds.append(bool(on[k]))
        if not on[k] and not on[(k + 1) % n]:
            whole.append((points[k] + points[(k + 1) % n]) / 2)
            kinds.append(True)
    start = kinds.index(True) if True in kinds else 0
    whole, kinds = whole[start:] + whole[:start], kinds[start:] + kinds[:start]
    t = np.arange(1, STEPS + 1)[:, None] / STEPS
    line = [whole[0][None]]
    for k in range(1, len(whole) + 1):
        here, known = whole[k % len(whole)], kinds[k % len(whole)]
        if not known:
            continue
        before = whole[k - 1]
        if kinds[k - 1]:
            line.append(here[None])
        else:
            begin = whole[k - 2]
            line.append((1 - t) ** 2 * begin + 2 * t * (1 - t) * before + t**2 * here)
    return np.concatenate(line)


def rasterise(lines: list[np.ndarray], width: int, height: int) -> np.ndarray:
    """Grey rows of the area that closed lines (x to the right, y down, in pixels) hold; black on white."""
    inked = np.zeros((height, width + 2))  # changes of the inked share from pixel to pixel
    if lines:
        begin = np.concatenate(lines)
        end = np.concatenate([np.roll(line, -1, axis=0) for line in lines])
        rise = begin[:, 1] != end[:, 1]
        begin, end = begin[rise], end[rise]
        down = begin[:, 1] < end[:, 1]
        top, bottom = np.where(down[:, None], begin, end), np.where(down[:, None], end, begin)
        y = (np.arange(height * LINES) + 0.5) / LINES
        sample, segment = np.nonzero((top[:, 1] <= y[:, None]) & (y[:, None] < bottom[:, 1]))
        x = top[segment, 0] + (y[sample] - top[segment, 1]) * ((bottom[:, 0] - top[:, 0]) / (bottom[:, 1] - top[:, 1]))[segment]
        order = np.lexsort((x, sample))
        sample, x, wound = sample[order], np.clip(x[order], 0, width), np.cumsum(np.where(down[segment], 1, -1)[order])
        inside = np.flatnonzero(wound != 0)  # windings of a closed line add up to nothing, so none reaches the next sample
        for at, sign in ((inside, 1 / LINES), (inside + 1, -1 / LINES)):
            pixel = np.floor(x[at]).astype(np.int64)
            share = x[at] - pixel
            np.add.at(inked, (sample[at] // LINES, pixel), sign * (1 - share))
            np.add.at(inked, (sample[at] // LINES, pixel + 1), sign * share)
    return np.floor(WHITE * (1 - np.clip(np.cumsum(inked, axis=1)[:, :width], 0, 1)) + 0.5).astype(np.uint8)


@lru_cache(maxsize=64)
def _face(path: str) -> Face | None:
    try:
        with open(path, "rb") as file:
            return Face(file.read())
    except (OSError, struct.error, KeyError, IndexError):  # not a font that can be read: it draws nothing
        return None


class Outlines:
    """``draw`` of ``renders.render`` for families whose files tasks can open: family to path, or to a shipped name."""

    def __init__(self, files: dict[str, str]):
        self.files = files

    def __call__(self, text: str, font: str, width: int, height: int) -> np.ndarray | None:
        name = self.files.get(font)
        if name is None:
            return None
        path = name if os.path.isabs(name) else SparkFiles.get(name)
        face = _face(path)
        glyphs = [face.glyphs.get(ord(c)) for c in text] if face else [None]
        if None in glyphs:
            return None
        scale = SIZE / face.em
        x = width / 2 - sum(map(face.advance, glyphs)) * scale / 2
        y = height / 2 + (face.ascent + face.descent) * scale / 2
        lines = []
        for glyph in glyphs:
            lines += [line * [scale, -scale] + [x, y] for line in face.contours(glyph)]
            x += face.advance(glyph) * scale
        return rasterise(lines, width, height)


def ship(spark: SparkSession, fonts: DataFrame, most: int = MOST_FONTS) -> Outlines:
    """A ``draw`` for the fonts of an inventory (family, path), whose files are sent to all executors.

    An inventory of more than ``most`` fonts is refused: it is sent whole.
    """
    rows = fonts.select("family", "path").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} fonts")
    names = {}
    for number, (family, path) in enumerate(sorted(map(tuple, rows))):
        if spark.sparkContext.master.startswith("local["):
            names[family] = path  # tasks see the driver's files
        else:
            spark.sparkContext.addFile(path)
            names[family] = os.path.basename(path)
    return Outlines(names)
