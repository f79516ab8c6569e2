"""Renders: where they come from, and the rules that tell a glyph from a missing one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import WHITE, decode_png, is_placeholder_box

CANVAS, FILL = 64, 0.75
SEQUENCE_CANVAS = (128, 64)
#: (text, font, width, height) to rows of grey bytes, None if the font can't draw it.
Draw = Callable[[str, str, int, int], np.ndarray | None]
REPLACEMENT = "�"


def drawn(text: str, font: str, draw: Draw, width: int = CANVAS, height: int = CANVAS, cache: dict | None = None) -> np.ndarray | None:
    """A render, or None if it is blank, the font's replacement character, or a placeholder box."""
    cache = {} if cache is None else cache
    pixels = draw(text, font, width, height)
    if pixels is None or (pixels == WHITE).all():
        return None
    if width != height:
        return pixels  # P02: a sequence is missing only if it is blank
    if (font, width, height) not in cache:
        cache[font, width, height] = draw(REPLACEMENT, font, width, height)
    missing = cache[font, width, height]
    if (missing is not None and text != REPLACEMENT and np.array_equal(pixels, missing)) or is_placeholder_box(pixels):
        return None
    return pixels


def render(jobs: DataFrame, draw: Draw, width: int = CANVAS, height: int = CANVAS) -> DataFrame:
    """Jobs (ch, font and others) with pixels, width, height and status; deal jobs by font before, to draw each
    font's replacement character once a task."""
    columns = jobs.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for batch in batches:
            images = [drawn(c, f, draw, width, height, cache) for c, f in zip(batch.ch, batch.font, strict=True)]
            out = batch[columns].copy()
            out["pixels"] = [None if x is None else x.astype(np.uint8).tobytes() for x in images]
            out["width"], out["height"] = np.int32(width), np.int32(height)
            out["status"] = ["notdef" if x is None else "native" for x in images]
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in jobs.schema)
    return jobs.mapInPandas(work, f"{fields}, pixels binary, width int, height int, status string")


def bitmap(text: str, font: str, width: int = CANVAS, height: int = CANVAS) -> np.ndarray | None:
    """A deterministic stand-in for a rasteriser: strokes whose places come from the text and the font.

    Different fonts shift a character's strokes a little; blanks draw nothing.
    """
    if not text.strip():
        return None
    out = np.full((height, width), WHITE, np.uint8)
    step = min(width, CANVAS) // max(1, len(text))  # a sequence is as wide as a letter
    nudge = sum(map(ord, font)) % 3
    for k, c in enumerate(text):
        rng = np.random.default_rng(ord(c))
        for _ in range(4):
            x, y = rng.integers(8, 40, 2)
            w, h = (int(rng.integers(10, 20)), 3) if rng.random() < 0.5 else (3, int(rng.integers(10, 20)))
            left, top = k * step + int(x) * step // 64 + nudge, int(y) + nudge
            out[top : min(height, top + h), left : min(k * step + step, left + max(1, w * step // 64))] = 0
    return out


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """PNG files of a folder: name, pixels, width, height; a file that is no image has null pixels."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.name, batch.content, strict=True):
                try:
                    image = decode_png(bytes(content))
                    rows.append((name, image.tobytes(), image.shape[1], image.shape[0]))
                except (ValueError, KeyError, IndexError):
                    rows.append((name, None, None, None))
            yield pd.DataFrame(rows, columns=["name", "pixels", "width", "height"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInPandas(work, "name string, pixels binary, width int, height int")


def from_vectors(vectors: DataFrame, characters: int = 50, targets: int = 20) -> DataFrame:
    """Vectors of 64 numbers as 8 x 8 renders: ch, font, ord, standard, phash, mean, var, px, ink_w, ink_h.

    ``vec_id`` gives the character (modulo ``characters``) and the font. What is left and right of the
    brightest row's and column's extremes stands for ink: the places of above-mean pixels.
    """
    from ..functions import hashes

    px = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").alias("ord"), (F.col("vec_id") % characters).cast("int").alias("ch"), F.floor(F.col("vec_id") / characters).cast("int").alias("font"), px.alias("px"))
    total = hashes.sum_of(F.col("px"))
    rows = rows.withColumn("mean", total / 64).withColumn("var", hashes.dot(F.col("px"), F.col("px")) / 64 - F.col("mean") * F.col("mean")).withColumn("bits", hashes.bit_string(F.col("px"))).withColumn("phash", hashes.from_bits(F.col("bits")))
    row_bits = lambda y: F.substring("bits", 8 * y + 1, 8)
    rows_inked = [F.when(F.contains(row_bits(y), F.lit("1")), F.lit(y)) for y in range(8)]
    columns_inked = [F.when(F.substring("bits", x + 1, 1).eqNullSafe("1") | _any_in_column(x), F.lit(x)) for x in range(8)]
    extent = lambda marks: (F.greatest(*marks) - F.least(*marks) + 1).cast("int")
    return rows.withColumn("ink_h", extent(rows_inked)).withColumn("ink_w", extent(columns_inked)).withColumn("standard", F.col("font") % 4 != 3).withColumn("is_target", F.col("ch") < targets)


def _any_in_column(x: int):
    out = None
    for y in range(1, 8):
        test = F.substring("bits", 8 * y + x + 1, 1) == "1"
        out = test if out is None else out | test
    return out
