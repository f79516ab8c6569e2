"""Font inventory: discovery on the driver's machine, everything after that as tables."""

from __future__ import annotations

import struct
import subprocess
import warnings
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import font_category, noto_family, path_badness

#: Where system fonts may lie.
SYSTEM_FOLDERS = ("/System/Library/Fonts/", "/Library/Fonts/")


def list_fonts(spark: SparkSession, pattern: str = ":charset=61-7A") -> DataFrame:
    """Family and path of fonts that fontconfig finds; empty, with a warning, where there is no fontconfig."""
    try:
        said = subprocess.run(["fc-list", pattern, "family", "file"], capture_output=True, text=True, timeout=60, check=True).stdout
    except FileNotFoundError:
        warnings.warn("no fontconfig here: the inventory of fonts is empty", stacklevel=2)
        said = ""
    rows = [(family.split(",")[0].strip(), path.strip()) for path, colon, family in (line.partition(":") for line in said.splitlines()) if colon]
    return spark.createDataFrame(rows, "family string, path string")


def list_folder(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Font files of folders, in order: ord, filename, path."""
    for folder in folders:
        if not Path(folder).is_dir():
            warnings.warn(f"no folder {folder}: none of its fonts are listed", stacklevel=2)
    files = [p for d in folders if Path(d).is_dir() for p in sorted(Path(d).iterdir())]
    return spark.createDataFrame([(k, p.name, str(p)) for k, p in enumerate(files)], "ord int, filename string, path string")


def system_fonts(found: DataFrame, folders: tuple[str, ...] = SYSTEM_FOLDERS) -> DataFrame:
    """One path for each family, one family for each collection: family, path, category.

    A family's path is the least bad one; of families that share a collection, the shortest name is kept.
    """
    inside = None
    for folder in folders:
        test = F.col("path").startswith(folder)
        inside = test if inside is None else inside | test
    known = found.where(inside if inside is not None else F.lit(True)).withColumn("category", font_category(F.col("family"))).where("category is not null")
    best = known.groupBy("family", "category").agg(F.min(F.struct(path_badness(F.col("path")).alias("bad"), F.col("path"))).alias("p")).select("family", "category", F.col("p.path").alias("path"))
    shared = best.where(F.col("path").endswith(".ttc")).groupBy("path").agg(F.min(F.struct(F.length("family").alias("n"), F.col("family"), F.col("category"))).alias("f")).select(F.col("f.family").alias("family"), "path", F.col("f.category").alias("category"))
    return best.where(~F.col("path").endswith(".ttc")).select("family", "path", "category").unionByName(shared)


def installed(spark: SparkSession) -> DataFrame:
    """The fonts of this machine, wherever they lie: family, path, category."""
    return system_fonts(list_fonts(spark), ("/",))


def noto_fonts(files: DataFrame) -> DataFrame:
    """Noto Sans files, the first of a family."""
    chosen = files.where(F.col("filename").startswith("NotoSans") & F.col("filename").rlike(r"(?i)\.(ttf|otf|ttc)$")).withColumn("family", noto_family(F.col("filename")))
    return chosen.groupBy("family").agg(F.min_by("path", "ord").alias("path")).select("family", "path", F.lit("noto").alias("category"))


def merge_fonts(system: DataFrame, noto: DataFrame) -> DataFrame:
    """System fonts, and Noto fonts of families that the system doesn't have."""
    return system.unionByName(noto.join(system, "family", "left_anti"))


def character_map(data: bytes) -> Iterator[tuple[int, int]]:
    """(code point, glyph) of a font's first face, from its cmap tables of formats 4 and 12; glyph 0 is none."""
    base = struct.unpack_from(">I", data, 12)[0] if data[:4] == b"ttcf" else 0
    tables = {data[at : at + 4]: struct.unpack_from(">I", data, at + 8)[0] for at in range(base + 12, base + 12 + 16 * struct.unpack_from(">H", data, base + 4)[0], 16)}
    cmap = tables.get(b"cmap")
    if cmap is None:
        return
    kinds = {}
    for k in range(struct.unpack_from(">H", data, cmap + 2)[0]):
        platform, _, offset = struct.unpack_from(">HHI", data, cmap + 4 + 8 * k)
        if platform in (0, 3):
            kinds[struct.unpack_from(">H", data, cmap + offset)[0]] = cmap + offset
    if 12 in kinds:
        at = kinds[12]
        for k in range(struct.unpack_from(">I", data, at + 12)[0]):
            low, high, glyph = struct.unpack_from(">III", data, at + 16 + 12 * k)
            yield from ((cp, glyph + cp - low) for cp in range(low, high + 1) if glyph + cp - low)
    elif 4 in kinds:
        at = kinds[4]
        n = struct.unpack_from(">H", data, at + 6)[0] // 2
        ends, starts = struct.unpack_from(f">{n}H", data, at + 14), struct.unpack_from(f">{n}H", data, at + 16 + 2 * n)
        deltas, offsets = struct.unpack_from(f">{n}H", data, at + 16 + 4 * n), struct.unpack_from(f">{n}H", data, at + 16 + 6 * n)
        for k in range(n):
            for cp in range(starts[k], ends[k] + 1):
                if cp == 0xFFFF:
                    continue
                glyph = cp
                if offsets[k]:
                    place = at + 16 + 6 * n + 2 * k + offsets[k] + 2 * (cp - starts[k])
                    glyph = struct.unpack_from(">H", data, place)[0] if place + 2 <= len(data) else 0
                    if not glyph:
                        continue
                glyph = (glyph + deltas[k]) & 0xFFFF
                if glyph:
                    yield cp, glyph


def glyph_table(spark: SparkSession, fonts: DataFrame) -> DataFrame:
    """Family, cp and glyph of all fonts (family, path), each file read once.

    Coverage of a code point is then a join with this table, not a question to each font.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for family, content in zip(batch.family, batch.content, strict=True):
                try:
                    rows = list(character_map(bytes(content)))
                except (struct.error, IndexError):  # not a font that can be read: it covers nothing
                    rows = []
                yield pd.DataFrame({"family": family, "cp": [r[0] for r in rows], "glyph": [r[1] for r in rows]}).astype({"cp": "int32", "glyph": "int32"})

    paths = [r.path for r in fonts.select("path").distinct().toLocalIterator()]  # an inventory of files, not data
    if not paths:
        return spark.createDataFrame([], "family string, cp int, glyph int")
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "content")
    return files.join(fonts.select("family", "path"), "path").select("family", "content").mapInPandas(read, "family string, cp int, glyph int")


def coverage(glyphs: DataFrame) -> DataFrame:
    """Families that cover each code point."""
    return glyphs.select("cp", "family").distinct()
