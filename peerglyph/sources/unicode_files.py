"""Parsers of the Unicode Character Database's text files, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codepoints import from_hex, is_basic_latin, to_u_plus


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def parse_unicode_data(lines: DataFrame) -> DataFrame:
    """Letters and numbers as ranges (lo, hi, name, gc); a line for each ``value``.

    The two lines of a range carry the same name but for "First" and "Last", so they meet by that name;
    the order of lines doesn't matter.
    """
    f = F.split("value", ";")
    rows = lines.where(F.size(f) > 2).select(from_hex(F.trim(f[0])).alias("cp"), f[1].alias("label"), f[2].alias("gc")).where("cp is not null and substring(gc, 1, 1) in ('L', 'N')")
    edge = F.regexp_extract("label", "^<(.*), (First|Last)>$", 2)
    name = F.when(edge != "", F.regexp_extract("label", "^<(.*), (First|Last)>$", 1)).otherwise(F.col("label"))
    marked = rows.select("cp", "gc", name.alias("name"), (edge != "").alias("ranged"))
    ranges = marked.where("ranged").groupBy("name", "gc").agg(F.min("cp").alias("lo"), F.max("cp").alias("hi")).select("lo", "hi", "name", "gc")
    return marked.where("not ranged").select(F.col("cp").alias("lo"), F.col("cp").alias("hi"), "name", "gc").unionByName(ranges)


def read_unicode_data(spark: SparkSession, path: str) -> DataFrame:
    return parse_unicode_data(_lines(spark, path))


def expand(ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """One row for each code point of a range."""
    return ranges.select(F.explode(F.sequence(lo, hi)).alias("cp"), *(c for c in ranges.columns if c not in (lo, hi)))


def _ranged(lines: DataFrame) -> tuple[DataFrame, Column]:
    """Lines "LO[..HI] ; field ; ..." without comments: lo, hi and the fields."""
    body = F.regexp_replace(F.split("value", "#")[0], r"^\s+|\s+$", "")
    f = F.split(body, r"\s*;\s*")
    edges = F.split(f[0], r"\.\.")
    low = from_hex(F.trim(edges[0]))
    rows = lines.where((F.length(body) > 0) & (F.size(f) > 1)).select(low.alias("lo"), F.coalesce(from_hex(F.trim(F.get(edges, F.lit(1)))), low).alias("hi"), F.transform(f, lambda x: F.trim(x)).alias("f"))
    return rows.where("lo is not null"), F.col("f")


def parse_scripts(lines: DataFrame) -> DataFrame:
    """Lo, hi, script."""
    rows, f = _ranged(lines)
    return rows.select("lo", "hi", f[1].alias("script"))


def parse_property(lines: DataFrame, name: str) -> DataFrame:
    """The ranges of one property value."""
    rows, f = _ranged(lines)
    return rows.where(f[1] == name).select("lo", "hi")


def parse_idna(lines: DataFrame) -> DataFrame:
    """Ranges whose status is exactly "valid", whatever fields follow."""
    rows, f = _ranged(lines)
    return rows.where(f[1] == "valid").select("lo", "hi")


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    return parse_scripts(_lines(spark, path))


def read_property(spark: SparkSession, path: str, name: str) -> DataFrame:
    return parse_property(_lines(spark, path), name)


def read_idna(spark: SparkSession, path: str) -> DataFrame:
    return parse_idna(_lines(spark, path))


def parse_confusables(lines: DataFrame) -> DataFrame:
    """Every mapping line with the reason why it is left out, null if it is a pair.

    Columns: cp, target (lower case), reason.
    """
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    f = F.split(line, r"\s*;\s*")
    hexes = F.split(f[1], r"\s+")
    rows = lines.where(~line.startswith("#") & (F.size(f) > 1)).select(from_hex(f[0]).alias("cp"), hexes.alias("hexes"), from_hex(hexes[0]).alias("target_cp")).where("cp is not null")
    # single-character targets that fold to ASCII are ASCII themselves, but for the Kelvin sign
    target = F.when(F.col("target_cp") == 0x212A, "k").when(is_basic_latin(F.col("target_cp")), F.lower(F.chr("target_cp")))
    reason = F.when(is_basic_latin(F.col("cp")), "basic latin source").when(F.size("hexes") != 1, "several target characters").when(target.isNull(), "target not a-z or 0-9")
    return rows.select("cp", target.alias("target"), reason.alias("reason"))


def confusable_pairs(lines: DataFrame) -> DataFrame:
    """The pairs, by code point."""
    return parse_confusables(lines).where("reason is null").select(to_u_plus(F.col("cp")).alias("source_cp"), "cp", "target").orderBy("cp")


def read_confusables(spark: SparkSession, path: str) -> DataFrame:
    return parse_confusables(_lines(spark, path))


def characters_of(rows: DataFrame, cp: str = "cp", name: str = "ch") -> DataFrame:
    """The character of each code point, by decoding UTF-32: any plane, and no Python."""
    return rows.withColumn(name, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))
