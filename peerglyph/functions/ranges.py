"""Labelled code point ranges and their lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ranges without look-alikes of Latin letters; the first that holds a code point names it.
EXCLUDED = (
    (0x3400, 0x4DBF, "CJK Extension A"), (0x4E00, 0x9FFF, "CJK Unified Ideographs"), (0xF900, 0xFAFF, "CJK Compatibility Ideographs"), (0x20000, 0x2A6DF, "CJK Extension B"),
    (0x2A700, 0x2B73F, "CJK Extension C"), (0x2B740, 0x2B81F, "CJK Extension D"), (0x2B820, 0x2CEA1, "CJK Extension E"), (0x2CEB0, 0x2EBE0, "CJK Extension F"),
    (0x30000, 0x3134A, "CJK Extension G"), (0x31350, 0x323AF, "CJK Extension H"), (0x2F800, 0x2FA1F, "CJK Compat Ideographs Supplement"), (0x2EBF0, 0x2F7FF, "CJK Extension I"),
    (0xAC00, 0xD7AF, "Hangul Syllables"), (0x1100, 0x11FF, "Hangul Jamo"), (0x3130, 0x318F, "Hangul Compatibility Jamo"), (0xA960, 0xA97F, "Hangul Jamo Extended-A"),
    (0xD7B0, 0xD7FF, "Hangul Jamo Extended-B"), (0xA000, 0xA4CF, "Yi Syllables + Radicals"), (0x17000, 0x187FF, "Tangut + Components"), (0x18800, 0x18AFF, "Tangut Components/Supplement"),
    (0x18D00, 0x18D7F, "Tangut Supplement"), (0x13000, 0x1345F, "Egyptian Hieroglyphs + Format Controls"), (0x12000, 0x1254F, "Cuneiform + Numbers and Punctuation"),
    (0x14400, 0x1467F, "Anatolian Hieroglyphs"), (0x1B170, 0x1B2FF, "Nushu"), (0x18B00, 0x18CFF, "Khitan Small Script"), (0x1AFF0, 0x1B16F, "Katakana Extended + Kana Supplement/Extended-A/B"),
    (0x31C0, 0x31EF, "CJK Strokes"), (0x2E80, 0x2FDF, "CJK Radicals"), (0x3000, 0x312F, "CJK Symbols, Hiragana, Katakana (base)"), (0x31F0, 0x31FF, "Katakana Phonetic Extensions"),
    (0xFF65, 0xFFDC, "Halfwidth Katakana/Hangul"),
)

# Blocks by which a candidate is given a script; the first that holds a code point names it.
BLOCK_SCRIPTS = (
    (0x0370, 0x03FF, "Greek"), (0x0400, 0x04FF, "Cyrillic"), (0x0500, 0x052F, "Cyrillic Supplement"), (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"),
    (0x0700, 0x074F, "Syriac"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B00, 0x0B7F, "Oriya"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0D80, 0x0DFF, "Sinhala"), (0x0E00, 0x0E7F, "Thai"),
    (0x0E80, 0x0EFF, "Lao"), (0x0F00, 0x0FFF, "Tibetan"), (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul Jamo"), (0x1200, 0x137F, "Ethiopic"),
    (0x13A0, 0x13FF, "Cherokee"), (0x1400, 0x167F, "Canadian Aboriginal"), (0x1680, 0x169F, "Ogham"), (0x16A0, 0x16FF, "Runic"), (0x1780, 0x17FF, "Khmer"), (0x1800, 0x18AF, "Mongolian"),
    (0x2C00, 0x2C5F, "Glagolitic"), (0x2C60, 0x2C7F, "Latin Extended-C"), (0x2C80, 0x2CFF, "Coptic"), (0x2D00, 0x2D2F, "Georgian Supplement"), (0x2D30, 0x2D7F, "Tifinagh"),
    (0xA640, 0xA69F, "Cyrillic Extended-B"), (0xA720, 0xA7FF, "Latin Extended-D"), (0xA800, 0xA82F, "Syloti Nagri"), (0xA840, 0xA87F, "Phags-pa"), (0xAB00, 0xAB2F, "Ethiopic Extended-A"),
    (0xAB70, 0xABBF, "Cherokee Supplement"), (0xAC00, 0xD7AF, "Hangul Syllables"), (0xFB50, 0xFDFF, "Arabic Presentation Forms-A"), (0xFE70, 0xFEFF, "Arabic Presentation Forms-B"),
    (0xFF00, 0xFFEF, "Halfwidth and Fullwidth Forms"), (0x10000, 0x1007F, "Linear B Syllabary"), (0x10080, 0x100FF, "Linear B Ideograms"), (0x10300, 0x1032F, "Old Italic"),
    (0x10330, 0x1034F, "Gothic"), (0x10400, 0x1044F, "Deseret"), (0x10800, 0x1083F, "Cypriot"), (0x10900, 0x1091F, "Phoenician"), (0x10920, 0x1093F, "Lydian"), (0x10A00, 0x10A5F, "Kharoshthi"),
    (0x1D400, 0x1D7FF, "Mathematical Alphanumeric Symbols"), (0x1F100, 0x1F1FF, "Enclosed Alphanumeric Supplement"), (0x0000, 0x007F, "Basic Latin"), (0x0080, 0x00FF, "Latin-1 Supplement"),
    (0x0100, 0x024F, "Latin Extended-A/B"), (0x0250, 0x02AF, "IPA Extensions"), (0x1D00, 0x1DBF, "Phonetic Extensions"), (0x1E00, 0x1EFF, "Latin Extended Additional"),
    (0xAB30, 0xAB6F, "Latin Extended-E"),
)
#: What a name holds, if no block does.
NAME_SCRIPTS = (("LATIN", "Latin (other)"), ("GREEK", "Greek (other)"), ("CYRILLIC", "Cyrillic (other)"), ("ARABIC", "Arabic (other)"), ("CHEROKEE", "Cherokee (other)"), ("GEORGIAN", "Georgian (other)"))

# The shorter list of scripts for summaries; Gothic stands behind a range that covers it.
SUMMARY_SCRIPTS = (
    (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0900, 0x0DFF, "Indic"),
    (0x0E00, 0x0EFF, "Thai/Lao"), (0x10A0, 0x10FF, "Georgian"), (0x13A0, 0x13FF, "Cherokee"), (0xAB70, 0xABBF, "Cherokee Supplement"), (0x0100, 0x024F, "Latin Extended"),
    (0x1D00, 0x1DBF, "Phonetic Extensions"), (0x1E00, 0x1EFF, "Latin Extended Additional"), (0xA720, 0xA7FF, "Latin Extended-D"), (0xAB30, 0xAB6F, "Latin Extended-E"), (0x2C00, 0x2C5F, "Glagolitic"),
    (0x2C80, 0x2CFF, "Coptic"), (0x2D30, 0x2D7F, "Tifinagh"), (0x1D400, 0x1D7FF, "Math Alphanumeric"), (0xFF00, 0xFFEF, "Fullwidth Forms"), (0x10400, 0x1044F, "Deseret"),
    (0x10300, 0x1034F, "Old Italic"), (0x10330, 0x1034F, "Gothic"),
)

# Groups of the statistics report.
REPORT_GROUPS = (
    (0x0100, 0x024F, "Latin Extended"), (0x1D00, 0x1DBF, "Latin Extended"), (0xA720, 0xA7FF, "Latin Extended"), (0xAB30, 0xAB6F, "Latin Extended"), (0x0400, 0x052F, "Cyrillic"),
    (0x0370, 0x03FF, "Greek"), (0x1F00, 0x1FFF, "Greek"), (0x13A0, 0x13FF, "Cherokee"), (0xAB70, 0xABBF, "Cherokee"), (0x0600, 0x06FF, "Arabic"), (0xFB50, 0xFDFF, "Arabic"),
    (0xFE70, 0xFEFF, "Arabic"), (0x0590, 0x05FF, "Hebrew"), (0x1D400, 0x1D7FF, "Mathematical Alphanumeric Symbols"), (0x0900, 0x0D7F, "Indic"),
)

# Script families of the cross-script job, in order: Unicode scripts and ranges.
FAMILIES = (
    ("Latin", ("Latin", "Common"), ((0x0041, 0x005A), (0x0061, 0x007A), (0x0030, 0x0039))),
    ("Cyrillic", ("Cyrillic",), ((0x0400, 0x04FF), (0x0500, 0x052F))),
    ("Greek", ("Greek",), ((0x0370, 0x03FF),)),
    ("Arabic", ("Arabic",), ((0x0600, 0x06FF), (0x0750, 0x077F))),
    ("Han", ("Han",), ((0x4E00, 0x9FFF),)),
    ("Hangul", ("Hangul",), ((0x1100, 0x11FF), (0x3131, 0x318E))),
    ("Katakana", ("Katakana",), ((0x30A0, 0x30FF),)),
    ("Hiragana", ("Hiragana",), ((0x3040, 0x309F),)),
    ("Devanagari", ("Devanagari",), ((0x0900, 0x097F),)),
    ("Thai", ("Thai",), ((0x0E00, 0x0E7F),)),
    ("Georgian", ("Georgian",), ((0x10A0, 0x10FF), (0x2D00, 0x2D2F))),
    ("Armenian", ("Armenian",), ((0x0530, 0x058F),)),
)


def first_label(cp: Column, ranges: tuple[tuple[int, int, str], ...], otherwise: Column) -> Column:
    """The label of the first range that holds ``cp``.

    A fixed list of a few dozen ranges is a chain of comparisons inside the generated code; nothing is
    joined or broadcast.
    """
    out = None
    for low, high, label in ranges:
        test = cp.between(low, high)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def excluded_range(cp: Column) -> Column:
    """the label of the excluded range, null if none."""
    return first_label(cp, EXCLUDED, F.lit(None).cast("string"))


def block_script(cp: Column, name: Column) -> Column:
    """by block, else by a word of the character's name, else "Other"."""
    by_name = None
    for word, label in NAME_SCRIPTS:
        test = F.contains(F.coalesce(name, F.lit("")), F.lit(word))
        by_name = F.when(test, label) if by_name is None else by_name.when(test, label)
    return first_label(cp, BLOCK_SCRIPTS, by_name.otherwise("Other"))


def summary_script(cp: Column) -> Column:
    """F07."""
    return first_label(cp, SUMMARY_SCRIPTS, F.lit("Other"))


def report_group(cp: Column) -> Column:
    """F08."""
    return first_label(cp, REPORT_GROUPS, F.when(cp > 0xFFFF, "Other SMP").otherwise("Other BMP"))


def range_table(spark: SparkSession, ranges: tuple[tuple[int, int, str], ...]) -> DataFrame:
    """Ranges as a table (ord, lo, hi, label), for joins with ranges that aren't known beforehand."""
    rows = ", ".join(f"({k}, {low}, {high}, '{label}')" for k, (low, high, label) in enumerate(ranges))
    return spark.sql(f"select * from values {rows} as t(ord, lo, hi, label)")


def range_join(points: DataFrame, ranges: DataFrame, bucket_bits: int = 8) -> DataFrame:
    """Every (cp row, range row) with lo <= cp <= hi, without the range's ends.

    Both sides are cut into buckets of 2**bucket_bits code points and joined by equality, so the join
    shuffles or broadcasts as sizes ask and never compares all rows with all ranges.
    """
    width = 1 << bucket_bits
    cut = ranges.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}).withColumn("_bucket", F.explode(F.sequence((F.col("_lo") / width).cast("int"), (F.col("_hi") / width).cast("int"))))
    return points.withColumn("_bucket", (F.col("cp") / width).cast("int")).join(cut, "_bucket").where("cp between _lo and _hi").drop("_bucket", "_lo", "_hi")


def first_range(points: DataFrame, ranges: DataFrame, key: str = "cp") -> DataFrame:
    """Each code point with its first range's label, null if none; ``ranges`` has ord, lo, hi, label."""
    found = range_join(points.select(key).distinct(), ranges).groupBy(key).agg(F.min_by("label", "ord").alias("label"))
    return points.join(found, key, "left")


def families(spark: SparkSession) -> DataFrame:
    """Script families as a table: ord, family, script, lo, hi."""
    rows = ", ".join(f"({k}, '{name}', '{script}', {low}, {high})" for k, (name, scripts, ranges) in enumerate(FAMILIES) for script in scripts for low, high in ranges)
    return spark.sql(f"select * from values {rows} as t(ord, family, script, lo, hi)")
