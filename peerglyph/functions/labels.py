"""Font names, categories, paddings and bars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Families with a category of their own, families left out, and beginnings of the names of
# families made for other scripts.
CATEGORY_OVERRIDES = {"STIX Two Math": "math", "STIX Two Text": "math", "STIXGeneral": "math", "Apple Symbols": "symbol"}
EXCLUDED_FAMILIES = ("Webdings", "Wingdings", "Wingdings 2", "Wingdings 3", "Bodoni Ornaments")
SCRIPT_FAMILIES = (
    "Bangla", "Tamil", "Kannada", "Telugu", "Malayalam", "Oriya", "Gurmukhi", "Gujarati", "Devanagari", "Sinhala", "Myanmar", "Khmer", "Lao", "Kohinoor", "Mukta", "Shree", "InaiMathi", "Grantha",
    "Hiragino", "Heiti", "STSong", "Songti", "Apple SD", "AppleGothic", "AppleMyungjo", "Thonburi", "Sathu", "Krungthep", "Silom", "Sukhumvit", "Ayuthaya", "Kefa", "Euphemia", "Plantagenet",
)
WEIGHT_SUFFIXES = ("Regular", "Bold", "Italic", "Light", "Medium", "Thin", "SemiBold", "ExtraBold", "Black", "Blk", "ExtLt")


def font_category(family: Column) -> Column:
    """null for private and ornament families, else math, symbol, noto, script or standard."""
    out = F.when(family.startswith(".") | family.isin(*EXCLUDED_FAMILIES), F.lit(None).cast("string"))
    for name, category in CATEGORY_OVERRIDES.items():
        out = out.when(family == name, category)
    return out.when(family.startswith("Noto"), "noto").when(family.rlike(f"^({'|'.join(SCRIPT_FAMILIES)})"), "script").otherwise("standard")


def noto_family(filename: Column) -> Column:
    """"NotoSansTifinagh-Regular.otf" to "Noto Sans Tifinagh"."""
    stem = F.regexp_replace(filename, r"(?i)\.(ttf|otf|ttc)$", "")
    stem = F.regexp_replace(stem, f"(?i)-({'|'.join(WEIGHT_SUFFIXES)})$", "")
    return F.regexp_replace(stem, "([a-z])([A-Z])", "$1 $2")


def font_matches(family: Column, query: str) -> Column:
    """contains, whatever the case; no wildcards."""
    return F.contains(F.lower(family), F.lit(query.lower()))


def safe_name(text: Column) -> Column:
    """runs of white space become a hyphen."""
    return F.regexp_replace(text, r"\s+", "-")


def pad_right(text: Column, width: int) -> Column:
    """padded, never cut."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def pad_left(text: Column, width: int) -> Column:
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def display_order(text: Column) -> Column:
    """sort key for names as people order them."""
    return F.collate(text, "UNICODE")


def path_badness(path: Column) -> Column:
    """a bold or italic file is worse than a collection, and that worse than a plain file."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike("(?i)bold|italic"), 2).otherwise(0) + F.when(path.endswith(".ttc"), 1).otherwise(0)


def fallback_badness(path: Column) -> Column:
    """supplemental fonts are the last to be tried, system fonts the second last."""
    return F.when(F.contains(path, F.lit("/Supplemental/")), 2).when(path.startswith("/System/"), 1).otherwise(0)


def bar(n: Column, per: int = 5) -> Column:
    """a "#" for each ``per`` counted."""
    return F.repeat(F.lit("#"), F.ceil(n / per).cast("int"))
