"""Rounding, ratios, bands and percentiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, MEDIUM = 0.7, 0.3
IDENTICAL = 0.999


def round_half_up(x: Column, places: int = 4) -> Column:
    """halves go toward plus infinity, for negative numbers too."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column) -> Column:
    """into 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def percentile_or_zero(x: Column, p: float) -> Column:
    """F16: exact, interpolated over n - 1 steps; zero without values."""
    return F.coalesce(F.percentile(x, p), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """larger by smaller; null unless both are above zero."""
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))


def ratio_within(a: Column, b: Column, most: float) -> Column:
    """False only if the ratio is known and above ``most``."""
    return F.coalesce(ratio(a, b) <= most, F.lit(True))


def band(x: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    return F.when(x.isNull(), "noData").when(x >= high, "high").when(x >= medium, "medium").otherwise("low")


def percent(part: Column, whole: Column) -> Column:
    """"12.3%", or "0.0%" of nothing."""
    return F.concat(F.format_number(F.when(whole > 0, 100.0 * part / whole).otherwise(0.0), 1), F.lit("%"))


def fixed(x: Column, places: int = 4) -> Column:
    """a number with fixed places, "null" without one."""
    return F.coalesce(F.format_number(x, places), F.lit("null"))
