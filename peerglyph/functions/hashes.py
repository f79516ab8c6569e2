"""Average hashes of 8 x 8 renders and their similarity, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_of(pixels: Column) -> Column:
    return F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def bit_string(pixels: Column) -> Column:
    """P17 over 64 pixels: "1" where a pixel is above their mean, first pixel first."""
    mean = sum_of(pixels) / F.size(pixels)
    return F.array_join(F.transform(pixels, lambda x: F.when(x > mean, "1").otherwise("0")), "")


def average_hash(pixels: Column) -> Column:
    """P17 as a 64-bit number, first pixel in the highest bit."""
    return from_bits(bit_string(pixels))


def from_bits(bits: Column) -> Column:
    return F.conv(bits, 2, -10).cast("long")


def from_hex(text: Column) -> Column:
    """16 hex digits to a signed 64-bit number."""
    return F.conv(text, 16, -10).cast("long")


def to_hex(value: Column) -> Column:
    """back to 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    """Set bits of the difference; one machine instruction once compiled."""
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    """One minus the share of bits that differ."""
    return 1.0 - hamming(a, b) / 64.0


def global_ssim(mean_a: Column, var_a: Column, mean_b: Column, var_b: Column, dot_ab: Column, n: int = 64, span: float = 1.0, k1: float = 0.01, k2: float = 0.03) -> Column:
    """P20 with one window over the whole render; means and variances come once for each render."""
    c1, c2 = (k1 * span) ** 2, (k2 * span) ** 2
    cov = dot_ab / n - mean_a * mean_b
    return ((2 * mean_a * mean_b + c1) * (2 * cov + c2)) / ((mean_a * mean_a + mean_b * mean_b + c1) * (var_a + var_b + c2))
