"""Code points, characters and pair keys as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_u_plus(cp: Column) -> Column:
    """1072 to "U+0430"; at least four digits, never cut."""
    digits = F.hex(cp)
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def from_u_plus(text: Column) -> Column:
    """"U+0430" to 1072."""
    return F.conv(F.substring(text, 3, 10), 16, 10).cast("int")


def from_hex(text: Column) -> Column:
    """Hex digits to a number; null if there are other characters."""
    return F.when(text.rlike("^[0-9A-Fa-f]+$"), F.conv(text, 16, 10).cast("int"))


def first_code_point(text: Column) -> Column:
    """the first code point of a text."""
    return F.ascii(text)


def is_basic_latin(cp: Column) -> Column:
    """A-Z, a-z or 0-9."""
    return cp.between(0x41, 0x5A) | cp.between(0x61, 0x7A) | cp.between(0x30, 0x39)


def plane(cp: Column) -> Column:
    """"BMP" or "SMP"."""
    return F.when(cp <= 0xFFFF, "BMP").otherwise("SMP")


def characters(text: Column) -> Column:
    """a text's code points as an array of one-character strings."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def hex_name(text: Column) -> Column:
    """code points in hex, joined by "_"."""
    return F.array_join(F.transform(characters(text), lambda c: F.hex(F.ascii(c))), "_")


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    """a pair's members in one order, whichever way it was given."""
    return F.least(a, b), F.greatest(a, b)


def count_code_points(rows: DataFrame, column: str) -> DataFrame:
    """Every code point of a text column (cp) with how often it occurs (n).

    A task counts its texts in one array over all code points and sends one row for each that it saw;
    exploding texts into characters takes about nine times as long (3.5 s against 0.4 s on sf0.1).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if (value := text.as_py()) is not None:
                    found = np.bincount(np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32))
                    total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["cp", "n"])

    return rows.select(column).mapInArrow(work, "cp int, n long").groupBy("cp").agg(F.sum("n").alias("n"))
