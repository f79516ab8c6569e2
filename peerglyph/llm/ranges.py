"""Byte ranges of files as units of work.

A file is cut into units of (path, size, low, high) that are dealt to tasks; a task opens the file and reads
what it needs, so that neither a task's memory nor the longest task grows with a file. Files are opened
through Arrow's file systems. In a store that only Spark's readers can open, a file's bytes come from the
binary source instead, whole, and then a file is the unit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes read at once, and tasks that units are dealt to at most.
READ, MOST_TASKS = 1 << 20, 20_000


def open_file(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path[len("file:") :].lstrip("/"))
    store, place = pafs.FileSystem.from_uri(quote(path, safe=":/"))
    return store.open_input_file(place)


class View:
    """A file's bytes by place, read in stretches of which the last one is kept."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size = file, size
        self.at, self.held = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """The bytes at [at, at + n), fewer where the file ends."""
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.file.read_at(min(max(n, READ), self.size - at), at)
        return self.held[at - self.at : at - self.at + n]

    def find(self, sign: re.Pattern[bytes], at: int, stop: int, longest: int) -> int | None:
        """Where the next ``sign`` of at most ``longest`` bytes begins in [at, stop)."""
        while at < min(stop, self.size):
            part = self.get(at, READ)
            if m := sign.search(part):
                return at + m.start() if at + m.start() < stop else None
            at += max(1, len(part) - longest + 1)
        return None

    def release(self, at: int) -> None:
        """Nothing before ``at`` is asked for again."""


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and size of the files; their content isn't read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))


def units(listed: DataFrame, unit_bytes: int) -> DataFrame:
    """The units of files (path, size), ``unit_bytes`` each but for the last ones."""
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(unit_bytes).cast("long"))
    return listed.select("path", "size", F.explode(cuts).alias("low")).withColumn("high", F.least(F.col("size"), F.col("low") + unit_bytes))


def deal(rows: DataFrame, n: int) -> DataFrame:
    """Units, ``n`` of them, over as many tasks."""
    return rows.repartition(max(1, min(n, MOST_TASKS)), "path", "low")


def readable(listed: DataFrame) -> bool:
    """Whether Python can open the files, tried on one of them."""
    one = listed.first()
    if one is None:
        return True
    try:
        with open_file(one.path) as file:
            file.read_at(1, 0)
        return True
    except (OSError, ValueError, NotImplementedError):  # what Arrow raises for stores and schemes it doesn't know
        return False


def map_units(spark: SparkSession, dealt: DataFrame, work: Callable[[View, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` of each unit, given a view of its file and the unit's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as file:
                    yield from work(View(file, row["size"]), row)

    return dealt.mapInArrow(run, schema)


def map_files(spark: SparkSession, path: str, work: Callable[[View, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` of whole files, whose bytes Spark reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer() or pa.py_buffer(b"")
                yield from work(View(pa.BufferReader(data), data.size), {"path": name, "size": data.size, "low": 0, "high": data.size})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
