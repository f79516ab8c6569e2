"""Vectorised words, lines and rolling hashes over Arrow text columns.

A word is a maximal run of bytes outside a set of separator bytes. All separators are ASCII, so the
runs are the same in UTF-8 bytes as in code points. Hashes are polynomial in 64-bit arithmetic, taken
from prefix sums, so that one pass over the bytes serves every word or window.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20  # text that is worked on at once
BATCH_ROWS = 1024
_SPAN = 1 << 18  # bytes hashed at once
_STRETCH = 1 << 20  # bytes or words looked at once

_MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and the bytes of other letters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_rng = np.random.default_rng(20240601)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(x) | 1 for x in _rng.integers(2**62, 2**63, 3, dtype=np.uint64)]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of a base, or of its inverse, modulo 2**64."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        base = pow(_BASES[which], -1, 2**64) if inverse else _BASES[which]
        have = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:  # double the known stretch each time
            have[done : 2 * done] = have[:done] * np.uint64(step)
            done, step = 2 * done, step * step % 2**64
        _powers[which, inverse] = have
    return have[:n]


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    size = int(offs[-1])
    raw = np.frombuffer(data, np.uint8, size) if data is not None and size else np.zeros(0, np.uint8)
    return raw[offs[0] :], offs - offs[0]


def _edges(buf: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in ``buf``, found in stretches so that no array has many bytes a byte."""
    starts, ends, before = [], [], False
    for low in range(0, len(buf), _STRETCH):
        inside = np.empty(min(_STRETCH, len(buf) - low) + 1, np.int8)
        inside[0] = before
        np.logical_not(separators[buf[low : low + _STRETCH]], out=inside[1:], casting="unsafe")
        turn = np.diff(inside)
        starts.append(np.flatnonzero(turn == 1) + low)
        ends.append(np.flatnonzero(turn == -1) + low)
        before = bool(inside[-1])
    if before:
        ends.append(np.array([len(buf)]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends])


def runs(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (one more at the end)."""
    starts, ends = _edges(buf, separators)
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    if len(cuts):  # two rows that touch without a separator
        cuts = np.unique(cuts)
        cuts = cuts[~separators[buf[cuts - 1]] & ~separators[buf[cuts]]]
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans come in order of their starts."""
    return nested_hashes(buf, starts, [ends])[0]


def nested_hashes(buf: np.ndarray, starts: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of several spans from each start, out of one pass over the bytes; the first ends are the farthest.

    A span longer than ``_SPAN`` is summed in pieces.
    """
    sums = [np.empty(len(starts), np.uint64) for _ in ends]
    long = np.flatnonzero(ends[0] - starts > _SPAN)
    for k in long.tolist():
        for total, stops in zip(sums, ends, strict=True):
            total[k] = _long_sum(buf, int(starts[k]), int(stops[k]))
    edges = np.concatenate([[-1], long, [len(starts)]])
    for a, b in zip((edges[:-1] + 1).tolist(), edges[1:].tolist(), strict=True):
        _short_sums(buf, starts, ends, sums, a, b)
    return [mix(h ^ (stops - starts).astype(np.uint64)) for h, stops in zip(sums, ends, strict=True)]


def _long_sum(buf: np.ndarray, low: int, high: int) -> np.uint64:
    whole = 0
    for at in range(low, high, _SPAN):
        part = _TABLE[buf[at : min(high, at + _SPAN)]]
        whole += int((part * powers(0, len(part))).sum(dtype=np.uint64)) * pow(_BASES[0], at - low, 2**64)
    return np.uint64(whole % 2**64)


def _short_sums(buf: np.ndarray, starts: np.ndarray, ends: list[np.ndarray], sums: list[np.ndarray], at: int, stop: int) -> None:
    while at < stop:
        low = int(starts[at])
        to = min(stop, max(at + 1, int(np.searchsorted(starts, low + _SPAN))))
        s = starts[at:to] - low
        top = int(ends[0][at:to].max()) - low
        total = np.zeros(top + 1, np.uint64)
        np.cumsum(_TABLE[buf[low : low + top]] * powers(0, top), out=total[1:])
        for hashes, stops in zip(sums, ends, strict=True):
            hashes[at:to] = (total[stops[at:to] - low] - total[s]) * powers(0, top + 1, True)[s]
        at = to


def window_hashes(words: np.ndarray, size: int, which: int = 1) -> np.ndarray:
    """A hash for each run of ``size`` consecutive word hashes, whatever rows they belong to."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _STRETCH):  # a window's hash doesn't depend on where sums begin
        part = words[at : at + _STRETCH + size - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(which, len(part)), out=total[1:])
        m = len(part) - size + 1
        out[at : at + m] = mix((total[size:] - total[:m]) * powers(which, m, True))
    return out


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Indexes of the words at which a window of ``size`` words of one row starts."""
    total = int(first[-1])
    ok = np.zeros(total + 1, np.int32)
    full = np.diff(first) >= size
    np.add.at(ok, first[:-1][full], 1)
    np.add.at(ok, first[1:][full] - size + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]))


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def counts_between(buf: np.ndarray, table: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many bytes with a mark in ``table`` stand in each half-open range; ranges come in order, low and high."""
    return _counts_before(buf, table, high) - _counts_before(buf, table, low)


def _counts_before(buf: np.ndarray, table: np.ndarray, places: np.ndarray) -> np.ndarray:
    out, done = np.zeros(len(places), np.int64), 0
    for at in range(0, len(buf), _STRETCH):
        part = table[buf[at : at + _STRETCH]]
        a, b = np.searchsorted(places, [at, at + len(part)], "right")  # places in (at, at + len]
        if a < b:
            total = np.cumsum(part, dtype=np.int32)
            out[a:b] = done + total[places[a:b] - at - 1]
            done += int(total[-1])
        else:
            done += int(np.count_nonzero(part))
    out[np.searchsorted(places, len(buf), "right") :] = done
    return out


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text; a longer text gets a slice of its own."""
    if batch.num_rows == 0:
        return
    sizes = np.diff(column_bytes(batch.column(batch.schema.get_field_index(column)))[1])
    group, total, at = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            group.append((at, i))
            at, total = i, 0
        total += size
    group.append((at, len(sizes)))
    for a, b in group:
        yield batch.slice(a, b - a)


def trim() -> None:
    """Give memory that is free back to the system; the next task in this worker may be of another kind."""
    pa.default_memory_pool().release_unused()
    if _MALLOC_TRIM is not None:
        _MALLOC_TRIM(0)


#: What modules remember from task to task of one kind; tasks of another kind clear it.
REMEMBERED: list[dict] = []


def forget() -> None:
    for one in REMEMBERED:
        one.clear()


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], remembers: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that trims memory when it ends, and before it begins forgets what other work remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            forget()
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def small_batches(spark: SparkSession) -> None:
    """Let the session send at most ``BATCH_ROWS`` rows at once to Python; texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def map_text(df: DataFrame, column: str, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema, remembers: bool = False) -> DataFrame:
    """``make`` of every slice of the frame; rows stay where they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column):
                yield make(part)

    small_batches(df.sparkSession)
    return df.mapInArrow(lean(work, remembers), schema)
