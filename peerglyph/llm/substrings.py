"""Substring dedup: fixed-block anchors find every run of words that occurs twice.

Words are hashed. Each text gives its non-overlapping blocks of ``(window + 1) // 2`` words as anchors,
and all its rolling windows of that length as probes; any ``window`` consecutive words hold a whole block,
so two equal runs always have a block of one under a probe of the other. Windows around an anchor that was
hit are the candidates; an exact count of their whole word sequences (96 bits of hash) extends the hits to
maximal repeats. All windows are judged on the input.

Texts are dealt to buckets by the place where they are read, about ``bucket_bytes`` in each, so that no id, source
or group of copies shares one; a table of files gives the same places when a task runs again. A bucket sends the sorted, distinct hashes of
its windows to the owners of hash ranges as differences of a few bytes, with two bits (is a block; occurs
twice in the bucket), and gets one bit back for each. A run that a million texts share thus costs one
entry for each bucket that has it, not a pair for each two texts. Every bucket sends something to every owner, of
whom there are as many: their size grows with the square root of the corpus (``bucket_size``), so that what is sent
grows in number with the corpus and not with its square.

Defined results: a null or empty text has no words; texts with fewer words than a window lose none;
repeated rows repeat each other's words; a text of any length is read whole (its bucket grows with it);
an empty table gives an empty result; other columns are passed through (``remove``) or left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import column_bytes, mix, row_of, runs, small_batches, span_hashes, trim, window_hashes, window_starts

WINDOW = 35
#: Bytes of text in a bucket at least, and of the corpus for each message between buckets and owners.
BUCKET_BYTES, MESSAGE_BYTES = 4 << 20, 1 << 10
_BLOB = "owner int, bucket int, n int, width int, body binary"


class Texts:
    """Words and windows of one bucket, in an order that doesn't depend on how rows arrive."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.block = window, (window + 1) // 2
        buf, offs = column_bytes(table.column("t_text"))
        whole = span_hashes(buf, offs[:-1], offs[1:])
        ids = table.column("t_id").fill_null(-(2**63)).to_numpy()
        self.order = np.lexsort((whole, ids))
        self.table = table.take(pa.array(self.order))
        self.buf, self.offs = column_bytes(self.table.column("t_text"))
        self.starts, self.ends, self.first = runs(self.buf, self.offs)
        self.words = span_hashes(self.buf, self.starts, self.ends)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word indexes of rolling block-long windows, their hashes, and which of them are blocks."""
        at = window_starts(self.first, self.block)
        place = at - self.first[row_of(self.first)[at]]
        return at, window_hashes(self.words, self.block)[at] if len(at) else np.zeros(0, np.uint64), place % self.block == 0

    def candidates(self, hit_blocks: np.ndarray) -> np.ndarray:
        """Word indexes of the windows that hold a block of their text that was hit."""
        at = window_starts(self.first, self.window)
        if not len(at) or not len(hit_blocks):
            return at[:0]
        marks = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(marks, np.maximum(hit_blocks + self.block - self.window, 0), 1)
        np.add.at(marks, hit_blocks + 1, -1)
        return at[np.cumsum(marks[:-1])[at] > 0]

    def window_keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the window at each index: 64 bits, and 32 bits on another base."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        return window_hashes(self.words, self.window)[at], (window_hashes(self.words, self.window, 2)[at] >> np.uint64(32)).astype(np.uint32)


def _owner_bounds(keys: np.ndarray, owners: int) -> np.ndarray:
    """Where each owner's range of 64-bit keys begins in sorted keys."""
    edges = (np.arange(owners, dtype=object) * 2**64 + owners - 1) // owners
    return np.concatenate([np.searchsorted(keys, np.array(edges.tolist(), np.uint64)), [len(keys)]])


def _edge(owner: int, owners: int) -> int:
    return (owner * 2**64 + owners - 1) // owners


def _pack(keys: np.ndarray, low: int, drop_bits: int, flags: np.ndarray, extra: bytes = b"") -> tuple[int, bytes]:
    """Sorted keys as differences of as few bytes as the largest needs, then two bits each, then ``extra``."""
    short = (keys - np.uint64(low)) >> np.uint64(drop_bits)
    steps = np.diff(short, prepend=np.uint64(0))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    body = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()  # byte planes compress better
    return width, body + np.packbits(flags, axis=None).tobytes() + extra


def _unpack(n: int, width: int, body: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = np.frombuffer(body, np.uint8)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = raw[: n * width].reshape(width, n).T
    size = (2 * n + 7) // 8
    flags = np.unpackbits(raw[n * width : n * width + size], count=2 * n).reshape(n, 2).astype(bool)
    return np.cumsum(steps.view(np.uint64).ravel()), flags, body[n * width + size :]


def _distinct(keys: np.ndarray, marks: np.ndarray | None, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys in sorted order: where each distinct one begins, if it is marked anywhere, if it occurs twice."""
    ranked = keys[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begin = np.flatnonzero(new)
    twice = np.diff(begin, append=len(ranked)) > 1
    marked = np.logical_or.reduceat(marks[order], begin) if marks is not None and len(begin) else np.zeros(len(begin), bool)
    return begin, marked, twice


def _blobs(bucket: int, keys: np.ndarray, flags: np.ndarray, owners: int, drop_bits: int, second: np.ndarray | None = None) -> pa.Table:
    cuts = _owner_bounds(keys, owners).tolist()
    rows = []
    for owner, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a < b:
            width, body = _pack(keys[a:b], _edge(owner, owners), drop_bits, flags[a:b], b"" if second is None else second[a:b].tobytes())
            rows.append((owner, bucket, b - a, width, body))
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate((("owner", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("body", pa.binary())))})


def _answers(owners_table: pa.Table, decide: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], two_keys: bool) -> pa.Table:
    """One owner's blobs to bits, in each bucket's own order. ``decide`` gets group heads, marks and counts."""
    rows = owners_table.select(["bucket", "n", "width", "body", "owner"]).to_pylist()
    parts = [_unpack(r["n"], r["width"], r["body"]) for r in rows]
    keys = np.concatenate([p[0] for p in parts])
    flags = np.concatenate([p[1] for p in parts])
    if two_keys:
        second = np.concatenate([np.frombuffer(p[2], np.uint32) for p in parts])
        order = np.lexsort((second, keys))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (second[order][1:] != second[order][:-1])
    else:
        order = np.argsort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
    begin = np.flatnonzero(new)
    marked = np.logical_or.reduceat(flags[order, 0], begin)
    total = np.add.reduceat(1 + flags[order, 1].astype(np.int64), begin)
    good = np.empty(len(keys), bool)
    good[order] = np.repeat(decide(marked, total), np.diff(begin, append=len(keys)))
    at = np.cumsum([0, *(r["n"] for r in rows)]).tolist()
    return pa.table({"bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "owner": pa.array([r["owner"] for r in rows], pa.int32()), "bits": pa.array([np.packbits(good[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())})


def _bits(answers: pa.Table, sizes: np.ndarray) -> np.ndarray:
    """The answer bits of a bucket, owner after owner; ``sizes`` has the number of keys of each owner."""
    found = dict(zip(answers.column("owner").to_pylist(), answers.column("bits").to_pylist(), strict=True))
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(found[o], np.uint8), count=n).astype(bool) for o, n in enumerate(sizes.tolist()) if n)])


class Plan:
    """The steps on a bucket; every step works the same hashes out again from the bucket's texts."""

    def __init__(self, window: int, owners: int, bits: int):
        self.window, self.owners, self.drop = window, owners, 64 - bits

    def _anchor_keys(self, texts: Texts):
        at, keys, is_block = texts.probes()
        keys = keys >> np.uint64(self.drop) << np.uint64(self.drop)
        order = np.argsort(keys, kind="stable")
        begin, marked, twice = _distinct(keys, is_block, order)
        return at, is_block, keys[order][begin], order, begin, np.stack([marked, twice], axis=1)

    def index(self, bucket: int, table: pa.Table) -> pa.Table:
        _, _, keys, _, _, flags = self._anchor_keys(Texts(table, self.window))
        return _blobs(bucket, keys, flags, self.owners, self.drop)

    @staticmethod
    def probe(table: pa.Table) -> pa.Table:
        return _answers(table, lambda marked, total: marked & (total > 1), False)

    def _candidates(self, texts: Texts, hits: pa.Table):
        at, is_block, keys, order, begin, _ = self._anchor_keys(texts)
        good = _bits(hits, np.diff(_owner_bounds(keys, self.owners)))
        hit = np.zeros(len(at), bool)
        hit[order] = np.repeat(good, np.diff(begin, append=len(order)))
        windows = texts.candidates(at[hit & is_block])
        first, second = texts.window_keys(windows)
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        begin = np.flatnonzero(new)
        return windows, order, begin, a[begin], b[begin], np.diff(begin, append=len(a)) > 1

    def extend(self, bucket: int, table: pa.Table, hits: pa.Table) -> pa.Table:
        *_, first, second, twice = self._candidates(Texts(table, self.window), hits)
        return _blobs(bucket, first, np.stack([twice, twice], axis=1), self.owners, 0, second)

    @staticmethod
    def count(table: pa.Table) -> pa.Table:
        return _answers(table, lambda marked, total: total > 1, True)

    def covered(self, table: pa.Table, hits: pa.Table, repeats: pa.Table) -> tuple[Texts, np.ndarray]:
        """The bucket's texts, and which of their words a repeated window covers."""
        texts = Texts(table, self.window)
        windows, order, begin, first, _, _ = self._candidates(texts, hits)
        good = _bits(repeats, np.diff(_owner_bounds(first, self.owners)))
        hit = np.zeros(len(windows), bool)
        hit[order] = np.repeat(good, np.diff(begin, append=len(order)))
        cover = np.zeros(len(texts.words) + 1, np.int32)
        np.add.at(cover, windows[hit], 1)
        np.add.at(cover, windows[hit] + self.window, -1)
        return texts, np.cumsum(cover[:-1]) > 0


def bucket_size(corpus_bytes: int) -> int:
    """Bytes in a bucket: 4 MB up to 17 GB, 32 MB at 1 TB, 320 MB at 100 TB; a task takes about twelve times as much."""
    return max(BUCKET_BYTES, math.isqrt(corpus_bytes * MESSAGE_BYTES))


def _empty(n_columns: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array([], v) for k, v in n_columns.items()})


_NO_ANSWER = {"bucket": pa.int32(), "owner": pa.int32(), "bits": pa.binary()}


def _run(docs: DataFrame, finish: Callable[[Texts, np.ndarray, np.ndarray], pa.Table], schema: str, window: int, bucket_bytes: int | None) -> DataFrame:
    """Deal texts out, find covered words, and let ``finish`` make rows of each bucket.

    ``docs`` has t_id, t_text and other columns. One plan holds the three passes over the buckets,
    so that Spark shuffles the texts once and reads that shuffle again.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("t_text")).alias("n")).first().n or 0
    buckets = max(1, -(-size // (bucket_bytes or bucket_size(size))))
    #: enough bits that a chance meeting of a window and a block is rare; such meetings cost time only
    bits = min(64, max(24, (max(1, size // 5)).bit_length() + 13))
    plan = Plan(window, buckets, bits)
    dealt = docs.withColumn("t_bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    by_bucket = lambda: dealt.groupBy("t_bucket")

    def index(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return plan.index(key[0].as_py(), table)

    def extend(key: tuple[pa.Scalar, ...], table: pa.Table, hits: pa.Table) -> pa.Table:
        return plan.extend(key[0].as_py(), table, hits) if table.num_rows else _empty({"owner": pa.int32(), "bucket": pa.int32(), "n": pa.int32(), "width": pa.int32(), "body": pa.binary()})

    def probe(table: pa.Table) -> pa.Table:
        return plan.probe(table)

    def count(table: pa.Table) -> pa.Table:
        return plan.count(table)

    answer = "bucket int, owner int, bits binary"
    hits = by_bucket().applyInArrow(index, _BLOB).groupBy("owner").applyInArrow(probe, answer)
    windows = by_bucket().cogroup(hits.groupBy("bucket")).applyInArrow(extend, _BLOB)
    repeats = windows.groupBy("owner").applyInArrow(count, answer)
    answers = hits.withColumn("step", F.lit(1)).unionByName(repeats.withColumn("step", F.lit(2)))

    def last(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        trim()  # what the steps before have freed
        steps = found.column("step").to_numpy()
        texts, gone = plan.covered(table, found.filter(pa.array(steps == 1)), found.filter(pa.array(steps == 2)))
        return finish(texts, gone, np.repeat(np.arange(table.num_rows), np.diff(texts.first)))

    return by_bucket().cogroup(answers.groupBy("bucket")).applyInArrow(last, schema)


def _kept_bytes(texts: Texts, gone: np.ndarray, row: int) -> bytes:
    """Kept words of a row, joined by one space."""
    a, b = int(texts.first[row]), int(texts.first[row + 1])
    whole = texts.buf[texts.offs[row] : texts.offs[row + 1]].tobytes()
    if not gone[a:b].any():
        return b" ".join(whole.split())
    return b" ".join(w for w, g in zip(whole.split(), gone[a:b].tolist(), strict=True) if not g)


def measure(docs: DataFrame, window: int = WINDOW, bucket_bytes: int | None = None) -> DataFrame:
    """doc_id, words, removed words and SHA-256 of the kept words, for each row of ``docs``."""

    def finish(texts: Texts, gone: np.ndarray, row: np.ndarray) -> pa.Table:
        n = texts.table.num_rows
        digests = [hashlib.sha256(_kept_bytes(texts, gone, i)).hexdigest() for i in range(n)]
        return pa.table({"doc_id": texts.table.column("t_id"), "n_words": pa.array(np.diff(texts.first), pa.int64()), "n_removed": pa.array(np.bincount(row[gone], minlength=n), pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    base = docs.select(F.col("doc_id").cast("long").alias("t_id"), F.col("text").alias("t_text"))
    return _run(base, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", window, bucket_bytes)


def spans(docs: DataFrame, window: int = WINDOW, bucket_bytes: int | None = None) -> DataFrame:
    """The maximal runs of removed words: doc_id, first word, number of words, and the words' text."""

    def finish(texts: Texts, gone: np.ndarray, row: np.ndarray) -> pa.Table:
        edge = np.ones(len(gone), bool)
        edge[1:] = (gone[1:] != gone[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(gone))
        begin, end = begin[gone[begin]], end[gone[begin]]
        text = [texts.buf[texts.starts[a] : texts.ends[b - 1]].tobytes().decode("utf-8", "replace") for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        return pa.table({"doc_id": texts.table.column("t_id").take(pa.array(row[begin])), "first_word": pa.array(begin - texts.first[row[begin]], pa.int64()), "n_words": pa.array(end - begin, pa.int64()), "span": pa.array(text, pa.string())})

    base = docs.select(F.col("doc_id").cast("long").alias("t_id"), F.col("text").alias("t_text"))
    return _run(base, finish, "doc_id long, first_word long, n_words long, span string", window, bucket_bytes)


def remove(docs: DataFrame, window: int = WINDOW, bucket_bytes: int | None = None) -> DataFrame:
    """``docs`` with covered words cut out of ``text`` and n_chars, if present, counted again.

    A text that loses nothing stays as it is, to the byte; in others what stands between kept words stays,
    and a cut leaves one space. A text that loses all its words becomes empty.
    """
    columns = docs.columns

    def finish(texts: Texts, gone: np.ndarray, row: np.ndarray) -> pa.Table:
        touched = np.bincount(row[gone], minlength=texts.table.num_rows) > 0
        old = texts.table.column("t_text").to_pylist()
        for i in np.flatnonzero(touched).tolist():
            a, b = int(texts.first[i]), int(texts.first[i + 1])
            keep = ~gone[a:b]
            edge = np.flatnonzero(np.diff(keep, prepend=False, append=False)) + a
            old[i] = " ".join(texts.buf[texts.starts[x] : texts.ends[y - 1]].tobytes().decode("utf-8", "replace") for x, y in edge.reshape(-1, 2).tolist())
        table = texts.table
        out = {}
        for name in columns:
            values = table.column(f"c_{name}") if name not in ("text",) else pa.array(old, pa.string())
            if name == "n_chars":
                counts = table.column("c_n_chars").to_pylist()
                values = pa.array([len(old[i]) if touched[i] else counts[i] for i in range(len(old))], table.schema.field("c_n_chars").type)
            out[name] = values
        return pa.table(out)

    base = docs.select(F.col("doc_id").cast("long").alias("t_id"), F.col("text").alias("t_text"), *(F.col(f"`{c}`").alias(f"c_{c}") for c in columns if c != "text"))
    return _run(base, finish, docs.schema, window, bucket_bytes)
