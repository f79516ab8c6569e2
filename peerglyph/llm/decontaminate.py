"""Benchmark decontamination: pigeonhole pieces and Myers' bit-parallel edit distance over words.

A benchmark item of m words may have ``error_rate * m`` word edits in a text; a short one only so many that its
pieces keep ``LEAST_PIECE`` words, none if it has fewer than two such pieces. It is split into one piece more
than that, so at least one piece stands in the text unchanged. The first words of all pieces are looked up at
every word of every text (vectorised, through a bitmap), whole pieces are compared, and around each piece hit
the item's distance to the best-matching stretch of words is found exactly.

Words are runs of letters and digits in lower case, so marks and spacing don't count. The benchmark is a
query set: it is taken in blocks of at most ``block_items`` items and ``block_bytes`` of text, and a task holds
one block at a time. Every text is matched against every block; texts are never shuffled.

Defined results: a null or empty text matches nothing; an item of fewer than ``least_words`` words, or with a
null id or text, matches nothing (an item of one or two common words would stand in nearly all texts); a text
of any length is searched whole; repeated rows give repeated matches; equal items match each under its own id;
an empty table on either side gives an empty result (``keep_clean``: all rows); other columns are ignored
(``matches``) or passed through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, materialise
from .textkit import PUNCTUATION, column_bytes, map_text, row_of, runs, span_hashes, window_hashes, window_starts

ERROR_RATE, LEAST_PIECE, LEAST_WORDS = 0.15, 3, 4
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
#: First words of pieces that are held together to tell texts without any.
MOST_ANCHORS = 4_000_000
_BITMAP_BITS = 20


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the first word of each row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    buf, offs = column_bytes(pc.utf8_lower(column))
    starts, ends, first = runs(buf, offs, PUNCTUATION)
    return span_hashes(buf, starts, ends), first


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and the word after the first best stretch.

    One bit for each word of the pattern, however many; the column of differences is moved on for each
    word of the text by a few operations on whole numbers.
    """
    m = len(pattern)
    masks: dict[int, int] = defaultdict(int)
    for k, w in enumerate(pattern):
        masks[w] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for at, w in enumerate(text):
        eq = masks.get(w, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        rise = minus | ~(across | plus) & full
        fall = plus & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full  # a stretch may start anywhere: nothing is carried in
        down = eq | minus
        plus = fall | ~(down | rise) & full
        minus = rise & down
        if score < best:
            best, end = score, at + 1
    return best, end


class Anchors:
    """Sorted hashes that are looked up at every word, behind a bitmap of their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bitmap = np.zeros(1 << _BITMAP_BITS, bool)
        self.bitmap[self.keys >> np.uint64(64 - _BITMAP_BITS)] = True

    def hits(self, hashes: np.ndarray, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The words at which one of the hashes, of so many words, stands, and the place of each among them."""
        at = window_starts(first, words)
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        probe = window_hashes(hashes, words)[at]
        maybe = np.flatnonzero(self.bitmap[probe >> np.uint64(64 - _BITMAP_BITS)])
        at, probe = at[maybe], probe[maybe]
        place = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
        same = self.keys[place] == probe
        return at[same], place[same]


@dataclass
class Items:
    """A block of the benchmark, ready to be looked up; items and pieces are numbers in arrays."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    budgets: np.ndarray
    #: of each piece, by how many words are looked up: its item, first word and number of words, in order of
    #: the anchor, and where each anchor's pieces begin
    pieces: dict[int, tuple[Anchors, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, rows: list[tuple[int, str]], error_rate: float, least_words: int = 1) -> Items:
        words, first = word_hashes(pa.array([t for _, t in rows], pa.string()))
        sizes = np.diff(first)
        budgets = np.minimum((error_rate * sizes).astype(np.int64), np.maximum(0, sizes // LEAST_PIECE - 1))
        used = np.flatnonzero(sizes >= max(1, least_words))
        many = budgets[used] + 1
        item = np.repeat(used, many)
        number = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        begin = number * sizes[item] // (budgets[item] + 1)
        size = (number + 1) * sizes[item] // (budgets[item] + 1) - begin
        pieces = {}
        for q in range(1, LEAST_PIECE + 1):
            mine = np.flatnonzero(np.minimum(size, LEAST_PIECE) == q)
            if len(mine):
                keys = window_hashes(words, q)[first[item[mine]] + begin[mine]]
                mine, keys = mine[np.argsort(keys, kind="stable")], np.sort(keys)
                anchors = Anchors(keys)
                pieces[q] = (anchors, item[mine], begin[mine], size[mine], np.append(np.searchsorted(keys, anchors.keys), len(keys)))
        return cls(np.array([i for i, _ in rows], np.int64), words, first, budgets, pieces)

    def pattern(self, item: int) -> list[int]:
        return self.words[self.first[item] : self.first[item + 1]].tolist()

    def places(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(row, item, word at which the item would begin) of every piece that stands in a text, each once."""
        row, found = row_of(first), [np.zeros((0, 3), np.int64)]
        for q, (anchors, item, begin, size, bounds) in self.pieces.items():
            at, place = anchors.hits(hashes, first, q)
            many = bounds[place + 1] - bounds[place]
            piece = np.repeat(bounds[place], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(at, many)
            ok = at + size[piece] <= first[row[at] + 1]
            at, piece = at[ok], piece[ok]
            step = q
            while len(at) and step < int(size[piece].max()):  # the rest of each piece, word by word
                more = np.minimum(step, size[piece] - 1)
                ok = hashes[at + more] == self.words[self.first[item[piece]] + begin[piece] + more]
                at, piece = at[ok], piece[ok]
                step += 1
            found.append(np.stack([row[at], item[piece], at - begin[piece]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def search(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, word after the last) of every item within its budget, once a row."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for r, item, at in self.places(hashes, first).tolist():
            low, high = int(first[r]), int(first[r + 1])
            pattern, budget = self.pattern(item), int(self.budgets[item])
            begin, end = max(low, at - budget), min(high, at + len(pattern) + budget)
            if end - begin < len(pattern) - budget:
                continue
            stretch = hashes[begin:end].tolist()
            distance, stop = myers(pattern, stretch)
            if distance <= budget and (distance, begin + stop) < best.get((r, item), (budget + 1, 0, 0))[:2]:
                # backwards from the end, the same distance gives the nearest start
                _, back = myers(pattern[::-1], stretch[:stop][::-1])
                best[r, item] = (distance, begin + stop, begin + stop - back)
        for (r, item), (distance, stop, start) in sorted(best.items()):
            yield r, item, distance, start - int(first[r]), stop - int(first[r])


def item_blocks(benchmark: DataFrame, block_items: int, block_bytes: int, error_rate: float, least_words: int) -> Iterator[Items]:
    """The benchmark in blocks of bounded size; the driver holds one at a time."""
    rows, held = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        if rows and (len(rows) >= block_items or held + len(text) > block_bytes):
            yield Items.build(rows, error_rate, least_words)
            rows, held = [], 0
        rows.append((item, text))
        held += len(text)
    if rows:
        yield Items.build(rows, error_rate, least_words)


SCHEMA = "doc_id long, item_id long, distance int, budget int, item_words int, first_word int, n_words int"


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each document and item within the item's budget of edits: distance and place in words.

    Each block is searched by tasks of its own, side by side in a union.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for items in item_blocks(benchmark, block_items, block_bytes, error_rate, least_words):

        def work(batch: pa.RecordBatch, items: Items = items) -> pa.RecordBatch:
            hashes, first = word_hashes(batch.column("text"))
            rows = list(items.search(hashes, first))
            ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            item = np.array([r[1] for r in rows], np.int64)
            columns = [np.array([r[2] for r in rows]), items.budgets[item], items.first[item + 1] - items.first[item], np.array([r[3] for r in rows]), np.array([r[4] - r[3] for r in rows])]
            return pa.RecordBatch.from_arrays([ids, pa.array(items.ids[item]), *(pa.array(c.astype(np.int32)) for c in columns)], ["doc_id", "item_id", "distance", "budget", "item_words", "first_word", "n_words"])

        found = map_text(texts, "text", work, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def _without(docs: DataFrame, items: Items) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = np.ones(batch.num_rows, bool)
        clean[[r[0] for r in items.search(*word_hashes(batch.column("text")))]] = False
        return batch.filter(pa.array(clean))

    return map_text(docs, "text", work, docs.schema)


def _apart(docs: DataFrame, anchors: dict[int, Anchors], hit: bool) -> DataFrame:
    """The rows with, or without, any of the first words of pieces."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, first = word_hashes(batch.column("text"))
        row, found = row_of(first), np.zeros(batch.num_rows, bool)
        for q, one in anchors.items():
            found[row[one.hits(hashes, first, q)[0]]] = True
        return batch.filter(pa.array(found == hit))

    return map_text(docs, "text", work, docs.schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, least_words: int = LEAST_WORDS, most_anchors: int = MOST_ANCHORS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they were.

    One block is searched where the texts lie. Of several, the first words of pieces alone are held together,
    ``most_anchors`` at a time; the texts that have any, mostly few, are written to the shared folder and
    searched for one block after another, so that no task and no stage holds two blocks.
    """
    blocks = item_blocks(benchmark, block_items, block_bytes, error_rate, least_words)
    one, two = next(blocks, None), next(blocks, None)
    if one is None:
        return docs
    if two is None:
        return _without(docs, one)
    del one, two
    kept, at = docs, 0
    while True:
        anchors, more = _group(item_blocks(benchmark, block_items, block_bytes, error_rate, least_words), at, most_anchors)
        if not more:
            return kept
        if at:  # the next stage holds the next group alone
            kept, _ = materialise(kept, "kept")
        maybe, path = materialise(_apart(kept, anchors, True), "maybe")
        for number, items in enumerate(item_blocks(benchmark, block_items, block_bytes, error_rate, least_words)):
            if at <= number < at + more:
                maybe, new = materialise(_without(maybe, items), "maybe")
                drop(docs.sparkSession, path)
                path = new
        kept, at = _apart(kept, anchors, False).unionByName(maybe), at + more


def _group(blocks: Iterator[Items], at: int, most: int) -> tuple[dict[int, Anchors], int]:
    """The anchors of blocks from number ``at`` on, up to ``most`` of them, and how many blocks these are."""
    keys: dict[int, list[np.ndarray]] = defaultdict(list)
    total = taken = 0
    for number, items in enumerate(blocks):
        if number < at:
            continue
        size = sum(len(p[0].keys) for p in items.pieces.values())
        if taken and total + size > most:
            break
        for q, p in items.pieces.items():
            keys[q].append(p[0].keys)
        total, taken = total + size, taken + 1
    return {q: Anchors(np.concatenate(k)) for q, k in keys.items()}, taken
