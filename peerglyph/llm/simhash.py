"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 16 segments of 4 bits; the vector of their bit counts is a point of a
grid. A bit that differs moves one coordinate by at most one, so Manhattan distance between points is a
lower bound of Hamming distance. The range join sends each distinct fingerprint to its own cell and the
32 cells one step away: two points at distance two or less share one of these cells. Pairs in a cell are
then verified exactly.

A cell of more than ``CROWD`` fingerprints is dealt out anew: of three parts of the bits at least one is the
same in two fingerprints that differ in two, so its members meet again by cell and part, and so on.

Copies meet as one distinct fingerprint before anything is joined, and what a task finds in its cells
leaves it as a forest (each fingerprint with the smallest one it reaches there), never as pairs. Forests
are merged by alternating large-star and small-star steps on tables in the shared folder, so that nothing
grows on the driver and a lost executor costs one step at most.

``similar`` finds near copies by their texts: sets of 5-word shingles with a Jaccard similarity of 0.8 or more.
Fingerprints of such texts over three-word shingles often differ in more than two bits, so there a fingerprint
is that of the words (one counts eight times at most), and the join runs for several of them with hashes of
their own; a pair that meets in any is compared by its shingles. In cells with many pairs, those of neighbours are
compared first, and then only pairs that these haven't linked; there a sketch of the shingles (a bit of the least
of each of ``SKETCH`` hashes) leaves out pairs that are far from similar.

Defined results: a null or empty text has fingerprint zero and links like any other; equal rows stay
equal rows; a null doc_id is never a component's name unless all its members' ids are null; an empty
table gives an empty result; other columns are ignored (``components``, ``similar``) or passed through
(``keep_first``, ``keep_similar``). Of rows with one doc_id each is judged by its own text. In ``similar`` words
are split at ASCII white space and A-Z count as a-z, texts of the same words are equal (known by 64 bits of
hash), and a text of under five words is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import drop, materialise
from .textkit import column_bytes, lean, map_text, mix, row_of, runs, span_hashes, window_hashes

SEGMENTS, WIDTH, RADIUS, SEED = 16, 4, 2, 42
#: Rows of a cell that are compared in it, and links that a task holds at once.
CROWD, HELD = 2048, 200_000
#: Of ``similar``: words in a shingle; fingerprints of a text; what a word counts at most; bits of a half of the
#: next fingerprint in which texts that meet may differ (unrelated ones mostly differ in twice as many).
SHINGLE, TABLES, MOST_WEIGHT, OTHER_BITS = 5, 3, 8, 6
#: Bits of a sketch, and in how many two may differ: at a similarity of 0.8 they differ in 102, give or take 10, so
#: that one such pair in 3,000 is left out (one that is less near than its neighbours, or it would be linked by then).
SKETCH, SKETCH_BITS = 1024, 135
_FACTORS = np.random.default_rng(20240602).integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit b is set if it is set in over half of the hashes of the text's shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], stops[: n - 1]]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (stops[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    if n < 256:
        counts = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:  # a histogram of each byte, then its bits
        lanes = h.view(np.uint8).reshape(n, 8)
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ bits for k in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (64 bits, as a signed long) of each row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_text(docs.select(F.col("doc_id").cast("long"), "text"), "text", work, "doc_id long, fp long")


def points(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bit counts of each fingerprint's segments, and these as one number."""
    counts = np.stack([np.bitwise_count((fps >> np.uint64(WIDTH * k)) & np.uint64(2**WIDTH - 1)) for k in range(SEGMENTS)]).astype(np.uint64)
    code = np.zeros(len(fps), np.uint64)
    for k in range(SEGMENTS):
        code |= counts[k] << np.uint64(3 * k)
    return counts, code


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of each fingerprint's point and of its neighbours one step away, and the row of each."""
    counts, code = points(fps)
    rows = np.arange(len(fps))
    out, of = [code], [rows]
    for k in range(SEGMENTS):
        step = np.uint64(1 << (3 * k))
        up, down = counts[k] < WIDTH, counts[k] > 0
        out += [code[up] + step, code[down] - step]
        of += [rows[up], rows[down]]
    return np.concatenate(out), np.concatenate(of)


class Forest:
    """Union-find over fingerprints; a tree's root is its smallest member as an unsigned number."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Columns of whole groups of rows with the same first column, out of sorted rows; singles are left out.

    Groups of more than ``most`` rows are marked and come in parts.
    """
    held: list[np.ndarray] | None = None
    large = None  # the key of a large group that may go on
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if large is not None and batch.num_rows:
            go = int(np.searchsorted(columns[0], large, "right"))
            if go:
                yield True, [c[:go] for c in columns]
                columns = [c[go:] for c in columns]
        if not len(columns[0]):
            continue
        large = None
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        key = columns[0]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(begin, append=len(key))
        big, single = np.repeat(sizes > most, sizes), np.repeat(sizes == 1, sizes)
        last = int(begin[-1])
        small = ~big & ~single
        small[last:] = False
        if small.any():
            yield False, [c[small] for c in columns]
        if big.any():
            yield True, [c[big] for c in columns]
        held = None if big[-1] else [c[last:] for c in columns]
        large = key[-1] if big[-1] else None
    if held is not None and len(held[0]) > 1:
        yield False, held


def _offsets(key: np.ndarray, most: int | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """Rows that share their key with the row ``step`` rows on, for step 1, 2, ..."""
    at, step = np.arange(len(key)), 1
    while (most is None or step <= most) and len(at := at[at + step < len(key)]):
        at = at[key[at] == key[at + step]]
        if len(at):
            yield at, step
        step += 1


def _split(key: np.ndarray, fp: np.ndarray, fixed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Three keys for each row, of its group and a third of the bits that aren't fixed yet; the bits then fixed."""
    for part in range(3):
        mask = np.zeros(len(key), np.uint64)
        for value in np.unique(fixed):
            free = [b for b in range(64) if not int(value) >> b & 1]
            mask[fixed == value] = sum(1 << b for b in free[part * len(free) // 3 : (part + 1) * len(free) // 3])
        yield mix(key ^ mix((fp & mask) ^ mix(mask + np.uint64(part)))), fixed | mask


def _unsigned(column: np.ndarray) -> np.ndarray:
    return column.view(np.uint64)


def _signed(column: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(column).view(np.int64))


def _link(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell: verify the pairs of each cell; a forest of the links, and the rows of large cells."""

    def rows(u: np.ndarray, v: np.ndarray | None, cell: np.ndarray | None = None, fixed: np.ndarray | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()) if c is None else _signed(c) for c in (u, v, cell, fixed)], ["u", "v", "cell", "fixed"])

    def edges() -> pa.RecordBatch:
        nodes = np.fromiter(forest.parent, np.uint64, len(forest.parent))
        roots = np.array([forest.root(x) for x in nodes.tolist()], np.uint64)
        moved = roots != nodes
        return rows(nodes[moved], roots[moved])

    forest = Forest()
    for large, (cell, fp, fixed) in _groups(batches, CROWD):
        fp = _unsigned(fp)
        if large:
            yield rows(fp, None, _unsigned(cell), _unsigned(fixed))
            continue
        for at, step in _offsets(cell):
            near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
            for a, b in zip(fp[near].tolist(), fp[near + step].tolist(), strict=True):
                forest.join(a, b)
        if len(forest.parent) > HELD:
            yield edges()
            forest = Forest()
    if forest.parent:
        yield edges()


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Forest edges (u, v) among distinct fingerprints (column fp) that connect all within ``radius`` bits."""
    if radius > RADIUS:
        raise ValueError(f"cells one step around each point find links of up to {RADIUS} bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _unsigned(np.asarray(batch.column("fp")))
            for at in range(0, len(fps), 8192):
                cell, row = cells(fps[at : at + 8192])
                yield pa.RecordBatch.from_arrays([_signed(cell), _signed(fps[at : at + 8192][row]), pa.array(np.zeros(len(row), np.int64))], ["cell", "fp", "fixed"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, cell, fixed = (_unsigned(np.asarray(batch.column(c))) for c in ("u", "cell", "fixed"))
            for key, now in _split(cell, fp, fixed):
                yield pa.RecordBatch.from_arrays([_signed(key), _signed(fp), _signed(now)], ["cell", "fp", "fixed"])

    placed, found = distinct.select("fp").mapInArrow(lean(spread), "cell long, fp long, fixed long"), None
    while True:
        out, _ = materialise(placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(lean(lambda it: _link(it, radius)), "u long, v long, cell long, fixed long"), "links")
        edges, large = out.where("v is not null").select("u", "v"), out.where("v is null")
        found = edges if found is None else found.unionByName(edges)
        if large.isEmpty():
            return found
        # distinct fingerprints with twelve free bits are at most 4,096; before that a group can be large again
        placed = large.select("u", "cell", "fixed").mapInArrow(lean(again), "cell long, fp long, fixed long")


def _with_smallest(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the smallest ``value`` of their ``key`` as column ``name``.

    The smallest values are joined on the key's text, so that either side of the join is a plain shuffle:
    adaptive execution can then split a hot key, which it can't where a side is an aggregate that already
    lies by the key.
    """
    low = rows.groupBy(key).agg(F.min(value).alias(name)).select(F.col(key).cast("string").alias("_text"), name)
    return rows.withColumn("_text", F.col(key).cast("string")).join(low, "_text").drop("_text")


def connect(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of the edges (u, v); the root is the component's smallest node.

    Large-star hangs a node's larger neighbours on its smallest neighbour, small-star the smaller ones;
    in turn they end, after a number of rounds logarithmic in the component's size, in stars.
    """
    spark = edges.sparkSession
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, path = materialise(edges, name)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _with_smallest(both, "u", "v", "low").where("v > u")
        large = near.select(F.col("v").alias("u"), F.least("low", "u").alias("v")).where("u <> v").distinct()
        near = _with_smallest(large, "u", "v", "low")
        small = near.select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        after, new = materialise(small, name)
        drop(spark, path)
        now, path = after, new
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def components(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links."""
    marked, _ = materialise(fingerprints(docs, shingle), "fingerprints")
    classes, _ = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    named = _named(classes, links(classes, radius), "fp", "low", "component_id")
    return marked.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(classes: DataFrame, found: DataFrame, key: str, low: str, name: str) -> DataFrame:
    """``key`` of each class and the smallest ``low`` of those that links connect it with."""
    if found.isEmpty():
        return classes.select(key, F.col(low).alias(name))
    rooted = classes.join(connect(found), F.col(key) == F.col("node"), "left").select(key, low, F.coalesce("root", key).alias("root"))
    return _with_smallest(rooted, "root", low, name).select(key, name)


def text_key(text: str = "text") -> Column:
    """A number for a text, which tells rows of one doc_id apart."""
    return F.xxhash64(text)


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """``keep_leaders`` over links of fingerprints."""

    def find(rows: DataFrame) -> DataFrame:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), _signed(fps)], ["doc_id", "tid", "fp"])

        marked, _ = materialise(map_text(rows, "text", work, "doc_id long, tid long, fp long"), "fingerprints")
        classes, _ = materialise(marked.groupBy("fp").agg(F.min(F.struct("doc_id", "tid")).alias("low")), "classes")
        return marked.join(_named(classes, links(classes, radius), "fp", "low", "leader"), "fp").select("doc_id", "tid", "leader")

    return keep_leaders(docs, find)


def keep_similar(docs: DataFrame) -> DataFrame:
    """``keep_leaders`` over near copies as ``similar`` finds them."""
    return keep_leaders(docs, similar)


def keep_leaders(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` without the rows that don't lead their component; all columns as they were.

    ``find`` is given doc_id, tid and text of the rows and tells each row's leader, a struct of doc_id and tid: the
    smallest of its component. Of equal rows one stays. Rows without a doc_id can't be named and all stay.
    What is dropped is a list of ids: Spark broadcasts it if its size is under the broadcast threshold,
    and else shuffles the texts once.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tid"), "text")
    found, _ = materialise(find(rows).select("doc_id", "tid", (F.struct("doc_id", "tid") == F.col("leader")).alias("leads")), "leaders")
    by_row = found.groupBy(F.col("doc_id").alias("d_id"), F.col("tid").alias("d_tid")).agg(F.max("leads").alias("leads"), F.count("*").alias("times"))
    dropped, _ = materialise(by_row.where(~F.col("leads")).select("d_id", "d_tid"), "dropped")
    again, _ = materialise(by_row.where("leads and times > 1").select("d_id", "d_tid"), "again")
    named = lambda side: (docs.doc_id.cast("long") == side.d_id) & (text_key() == side.d_tid)
    out = docs.join(dropped, named(dropped), "left_anti")
    if again.isEmpty():
        return out
    once = out.join(again, named(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(again, named(again), "left_anti").unionByName(once)


class Words:
    """The words of a slice of texts, as hashes."""

    def __init__(self, column: pa.Array):
        buf, offs = column_bytes(column)
        self.buf = LOWER[buf]
        self.starts, self.ends, self.first = runs(self.buf, offs)
        self.hashes = span_hashes(self.buf, self.starts, self.ends)
        self.rows = len(offs) - 1

    def joined(self, row: int) -> bytes:
        a, b = int(self.first[row]), int(self.first[row + 1])
        return b" ".join(self.buf[s:e].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True))

    def names(self) -> np.ndarray:
        """A number for each text, by its words."""
        return np.array([xxhash.xxh64_intdigest(self.joined(row), SEED) for row in range(self.rows)], np.uint64)

    def sets(self) -> list[np.ndarray]:
        """The sorted hashes of each text's shingles."""
        windows = window_hashes(self.hashes, SHINGLE)
        cuts = self.first.tolist()
        return [np.unique(windows[a : b - SHINGLE + 1]) if b - a >= SHINGLE else np.array([xxhash.xxh64_intdigest(self.joined(row), SEED)], np.uint64) for row, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def sketches(self) -> list[bytes]:
        """``SKETCH`` bits for each text, from the least of its shingles under that many hashes."""
        out = []
        for found in self.sets():
            least = np.full(SKETCH, 2**64 - 1, np.uint64)
            for low in range(0, SKETCH, 64):
                for at in range(0, len(found), 1 << 14):
                    least[low : low + 64] = np.minimum(least[low : low + 64], (found[None, at : at + (1 << 14)] * _FACTORS[low : low + 64, None]).min(axis=1))
            out.append(np.packbits((mix(least) & np.uint64(1)).astype(np.uint8)).tobytes())
        return out

    def fingerprints(self) -> list[np.ndarray]:
        """``TABLES`` fingerprints of each text: bit b is set if it is in over half of the words' hashes, by weight."""
        row = row_of(self.first)
        order = np.lexsort((self.hashes, row))
        ranked, of = self.hashes[order], row[order]
        begin = np.flatnonzero(np.append(np.ones(min(1, len(of)), bool), (ranked[1:] != ranked[:-1]) | (of[1:] != of[:-1])))
        weight = np.minimum(np.diff(begin, append=len(ranked)), MOST_WEIGHT).astype(np.uint8)
        ranked, of = ranked[begin], of[begin]
        heads = np.flatnonzero(np.append(np.ones(min(1, len(of)), bool), of[1:] != of[:-1]))
        out = [np.zeros(self.rows, np.uint64) for _ in range(TABLES)]
        if len(heads):
            total = np.add.reduceat(weight, heads, dtype=np.int64)
            for k, found in enumerate(out):
                lanes = mix(ranked + mix(np.array([k + 1], np.uint64))).view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(lanes, axis=1, bitorder="little")
                bits *= weight[:, None]
                found[of[heads]] = np.packbits(2 * np.add.reduceat(bits, heads, axis=0, dtype=np.int64) > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        return out


def close(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of at least 0.8, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


#: A text in a cell of one of its fingerprints: whether the cell is its own, the fingerprint, half of the next
#: one, the text's number, and the bits that its group has in common.
PLACED = "cell long, home boolean, fp long, other int, sid long, fixed long"
#: A pair to be compared (a, b), or a row of a cell with many (b is null) or too many (large).
MET = "a long, b long, large boolean, cell long, home boolean, fp long, other int, fixed long"
_PLACED, _MET = (pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]]) for x in text.split(", ")]) for text in (PLACED, MET))


def _placed(classes: DataFrame) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                sid = np.asarray(part.column("sid"))
                fps = [_unsigned(np.asarray(part.column(f"f{k}"))) for k in range(TABLES)]
                for k, fp in enumerate(fps):
                    cell, row = cells(fp)
                    other = (fps[(k + 1) % TABLES] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                    yield pa.RecordBatch.from_arrays([_signed(mix(cell + mix(np.array([k + 1], np.uint64)))), pa.array(np.arange(len(cell)) < len(fp)), _signed(fp[row]), pa.array(other[row]), pa.array(sid[row]), pa.array(np.zeros(len(row), np.int64))], schema=_PLACED)

    return classes.select("sid", *(f"f{k}" for k in range(TABLES))).mapInArrow(lean(spread), PLACED)


def _may(fp: np.ndarray, other: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(_unsigned(fp)[a] ^ _unsigned(fp)[b]) <= RADIUS) & (np.bitwise_count(other[a] ^ other[b]) <= OTHER_BITS)


def _own(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether pairs of rows (home, code, sid) belong to the cell where they meet, of the cells that they share.

    Rows of one point share 33 cells, and belong to their own; points one step apart share each other's, and belong
    to that of the lesser number; others share one or two.
    """
    (home, code, sid), (with_home, with_code, with_sid) = a, b
    return np.where(home & with_home, True, np.where(home, sid < with_sid, np.where(with_home, with_sid < sid, code != with_code)))


def _pairs_of(sid: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return _pairs(sid[a], sid[b])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """The pairs of two lists of sids, each once, as MET."""
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    n = len(pairs)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.zeros(n, bool)), *(pa.nulls(n, f.type) for f in list(_MET)[3:])], schema=_MET)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell: the pairs to be compared, or the rows of cells that have many of them."""

    def rows(columns: list[np.ndarray], keep: np.ndarray, large: bool) -> pa.RecordBatch:
        cell, home, fp, other, sid, fixed = (c[keep] for c in columns)
        n = len(cell)
        return pa.RecordBatch.from_arrays([pa.array(sid), pa.nulls(n, pa.int64()), pa.array(np.full(n, large)), pa.array(cell), pa.array(home), pa.array(fp), pa.array(other), pa.array(fixed)], schema=_MET)

    for large, columns in _groups(batches, CROWD):
        cell, home, fp, other, sid, fixed = columns
        if large:  # of few free bits: no part would tell them apart
            few = np.bitwise_count(_unsigned(fixed)) > 52
            for keep, which in ((few, False), (~few, True)):
                if keep.any():
                    yield rows(columns, keep, which)
            continue
        number = np.cumsum(np.append(True, cell[1:] != cell[:-1])) - 1
        size = np.bincount(number)
        known = [home, points(_unsigned(fp))[1], sid]
        met, crowded = [], np.zeros(len(size), bool)
        count = np.zeros(len(size), np.int64)
        for at, step in _offsets(cell):
            at = at[~crowded[number[at]]]
            at = at[_may(fp, other, at, at + step)]
            at = at[_own([x[at] for x in known], [x[at + step] for x in known])]
            if len(at):
                count += np.bincount(number[at], minlength=len(size))
                crowded |= count > 4 * size
                met.append((at, at + step))
        if met:
            a, b = (np.concatenate(x) for x in zip(*met, strict=True))
            ok = ~crowded[number[a]]
            if ok.any():
                yield _pairs_of(sid, a[ok], b[ok])
        if crowded.any():
            yield rows(columns, crowded[number], False)


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cell, fp, fixed = (_unsigned(np.asarray(batch.column(c))) for c in ("cell", "fp", "fixed"))
        for key, now in _split(cell, fp, fixed):
            yield pa.RecordBatch.from_arrays([_signed(key), batch.column("home"), batch.column("fp"), batch.column("other"), batch.column("a"), _signed(now)], schema=_PLACED)


def _sketched(columns: list) -> tuple[np.ndarray, ...]:
    """cell, fp, other, sid, root, and the sketches as rows of numbers."""
    *numbers, sketch = columns
    return *numbers, np.frombuffer(b"".join(sketch.tolist()), np.uint64).reshape(len(sketch), -1)


def _alike(sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= SKETCH_BITS


def _neighbours(batches: Iterator[pa.RecordBatch], steps: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by cell and fingerprint, pairs of near rows that aren't linked."""
    for _, columns in _groups(batches, 1 << 16):  # a part of a large group is a group here
        cell, fp, other, sid, root, sketch = _sketched(columns)
        found = []
        for at, step in _offsets(cell, steps):
            at = at[(root[at] != root[at + step]) & _may(fp, other, at, at + step)]
            at = at[_alike(sketch, at, at + step)]
            if len(at):
                found.append((at, at + step))
        if found:
            yield _pairs_of(sid, *(np.concatenate(x) for x in zip(*found, strict=True)))


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs in a cell that may be near and aren't linked.

    Rows come sorted by cell, those outside the cell's largest component first. These are held; the others pass by
    and are compared with them, so that memory doesn't grow with the component that copies make.
    """
    cell, held = None, None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        bounds = np.append(np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1])), batch.num_rows) if batch.num_rows else [0]
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            key, main, home, fp, other, sid, root, sketch = (c[low:high] for c in columns)
            part = [fp, other, sid, root, np.frombuffer(b"".join(sketch.tolist()), np.uint64).reshape(high - low, -1), home, points(_unsigned(fp))[1]]
            if key[0] != cell:
                cell, held = key[0], [c[:0] for c in part]
            outside = [c[~main] for c in part]
            yield from _between(outside, held)
            yield from _between(outside, outside)
            held = [np.concatenate(x) for x in zip(held, outside, strict=True)]
            yield from _between([c[main] for c in part], held)


def _between(some: list[np.ndarray], others: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows (fp, other, sid, root, sketch, home, code) of two lists that may be near and aren't linked."""
    for low in range(0, len(some[0]), 256):
        for at in range(0, len(others[0]), 1 << 12):
            fp, other, sid, root, sketch, home, code = (c[low : low + 256] for c in some)
            with_fp, with_other, with_sid, with_root, with_sketch, with_home, with_code = (c[at : at + (1 << 12)] for c in others)
            a, b = np.nonzero((np.bitwise_count(_unsigned(fp)[:, None] ^ _unsigned(with_fp)) <= RADIUS) & (root[:, None] != with_root))
            ok = np.bitwise_count(other[a] ^ with_other[b]) <= OTHER_BITS
            ok &= _own([home[a], code[a], sid[a]], [with_home[b], with_code[b], with_sid[b]])
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(sketch[a] ^ with_sketch[b]).sum(axis=1) <= SKETCH_BITS
            if ok.any():
                yield _pairs(sid[a[ok]], with_sid[b[ok]])


def _texts(wanted: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """A text for each of the wanted sids, or several of the same words."""
    lows = classes.join(wanted, "sid", "left_semi").select(F.col("low.doc_id").alias("l_id"), F.col("low.tid").alias("l_tid"))
    return rows.join(lows, (rows.doc_id == lows.l_id) & (rows.tid == lows.l_tid), "left_semi").select("text")


def _compared(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Of pairs (a, b) of texts, those whose shingles are similar enough, as edges (u, v)."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        return pa.RecordBatch.from_arrays([_signed(words.names()), pa.array([s.tobytes() for s in words.sets()], pa.binary())], ["sid", "held"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [close(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    sets, _ = materialise(map_text(_texts(wanted, classes, rows), "text", make, "sid long, held binary").groupBy("sid").agg(F.min("held").alias("held")), "sets")
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("held").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(lean(verify), "u long, v long")


def similar(rows: DataFrame) -> DataFrame:
    """doc_id, tid and leader (the smallest doc_id and tid of its component) of rows with doc_id, tid and text."""

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), _signed(words.names()), *map(_signed, words.fingerprints())], ["doc_id", "tid", "sid", *(f"f{k}" for k in range(TABLES))])

    marked, _ = materialise(map_text(rows, "text", mark, "doc_id long, tid long, sid long, " + ", ".join(f"f{k} long" for k in range(TABLES))), "texts")
    classes, _ = materialise(marked.groupBy("sid").agg(F.min(F.struct("doc_id", "tid")).alias("low"), *(F.min(f"f{k}").alias(f"f{k}") for k in range(TABLES))), "classes")
    found = _near_links(classes, rows)
    return marked.join(_named(classes, found, "sid", "low", "leader"), "sid").select("doc_id", "tid", "leader")


def _near_links(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (u, v) among texts that connect all that meet in a cell and are similar."""
    placed, pairs, crowds = _placed(classes), None, None
    while True:
        met, _ = materialise(placed.repartition("cell").sortWithinPartitions("cell", "fp", "sid").mapInArrow(lean(_meet), MET), "met")
        now, crowd, large = met.where("b is not null").select("a", "b"), met.where("b is null and not large"), met.where("large")
        pairs, crowds = (now, crowd) if pairs is None else (pairs.unionByName(now), crowds.unionByName(crowd))
        if large.isEmpty():
            break
        placed = large.mapInArrow(lean(_again), PLACED)
    tried, _ = materialise(pairs.distinct(), "pairs")
    found, _ = materialise(_compared(tried, classes, rows), "links")
    if crowds.isEmpty():
        return found
    # cells with many pairs: neighbours in their own cells, twice, and then all that is left
    crowds = crowds.select("cell", "home", "fp", "other", F.col("a").alias("sid"))

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        return pa.RecordBatch.from_arrays([_signed(words.names()), pa.array(words.sketches(), pa.binary())], ["s_sid", "sketch"])

    sketches, _ = materialise(map_text(_texts(crowds.select("sid").distinct(), classes, rows), "text", sketch, "s_sid long, sketch binary").groupBy("s_sid").agg(F.min("sketch").alias("sketch")), "sketches")
    crowds = crowds.join(sketches, crowds.sid == sketches.s_sid).drop("s_sid")
    for step, work in enumerate((lambda it: _neighbours(it, 2), lambda it: _neighbours(it, 8), _rest)):
        some = crowds if step == 2 else crowds.where("home")
        if found.isEmpty():
            rooted = some.withColumn("root", F.col("sid"))
        else:
            roots = connect(found)
            rooted = some.join(roots, some.sid == roots.node, "left").withColumn("root", F.coalesce("root", "sid"))
        if step < 2:
            met = rooted.select("cell", "fp", "other", "sid", "root", "sketch").repartition("cell").sortWithinPartitions("cell", "fp", "sid").mapInArrow(lean(work), MET)
        else:
            sizes = rooted.groupBy("cell", "root").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots"))
            open_cells = sizes.where("roots > 1").select(F.col("cell").alias("o_cell"), F.col("most.root").alias("main"))
            rows_left = rooted.join(open_cells, rooted.cell == open_cells.o_cell).select("cell", (F.col("root") == F.col("main")).alias("main"), "home", "fp", "other", "sid", "root", "sketch")
            met = rows_left.repartition("cell").sortWithinPartitions("cell", "main", "sid").mapInArrow(lean(work), MET)
        now, _ = materialise(met.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if now.isEmpty():
            continue
        more, _ = materialise(_compared(now, classes, rows), "links")
        found, tried = found.unionByName(more), tried.unionByName(now)
    return found
