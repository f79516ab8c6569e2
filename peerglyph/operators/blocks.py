"""Comparisons of many renders with many, made in cells.

Both sides are dealt to parts by their number, and a part of one side with a part of the other is a cell. A task
holds the renders of a cell, meets them in tiles, and lets only results leave; what is shuffled is renders, once for
each part of the other side, and never comparisons. Products are added in the order of ``hashes.dot``, so that an
SSIM is the same number, to the last bit, wherever it is computed.

Renders have ch, font, ord (a number) and phash; for SSIM also px, mean and var. Characters and fonts are of any type.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Renders of a side that a task holds, comparisons that are worth a task, comparisons in a tile.
MOST, WORTH, TILE = 32_768, 4_000_000, (64, 1_024)
#: Numbers that are kept at once to find a percentile; of more, those around it are found by counting first.
KEPT = 4_000_000
Pieces = Callable[[], Iterator[np.ndarray]]


def parts(sources: int, targets: int, cores: int, most: int = MOST, worth: int = WORTH) -> tuple[int, int]:
    """Into how many parts either side is dealt: some tasks for each core if there is work, none above ``most``."""
    wanted = max(1, min(sources * targets // worth, 8 * cores))
    p = max(-(-sources // most), min(wanted, round(math.sqrt(wanted * sources / max(1, targets)))), 1)
    return p, max(-(-targets // most), -(-wanted // p), 1)


def meet(sources: DataFrame, targets: DataFrame, work: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, most: int = MOST, worth: int = WORTH) -> DataFrame:
    """``work`` on each cell's renders of either side; both have the same columns."""
    p, q = parts(sources.count(), targets.count(), sources.sparkSession.sparkContext.defaultParallelism, most, worth)
    part = lambda n: F.pmod(F.xxhash64("ord"), F.lit(n)).cast("int")
    a = sources.select("*", F.lit(0).alias("_side"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(q - 1)), lambda k: part(p) * q + k)).alias("_cell"))
    b = targets.select("*", F.lit(1).alias("_side"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda k: k * q + part(q))).alias("_cell"))
    return _grouped(a.unionByName(b).repartition(p * q, "_cell"), ["_cell"], work, schema)


def meet_by_pair(sources: DataFrame, targets: DataFrame, known: DataFrame, work: Callable[[pa.Table, pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on all renders of a source character and of a target character, and on the pair's ``known``
    comparisons (source, target, ssim), so that results of whole pairs need no other exchange."""
    a = sources.withColumnRenamed("ch", "_s").crossJoin(F.broadcast(targets.select(F.col("ch").alias("_t")).distinct())).withColumn("_side", F.lit(0))
    b = targets.withColumnRenamed("ch", "_t").crossJoin(F.broadcast(sources.select(F.col("ch").alias("_s")).distinct())).withColumn("_side", F.lit(1))
    c = known.select(F.col("source").alias("_s"), F.col("target").alias("_t"), "ssim", F.lit(2).alias("_side"))
    return _grouped(a.unionByName(b).unionByName(c, True), ["_s", "_t"], work, schema)


def _grouped(rows: DataFrame, keys: list[str], work: Callable, schema: str) -> DataFrame:
    sides = 3 if keys == ["_s", "_t"] else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        side = whole["_side"].to_numpy()
        yield from work(*(whole.filter(pa.array(side == k)).combine_chunks() for k in range(sides)))

    return rows.groupBy(*keys).applyInArrow(run, schema)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal values of both, rising with the values; -1 for null."""
    both = pa.concat_arrays([_one(a), _one(b)]).dictionary_encode()
    rank = np.empty(len(both.dictionary) + 1, np.int64)
    rank[pc.array_sort_indices(both.dictionary).to_numpy()] = np.arange(len(both.dictionary))
    rank[-1] = -1
    found = rank[both.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
    return found[: len(a)], found[len(a) :]


def _hashes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = _one(rows["phash"])
    return column.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), column.is_valid().to_numpy(zero_copy_only=False)


def _bits(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: slice, j: slice) -> np.ndarray:
    """Bits that differ, 65 if a hash is unknown."""
    out = np.bitwise_count(a[0][i, None] ^ b[0][None, j])
    if not (a[1][i].all() and b[1][j].all()):
        out[~(a[1][i, None] & b[1][None, j])] = 65
    return out


def _segments(codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where equal codes, which stand together, begin and end."""
    edges = np.flatnonzero(np.diff(codes)) + 1 if len(codes) else []
    return zip([0, *edges], [*edges, len(codes)], strict=True) if len(codes) else iter(())


def _slices(begin: int, end: int, step: int) -> Iterator[slice]:
    return (slice(k, min(end, k + step)) for k in range(begin, end, step))


class Pixels:
    """What SSIM needs of a side: pixels by place, how many, mean and variance; unknown ones are NaN with ``n`` -1."""

    def __init__(self, rows: pa.Table) -> None:
        px = _one(rows["px"])
        counts = pc.list_value_length(px).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = px.flatten()
        owner = np.repeat(np.arange(len(px)), np.maximum(counts, 0))
        place = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(counts, 0)) - np.maximum(counts, 0), np.maximum(counts, 0))
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        self.at = np.zeros((max(1, int(counts.max(initial=1))), len(px)))
        self.at[place[known], owner[known]] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)[known]
        self.n = counts
        self.n[owner[~known]] = -1
        self.mean, self.var = (_one(rows[c]).fill_null(math.nan).to_numpy(zero_copy_only=False) for c in ("mean", "var"))
        self.n[~(rows["mean"].is_valid().to_numpy() & rows["var"].is_valid().to_numpy())] = -1


def _ssim(a: Pixels, b: Pixels, i: slice, j: slice, n: int = 64, span: float = 1.0, k1: float = 0.01, k2: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """P20 as in ``hashes.global_ssim``, step by step, and where it is known."""
    c1, c2 = (k1 * span) ** 2, (k2 * span) ** 2
    dot = a.at[0, i, None] * b.at[0, None, j] + 0.0
    product = np.empty_like(dot)
    for k in range(1, min(len(a.at), len(b.at))):
        np.multiply(a.at[k, i, None], b.at[k, None, j], out=product)
        dot += product
    ma, mb = a.mean[i, None], b.mean[None, j]
    cov = dot / n - ma * mb
    out = ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (a.var[i, None] + b.var[None, j] + c2))
    return out, (a.n[i, None] == b.n[None, j]) & (a.n[i, None] >= 0)


class Scores:
    """A cell's comparisons, tile by tile: those that reach the hash gate have an SSIM."""

    def __init__(self, a: pa.Table, b: pa.Table, least: float) -> None:
        self.hashes, self.pixels, self.least = (_hashes(a), _hashes(b)), (Pixels(a), Pixels(b)), least

    def tile(self, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash similarity (NaN if unknown), SSIM, and where that is known and past the gate."""
        bits = _bits(*self.hashes, i, j)
        phash = np.where(bits == 65, math.nan, 1.0 - bits / 64.0)
        ssim, known = _ssim(*self.pixels, i, j)
        return phash, ssim, known & (phash >= self.least)

    def tiles(self, rows: tuple[int, int], columns: tuple[int, int]) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray, np.ndarray]]:
        for i in _slices(*rows, TILE[0]):
            for j in _slices(*columns, TILE[1]):
                yield i, j, *self.tile(i, j)


def _light(renders: DataFrame, *more: str) -> DataFrame:
    return renders.select("ch", "font", "ord", "phash", *more)


def _kind(rows: DataFrame, name: str) -> str:
    return rows.schema[name].dataType.simpleString()


def best(sources: DataFrame, targets: DataFrame, more: tuple[str, ...] = (), group: str | None = None, most: int = MOST, worth: int = WORTH) -> DataFrame:
    """Of each source and group of targets the target in another font whose hash is most similar, the first by ord
    of equal ones. With ``group``, a source is only met with groups that come after its own.

    Columns s_... and t_... of ch, font, ord and ``more``, and phash. A task sends one row for each source and group.
    """
    a, b = (_light(r, *more).withColumn("_group", F.col(group) if group else F.lit(0)) for r in (sources, targets))
    names = ["ch", "font", "ord", *more]
    schema = ", ".join(f"{p}_{c} {_kind(r, c)}" for p, r in (("s", a), ("t", b)) for c in [*names, "_group"]) + ", phash double"

    def work(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = a.sort_by("_group"), b.sort_by([("_group", "ascending"), ("ord", "ascending")])
        ha, hb, (fa, fb), (ga, gb) = _hashes(a), _hashes(b), _codes(a["font"], b["font"]), _codes(a["_group"], b["_group"])
        for rows in _segments(ga):
            for columns in _segments(gb):
                if ga[rows[0]] < 0 or gb[columns[0]] < 0 or (group and ga[rows[0]] >= gb[columns[0]]):
                    continue
                for i in _slices(*rows, 64):
                    least, at = np.full(i.stop - i.start, 255, np.uint8), np.zeros(i.stop - i.start, np.int64)
                    for j in _slices(*columns, 4_096):
                        bits = _bits(ha, hb, i, j)
                        same = (fa[i, None] == fb[None, j]) | (fa[i, None] < 0) | (fb[None, j] < 0) if fa[i].min() < 0 or fb[j].min() < 0 else fa[i, None] == fb[None, j]
                        bits |= np.negative(same.view(np.int8)).view(np.uint8)
                        k = bits.argmin(1)
                        found = bits[np.arange(len(k)), k]
                        less = found < least  # of equal ones the earlier stays
                        least[less], at[less] = found[less], k[less] + j.start
                    have = np.flatnonzero(least < 255)
                    if len(have):
                        s, t = a.take(pa.array(have + i.start)), b.take(pa.array(at[have]))
                        phash = pa.array(1.0 - least[have] / 64.0, mask=least[have] == 65)
                        yield from pa.table([*(s[c] for c in [*names, "_group"]), *(t[c] for c in [*names, "_group"]), phash], names=[f"{p}_{c}" for p in "st" for c in [*names, "_group"]] + ["phash"]).combine_chunks().to_batches()

    met = meet(a, b, work, schema, most, worth)
    keys = ["s_ord", "t__group"]
    rest = [c for c in met.columns if c not in (*keys, "phash", "s__group")]
    winner = F.max_by(F.struct(*rest), F.struct(F.col("phash"), (-F.col("t_ord")).alias("o")))
    return met.groupBy(*keys).agg(winner.alias("w"), F.max("phash").alias("phash")).select("s_ord", "phash", "w.*")


def scored(sources: DataFrame, targets: DataFrame, least: float, most: int = MOST, worth: int = WORTH) -> DataFrame:
    """Every source with every target: s_ch, s_font, t_ch, t_font, phash, and ssim past the hash gate."""
    a, b = (_light(r, "px", "mean", "var") for r in (sources, targets))
    names = ["s_ch", "s_font", "t_ch", "t_font", "phash", "ssim"]

    def work(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        cells = Scores(a, b, least)
        ends = [_one(x[c]) for x in (a, b) for c in ("ch", "font")]
        for i, j, phash, ssim, past in cells.tiles((0, len(a)), (0, len(b))):
            s, t = (pa.array(x.ravel()) for x in np.mgrid[i, j])
            columns = [e.take(s if k < 2 else t) for k, e in enumerate(ends)]
            yield pa.record_batch([*columns, pa.array(phash.ravel(), mask=np.isnan(phash.ravel())), pa.array(ssim.ravel(), mask=~past.ravel())], names=names)

    kinds = ", ".join(f"{p}_{c} {_kind(r, c)}" for p, r in (("s", a), ("t", b)) for c in ("ch", "font"))
    return meet(a, b, work, f"{kinds}, phash double, ssim double", most, worth)


def _by_ch(a: pa.Table, b: pa.Table) -> tuple[pa.Table, pa.Table, list[tuple[int, int]], list[tuple[int, int]]]:
    """Both sides by character and font, and where each character stands."""
    a, b = (x.sort_by([("ch", "ascending"), ("font", "ascending")]) for x in (a, b))
    ca, cb = _codes(a["ch"], b["ch"])
    return a, b, list(_segments(ca)), list(_segments(cb))


def sums(sources: DataFrame, targets: DataFrame, least: float, identical: float, most: int = MOST, worth: int = WORTH) -> DataFrame:
    """Of every source with every target, for each pair of characters and cell: source, target, n, scored, ssim_sum,
    and how many reach ``identical``."""
    a, b = (_light(r, "px", "mean", "var") for r in (sources, targets))

    def work(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b, rows, columns = _by_ch(a, b)
        cell, out = Scores(a, b, least), []
        for r in rows:
            for c in columns:
                n = scored_ = same = 0
                total = []
                for _, _, phash, ssim, past in cell.tiles(r, c):
                    x = ssim[past]
                    n, scored_, same = n + phash.size, scored_ + len(x), same + int((x >= identical).sum())
                    total.append(x.sum())
                out.append((r[0], c[0], n, scored_, math.fsum(total) if np.isfinite(total).all() else sum(total), same))
        if out:
            s, t, n, scored_, total, same = zip(*out, strict=True)
            yield pa.record_batch([_one(a["ch"]).take(pa.array(s)), _one(b["ch"]).take(pa.array(t)), pa.array(n), pa.array(scored_), pa.array(total, pa.float64()), pa.array(same)], names=["source", "target", "n", "scored", "ssim_sum", "identical"])

    return meet(a, b, work, f"source {_kind(a, 'ch')}, target {_kind(b, 'ch')}, n long, scored long, ssim_sum double, identical long", most, worth)


def font_bests(sources: DataFrame, targets: DataFrame, least: float, most: int = MOST, worth: int = WORTH) -> DataFrame:
    """Of every source with every target past the gate: for each pair of characters, the best comparison of each
    source font and that of each target font, the first by the other font of equal ones.

    Whatever fonts are asked for, the best comparison in one of them is among these: it is the best of its own font.
    """
    a, b = (_light(r, "px", "mean", "var") for r in (sources, targets))
    names = ["s_ch", "s_font", "t_ch", "t_font", "phash", "ssim", "_side"]

    def work(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b, rows, columns = _by_ch(a, b)
        cell = Scores(a, b, least)
        ends = [_one(x[c]) for x in (a, b) for c in ("ch", "font")]
        for c in columns:
            for r in rows:
                ns, nt = r[1] - r[0], c[1] - c[0]
                top = [np.full(n, -np.inf) for n in (ns, nt)]
                at, near, have = [np.zeros(n, np.int64) for n in (ns, nt)], [np.zeros(n) for n in (ns, nt)], [np.zeros(n, bool) for n in (ns, nt)]
                for i, j, phash, ssim, past in cell.tiles(r, c):
                    x = np.where(past, ssim, -np.inf)
                    for side, (y, p, ok, mine, other) in enumerate(((x, phash, past, i.start - r[0], j.start), (x.T, phash.T, past.T, j.start - c[0], i.start))):
                        k, m = y.argmax(1), np.arange(len(y))
                        here = mine + m
                        better = ok[m, k] & ((y[m, k] > top[side][here]) | ~have[side][here])
                        w = here[better]
                        top[side][w], at[side][w], near[side][w], have[side][w] = y[m, k][better], k[better] + other, p[m, k][better], True
                for side in (0, 1):
                    w = np.flatnonzero(have[side])
                    s, t = (w + r[0], at[0][w]) if side == 0 else (at[1][w], w + c[0])
                    if len(w):
                        s, t = pa.array(s), pa.array(t)
                        yield pa.record_batch([*(e.take(s if k < 2 else t) for k, e in enumerate(ends)), pa.array(near[side][w]), pa.array(top[side][w]), pa.array(np.full(len(w), side, np.int32))], names=names)

    kinds = ", ".join(f"{p}_{c} {_kind(r, c)}" for p, r in (("s", a), ("t", b)) for c in ("ch", "font"))
    met = meet(a, b, work, f"{kinds}, phash double, ssim double, _side int", most, worth)
    mine, other = F.when(F.col("_side") == 0, F.col("s_font")).otherwise(F.col("t_font")), F.when(F.col("_side") == 0, F.col("t_font")).otherwise(F.col("s_font"))
    first = met.groupBy("s_ch", "t_ch", "_side", mine.alias("_font")).agg(F.min_by(F.struct("s_font", "t_font", "phash", "ssim"), F.struct((-F.col("ssim")).alias("x"), other.alias("f"))).alias("w"))
    return first.select("s_ch", "t_ch", "w.*").dropDuplicates(["s_ch", "s_font", "t_ch", "t_font"])  # the best of both its fonts comes once


def percentile(pieces: Pieces, n: int, p: float, kept: int = KEPT) -> float:
    """F16 over ``n`` numbers that ``pieces`` gives as often as it is asked: exact, interpolated over n - 1 steps.

    Up to ``kept`` numbers are sorted. Of more, equal steps between the bounds are counted again and again, until
    few enough different ones are left around the place.
    """
    if not n:
        return 0.0
    position = (n - 1) * p
    low, high = math.floor(position), math.ceil(position)
    begin, end, below, inside = -math.inf, math.inf, 0, n
    if inside > kept:
        bounds = [(x.min(), x.max()) for x in pieces() if len(x)]
        begin, end = min(x for x, _ in bounds), max(x for _, x in bounds)
    while inside > kept and end - begin > 1e-12 * max(1.0, abs(begin)):
        edges = np.linspace(begin, end, 4_097)
        counts = np.zeros(4_096, np.int64)
        for x in pieces():
            x = x[(x >= begin) & (x <= end)]
            counts += np.bincount(np.minimum(np.searchsorted(edges, x, "right") - 1, 4_095), minlength=4_096)
        upto = below + np.cumsum(counts)
        first, last = np.searchsorted(upto, low, "right"), np.searchsorted(upto, high, "right")
        begin, end, below, was = edges[first], edges[last + 1], int(upto[first] - counts[first]), inside
        inside = int(counts[first : last + 1].sum())
        if inside == was and first == 0 and last == 4_095:
            break
    # a number at an upper bound may belong to the step above: it only adds places after those that are looked for
    values, counts = np.array([]), np.array([], np.int64)
    held = []
    for x in pieces():
        held.append(np.unique(x[(x >= begin) & (x <= end)] if inside < n else x, return_counts=True))
        if sum(len(v) for v, _ in held) > kept:
            values, counts = _merged([(values, counts), *held])
            held = []
    values, counts = _merged([(values, counts), *held])
    upto = below + np.cumsum(counts)
    lower, higher = (float(values[np.searchsorted(upto, k, "right")]) for k in (low, high))
    return lower if lower == higher else (high - position) * lower + (position - low) * higher


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
    return values, np.bincount(at, np.concatenate([c for _, c in held]), len(values)).astype(np.int64)


def pair_weights(sources: DataFrame, targets: DataFrame, known: DataFrame, least: float, kept: int = KEPT) -> DataFrame:
    """A06 before rounding: of each pair of characters, the maximum, 95th percentile, mean and number of its ``known``
    comparisons (same_...), of every source with every target (cross_...), and the percentile of both (stable_danger)."""
    a, b = (_light(r, "px", "mean", "var") for r in (sources, targets))
    fields = [f"{side}_{m}" for side in ("same", "cross") for m in ("max", "p95", "mean", "n")]

    def work(a: pa.Table, b: pa.Table, known: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(known) and not (len(a) and len(b)):
            return
        cell = Scores(a, b, least)
        same = _one(known["ssim"]).drop_null().to_numpy()

        def cross() -> Iterator[np.ndarray]:
            return (ssim[past] for *_, ssim, past in cell.tiles((0, len(a)), (0, len(b))))

        held, number, total, top = [], 0, [], -math.inf
        for x in cross():
            if len(x):
                number, top = number + len(x), max(top, float(x.max()))
                total.append(float(x.sum()))
                if number <= kept:
                    held.append(x)
        again = (lambda: iter(held)) if number <= kept else cross
        both = lambda: (x for it in (iter([same]), again()) for x in it)
        row = [float(same.max()) if len(same) else 0.0, percentile(lambda: iter([same]), len(same), 0.95, kept), float(same.mean()) if len(same) else 0.0, len(same)]
        row += [top if number else 0.0, percentile(again, number, 0.95, kept), math.fsum(total) / number if number else 0.0, number]
        keys = next(x for x in (known, a, b) if len(x))
        columns = [_one(keys["_s"])[:1], _one(keys["_t"])[:1], *(pa.array([v], pa.int64() if f.endswith("_n") else pa.float64()) for f, v in zip(fields, row, strict=True)), pa.array([percentile(both, len(same) + number, 0.95, kept)], pa.float64())]
        yield pa.record_batch(columns, names=["source", "target", *fields, "stable_danger"])

    kinds = ", ".join(f"{f} {'long' if f.endswith('_n') else 'double'}" for f in fields)
    return meet_by_pair(a, b, known, work, f"source {_kind(a, 'ch')}, target {_kind(b, 'ch')}, {kinds}, stable_danger double")
