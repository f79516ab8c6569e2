"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

``fit`` learns the field from documents with a quality label; ``judge`` decodes every line of every
text by Viterbi and keeps a document if enough of its words stand in content lines. Texts are
independent of each other, so nothing is shuffled and a hot source or copy costs what its bytes cost.

Defined results: a null or empty text has no words, fails the base rule and is not kept; a text of any
length is read whole; equal rows get equal results; an empty table gives an empty result; other columns
are passed through (``keep_documents``) or left out (``judge``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import SPACE, column_bytes, counts_between, map_text, mix, row_of, runs, span_hashes, window_hashes, window_starts

FEATURES = ("bias", "symbols", "marks", "capitals", "bars", "digits", "short", "long_words", "repeated")
WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Sets of bytes whose share is a feature of a line, and those that begin a code point.
_BYTES = np.arange(256)
MARKS, BARS, CAPITALS, DIGITS = _BYTES == 0x21, _BYTES == 0x7C, (_BYTES >= 0x41) & (_BYTES <= 0x5A), (_BYTES >= 0x30) & (_BYTES <= 0x39)
POINTS = (_BYTES & 0xC0) != 0x80
BLOCK = 512  # lines that the search goes over one after another


@dataclass
class LineModel:
    """Weights of the field. State 1 is boilerplate. Shares under ``content_share`` reject a document."""

    emission: np.ndarray = field(default_factory=lambda: np.zeros((len(FEATURES), 2)))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    content_share: float = 0.5


class Lines:
    """Words, lines and line features of a slice of texts."""

    def __init__(self, column: pa.Array):
        self.buf, self.offs = buf, offs = column_bytes(column)
        self.starts, self.ends, self.first = runs(buf, offs)
        self.hashes = span_hashes(buf, self.starts, self.ends)
        breaks = np.concatenate([np.zeros(0, np.int64), *(np.flatnonzero(buf[k : k + (1 << 20)] == 0x0A) + k for k in range(0, len(buf), 1 << 20))])
        rows = len(offs) - 1
        #: a text with n line breaks has n + 1 lines
        n_breaks = np.searchsorted(breaks, offs[1:]) - np.searchsorted(breaks, offs[:-1])
        self.first_line = np.concatenate([[0], np.cumsum(n_breaks + 1)])
        n = int(self.first_line[-1])
        low, high = np.empty(n, np.int64), np.empty(n, np.int64)
        heads = np.zeros(n, bool)
        heads[self.first_line[:-1]] = True
        low[heads], low[~heads] = offs[:-1], breaks + 1
        tails = np.zeros(n, bool)
        tails[self.first_line[1:] - 1] = True
        high[tails], high[~tails] = offs[1:], breaks
        self.low, self.high = low, high
        self.words = np.searchsorted(self.starts, high) - np.searchsorted(self.starts, low)
        self.line_row = np.repeat(np.arange(rows), n_breaks + 1)
        self._repeats()

    def _repeats(self) -> None:
        """Lines with a word that equal an earlier line of their text."""
        self.repeated = np.zeros(len(self.low), bool)
        have = np.flatnonzero(self.words > 0)
        if not len(have):
            return
        key = mix(span_hashes(self.buf, self.low[have], self.high[have]) + mix(self.line_row[have].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
        self.repeated[have[order[same]]] = True

    def features(self) -> np.ndarray:
        buf, low, high = self.buf, self.low, self.high
        size = np.maximum(high - low, 1)
        words = np.maximum(self.words, 1)
        share = lambda table: counts_between(buf, table, low, high) / size
        out = np.empty((len(low), len(FEATURES)), np.float32)
        out[:, 0] = 1
        out[:, 1] = np.minimum(1, 5 * share(SYMBOLS))
        out[:, 2] = np.minimum(1, 5 * share(MARKS))
        out[:, 3] = share(CAPITALS)
        out[:, 4] = np.minimum(1, 8 * share(BARS))
        out[:, 5] = share(DIGITS)
        out[:, 6] = self.words < 4
        out[:, 7] = np.minimum(1, size / words / 20)
        out[:, 8] = self.repeated
        return out

    def repeat_words(self) -> np.ndarray:
        """Per text: words inside an eight-word window that the text has twice or more."""
        rows = len(self.offs) - 1
        at = window_starts(self.first, WINDOW)
        if not len(at):
            return np.zeros(rows, np.int64)
        key = window_hashes(self.hashes, WINDOW)[at]
        if rows > 1:
            key = mix(key + mix(row_of(self.first)[at].astype(np.uint64)))
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        del key
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        begins = np.zeros(len(self.starts), bool)  # words that such a window begins with
        begins[at[order[twice]] if rows > 1 else order[twice]] = True
        del at, order, same, twice
        covered = begins.copy()
        for k in range(1, WINDOW):
            covered[k:] |= begins[:-k]
        total = np.zeros(len(self.starts) + 1, np.int32)
        np.cumsum(covered, out=total[1:])
        return (total[self.first[1:]] - total[self.first[:-1]]).astype(np.int64)

    def base(self) -> dict[str, np.ndarray]:
        buf, offs, low, high = self.buf, self.offs, self.offs[:-1], self.offs[1:]
        n_words = np.diff(self.first)
        repeat = self.repeat_words()
        return {
            "n_words": n_words,
            # separators are code points of one byte: what isn't one stands in a word
            "word_chars": counts_between(buf, POINTS & ~SPACE, low, high),
            "n_symbols": counts_between(buf, SYMBOLS, low, high),
            "n_dup_lines": np.bincount(self.line_row[self.repeated], minlength=len(offs) - 1),
            "n_repeat_words": repeat,
            "base_failed": (n_words < 20) | (100 * repeat > 30 * n_words),
        }


def _padded(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by falling line count, and how many of them have a line number t."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    alive = len(sizes) - np.cumsum(np.bincount(sizes, minlength=longest + 1))[:longest]
    return order, alive


def _way(before: np.ndarray, model: LineModel) -> tuple[np.ndarray, np.ndarray]:
    """Best scores of the two states after a step, and whether each came from boilerplate. Ties go to content."""
    way = before[..., :, None] + model.transition  # from, to
    take = way[..., 1, :] > way[..., 0, :]
    return np.where(take, way[..., 1, :], way[..., 0, :]), take


def viterbi(scores: np.ndarray, first: np.ndarray, model: LineModel, block: int = BLOCK) -> np.ndarray:
    """The best state of each line; ``scores`` has a row for each line and a column for each state.

    Runs over line numbers, with all texts side by side. A text of more than ``block`` lines is cut: a block's
    best scores from either state of its first line to either state of its last one are worked out beside the
    others', so that only blocks, not lines, follow one another.
    """
    n = len(scores)
    sizes = np.diff(first)
    parts = -(-sizes // block)
    low = np.repeat(first[:-1], parts) + block * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    high = np.minimum(low + block, np.repeat(first[1:], parts))
    head = np.zeros(len(low) + 1, bool)
    head[-1] = True
    head[(np.cumsum(parts) - parts)[parts > 0]] = True
    follows = ~head[1:]  # the next block is of the same text
    order, alive = _padded(np.concatenate([[0], np.cumsum(high - low)]))
    low, high, follows = low[order], high[order], follows[order]
    enter = np.tile(model.start, (len(low), 1))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))  # of each block in its text's order
    chain = place[np.flatnonzero(~head[1:])].tolist(), place[np.flatnonzero(~head[1:]) + 1].tolist()
    if chain[0]:
        some = np.flatnonzero(follows)  # blocks with a follower are full
        best = np.where(np.eye(2, dtype=bool), scores[low[some]][:, None, :], -np.inf)
        for t in range(1, block):
            best = _way(best, model)[0] + scores[low[some] + t][:, None, :]
        leave = dict(zip(some.tolist(), best, strict=True))
        for here, after in zip(*chain, strict=True):
            enter[after] = _way((enter[here][:, None] + leave[here]).max(axis=0), model)[0]
    back = np.zeros((n, 2), np.int8)
    best = np.empty((len(low), 2))
    for t, m in enumerate(alive.tolist()):
        at = low[:m] + t
        if t == 0:
            best[:m] = enter + scores[at]
            continue
        best[:m], take = _way(best[:m], model)
        back[at] = take
        best[:m] += scores[at]
    last = (best[:, 1] > best[:, 0]).astype(np.int8)
    # ways back from either last state of a block, then the state of each block's end from the block after it
    states = np.zeros((n, 2), np.int8)
    now = np.tile(np.array([0, 1], np.int8), (len(low), 1))
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        at = low[:m] + t
        states[at] = now[:m]
        now[:m] = np.take_along_axis(back[at], now[:m].astype(np.int64), axis=1)
    for here, after in zip(chain[0][::-1], chain[1][::-1], strict=True):
        last[here] = _way(best[here], model)[1][states[low[after], last[after]]]
    chosen = np.repeat(last, high - low)
    lines = np.repeat(low, high - low) + _ramp(high - low)
    out = np.empty(n, np.int8)
    out[lines] = states[lines, chosen]
    return out


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def marginals(scores: np.ndarray, first: np.ndarray, model: LineModel, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: state probabilities of lines, and the sums of those of pairs and of first lines.

    ``weight`` has a weight for each line, of its text, for the sums.
    """
    weight = np.ones(len(scores)) if weight is None else weight
    order, alive = _padded(first)
    begin = first[:-1][order]
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    for t, n in enumerate(alive.tolist()):
        at = begin[:n] + t
        ahead[at] = scores[at] + (model.start if t == 0 else np.logaddexp(ahead[at - 1][:, 0, None] + model.transition[0], ahead[at - 1][:, 1, None] + model.transition[1]))
    for t in range(len(alive) - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        nxt = scores[at + 1] + behind[at + 1]
        behind[at] = np.logaddexp(nxt[:, 0, None] + model.transition[:, 0], nxt[:, 1, None] + model.transition[:, 1])
    both = ahead + behind
    norm = np.logaddexp(both[:, 0], both[:, 1])
    p = np.exp(both - norm[:, None])
    inner = np.ones(len(scores), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    pair = np.exp(ahead[at - 1][:, :, None] + model.transition + (scores[at] + behind[at])[:, None, :] - norm[at][:, None, None])
    return p, np.einsum("n,nab->ab", weight[at], pair), weight[~inner] @ p[~inner]


def _train(x: np.ndarray, first: np.ndarray, quality: np.ndarray, weight: np.ndarray, rounds: int, steps: int, content_share: float) -> LineModel:
    """Alternate between line states and weights; line states begin as the document's label.

    Lines of a good document are content. Lines of a bad document are boilerplate, except those that the
    present weights hold to be content; each bad document keeps its worst line as boilerplate.
    """
    bad = np.repeat(quality == 0, np.diff(first))
    target = bad.copy()
    weight = np.repeat(weight, np.diff(first))
    model = LineModel(content_share=content_share)
    x = x.astype(np.float64)
    inner = np.ones(len(x), bool)
    heads = first[:-1][np.diff(first) > 0]
    inner[heads] = False
    at = np.flatnonzero(inner)
    for _ in range(rounds):
        gold = np.eye(2)[target.astype(int)]
        want = (x.T @ (gold * weight[:, None]), (gold[at - 1] * weight[at, None]).T @ gold[at], weight[heads] @ gold[heads])
        params = [model.emission, model.transition, model.start]
        first_moment, second_moment = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            p, pair, begin = marginals(x @ model.emission, first, model, weight)
            for k, have in enumerate((x.T @ (p * weight[:, None]), pair, begin)):
                grad = (have - want[k]) / weight.sum() + 1e-4 * params[k]
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * grad
                second_moment[k] = 0.99 * second_moment[k] + 0.01 * grad * grad
                params[k] -= 0.15 * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.99**step)) + 1e-8)
        p = marginals(x @ model.emission, first, model)[0][:, 1]
        target = bad & (p > 0.5)
        worst = np.maximum.reduceat(p, heads) if len(heads) else p
        target |= bad & (p >= np.repeat(worst, np.diff(first)[np.diff(first) > 0]))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, max_lines: int = 300, rounds: int = 3, steps: int = 40, content_share: float = 0.5) -> LineModel:
    """Learn the field from at most ``sample`` labelled documents of each class, weighted back to the classes' shares.

    ``labels`` has doc_id and quality (1 good, 0 bad); rows with a null are no examples. The sample is
    the documents with the smallest hash of their id, so it is the same at every run; a document with
    more than ``max_lines`` lines isn't learnt from, and of several texts with one id the smallest is. Without examples of both classes the field is all
    zeros, which calls every line content.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("k_id"), F.col("quality").cast("int").alias("k_quality")).where("k_id is not null and k_quality in (0, 1)").groupBy("k_id").agg(F.min("k_quality").alias("k_quality"))
    shares = {r.k_quality: r["count"] for r in known.groupBy("k_quality").count().collect()}
    chosen = [r for q in (0, 1) for r in known.where(F.col("k_quality") == q).orderBy(F.xxhash64("k_id"), "k_id").limit(sample).collect()]
    if len({r.k_quality for r in chosen}) < 2:
        return LineModel(content_share=content_share)
    # two columns of at most 2 * sample rows
    picked = F.broadcast(spark.createDataFrame(chosen, "k_id long, k_quality int"))
    texts = docs.select(F.col("doc_id").alias("k_id"), F.col("text").alias("k_text")).join(picked, "k_id").groupBy("k_id", "k_quality").agg(F.min("k_text").alias("k_text"))

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(batch.column("k_text"))
        x, cut = lines.features(), lines.first_line.tolist()
        rows = [(i, q, x[a:b].tobytes()) for i, q, a, b in zip(batch.column("k_id").to_pylist(), batch.column("k_quality").to_pylist(), cut, cut[1:], strict=False) if b - a <= max_lines]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["k_id", "k_quality", "x"])

    rows = sorted(map(tuple, map_text(texts, "k_text", extract, "k_id long, k_quality int, x binary").collect()))
    if len({r[1] for r in rows}) < 2:
        return LineModel(content_share=content_share)
    x = np.concatenate([np.frombuffer(r[2], np.float32).reshape(-1, len(FEATURES)) for r in rows])
    first = np.concatenate([[0], np.cumsum([len(r[2]) // (4 * len(FEATURES)) for r in rows])])
    quality = np.array([r[1] for r in rows])
    weight = np.where(quality == 1, shares[1] / (quality == 1).sum(), shares[0] / (quality == 0).sum())
    return _train(x, first, quality, weight, rounds, steps, content_share)


def verdicts(column: pa.Array, model: LineModel) -> dict[str, np.ndarray]:
    """Base counts, share of words in content lines, and the verdict, for each text."""
    lines = Lines(column)
    out = lines.base()
    states = viterbi(lines.features().astype(np.float64) @ model.emission, lines.first_line, model)
    content = np.bincount(lines.line_row, np.where(states == 0, lines.words, 0), minlength=len(column))
    share = content / np.maximum(out["n_words"], 1)
    return out | {"content_share": share, "kept": ~out["base_failed"] & (share >= model.content_share)}


def mark_lines(docs: DataFrame, model: LineModel) -> DataFrame:
    """Every line with a word: doc_id, line number, byte offsets in the text, and its label."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(batch.column("text"))
        states = viterbi(lines.features().astype(np.float64) @ model.emission, lines.first_line, model)
        at = np.flatnonzero(lines.words > 0)
        row = lines.line_row[at]
        number = at - lines.first_line[row]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(number, pa.int64()), pa.array(lines.low[at] - lines.offs[row]), pa.array(lines.high[at] - lines.offs[row]), pa.array(np.where(states[at] == 0, "content", "boilerplate"))], ["doc_id", "line", "low", "high", "label"])

    return map_text(docs.select(F.col("doc_id").cast("long"), "text"), "text", work, "doc_id long, line long, low long, high long, label string")


def judge(docs: DataFrame, model: LineModel) -> DataFrame:
    """doc_id with counts and verdict, one row for each row of ``docs``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = verdicts(batch.column("text"), model)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v[n], pa.int64()) for n in names), pa.array(v["base_failed"]), pa.array(v["kept"]), pa.array(v["content_share"])], ["doc_id", *names, "base_failed", "kept", "content_share"])

    return map_text(docs.select(F.col("doc_id").cast("long"), "text"), "text", work, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def keep_documents(docs: DataFrame, model: LineModel) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were."""
    return map_text(docs, "text", lambda batch: batch.filter(pa.array(verdicts(batch.column("text"), model)["kept"])), docs.schema)
