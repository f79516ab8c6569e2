"""Toxicity by multiple-instance learning: sentences are scored, only documents are labelled.

A sentence's probability is a logistic function of its hashed words and beginnings of words; a document's is the noisy-or of
its sentences, one minus the chance that none of them is toxic. The weights are learnt from document
labels through the noisy-or, so they say which sentences offend although no sentence was ever labelled.
Scoring reads each text where it lies; nothing is shuffled.

Sentence ends of many scripts count; where a script writes no spaces, words are runs of two characters.

Defined results: a null or empty text has no sentence and gets the score of no evidence, zero; a null
label or doc_id is no example; a null doc_id counts as held out; repeated rows get equal scores; a text of
any length is read whole; without examples of both classes every score is zero; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import PUNCTUATION, column_bytes, map_text, nested_hashes, runs

BUCKET_BITS = 18
#: Beginnings of words, in bytes, that are features beside the whole word: inflected words share them.
STEMS = (7, 6, 5, 4)
PER_WORD = 1 + len(STEMS)
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True
#: Sentence ends of other scripts; in UTF-8 each is taken for full stops.
FAR_ENDS = [c.encode() for c in "。！？｡．।॥؟۔።។"]


@dataclass
class SentenceModel:
    """Weights of hashed words and the bias of a sentence's log-odds."""

    weights: np.ndarray
    bias: float


def _near_ends(buf: np.ndarray) -> np.ndarray:
    """``buf`` with full stops for the sentence ends of other scripts."""
    if not len(buf) or int(buf.max()) < 0x80:
        return buf
    out = buf
    for mark in FAR_ENDS:
        at = np.flatnonzero(buf[: len(buf) - len(mark) + 1] == mark[0])
        for k in range(1, len(mark)):
            at = at[buf[at + k] == mark[k]]
        if len(at):
            out = out.copy() if out is buf else out
            for k in range(len(mark)):
                out[at + k] = ord(".")
    return out


def _unspaced(buf: np.ndarray) -> np.ndarray:
    """Where a character begins of a script that writes no spaces: Thai to Burmese, Khmer, kana, Chinese.

    All take three bytes in UTF-8, so that the first two tell them (U+0E00-U+109F, U+1780-U+17FF, U+3040-U+9FFF).
    """
    a, b = buf[:-2], buf[1:-1]
    far = ((a == 0xE0) & (b >= 0xB8)) | ((a == 0xE1) & ((b <= 0x82) | (b == 0x9E) | (b == 0x9F))) | ((a == 0xE3) & (b >= 0x81)) | ((a >= 0xE4) & (a <= 0xE9))
    return np.flatnonzero(far)


class Sentences:
    """Words of all rows as bucket numbers, and the sentence and row each belongs to.

    In scripts without spaces each character begins a word of two characters.
    """

    def __init__(self, column: pa.Array):
        self.buf, self.offs = column_bytes(pc.utf8_lower(column))
        near = _near_ends(self.buf)
        starts, ends, self.first = runs(near, self.offs, PUNCTUATION)
        cuts = [np.minimum(starts + n, ends) for n in STEMS]
        alone = _unspaced(near) if len(near) > 2 and int(near.max()) >= 0xE0 else starts[:0]
        if len(alone):
            run_end = ends[np.searchsorted(starts, alone, "right") - 1]
            # what else a run holds: from its start, and after each such character
            begins = np.unique(np.concatenate([starts, alone, (alone + 3)[alone + 3 < run_end]]))
            run = np.searchsorted(starts, begins, "right") - 1
            stop, far = np.minimum(np.append(begins[1:], len(near)), ends[run]), np.isin(begins, alone)
            pair = far & np.append(far[1:] & (begins[1:] == begins[:-1] + 3) & (run[1:] == run[:-1]), False)
            stop = np.where(pair, begins + 6, stop)
            cuts = [np.where(far, begins + 3, np.minimum(begins + n, stop)) for n in STEMS]
            starts, ends = begins, stop
            self.first = np.searchsorted(starts, self.offs)
        self.starts, self.ends = starts, ends
        #: a row for each word: the whole word, then its beginnings (a short word gives the same bucket again)
        self.buckets = np.stack([(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) for h in nested_hashes(self.buf, starts, [ends, *cuts])], axis=1)
        marks = np.zeros(len(near) + 1, np.int32)
        np.cumsum(ENDS[near], out=marks[1:], dtype=np.int32)
        head = np.zeros(len(starts), bool)  # a word after an end mark, or the first of its row
        if len(starts):
            head[1:] = marks[starts[1:]] > marks[starts[:-1]]
            head[self.first[:-1][np.diff(self.first) > 0]] = True
        self.heads = np.flatnonzero(head)  # first words of sentences
        self.sentence_row = np.searchsorted(self.first, self.heads, "right") - 1

    def log_odds(self, model: SentenceModel) -> np.ndarray:
        if not len(self.heads):
            return np.zeros(0)
        return np.add.reduceat(model.weights[self.buckets].sum(axis=1), self.heads) + model.bias


def noisy_or(log_odds: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """One minus the product of the chances that a sentence is clean, for each row."""
    return -np.expm1(-np.bincount(row, np.logaddexp(0, log_odds), minlength=rows))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _telling(buckets: np.ndarray, doc: np.ndarray, label: np.ndarray, least_docs: int, least_gain: float) -> np.ndarray:
    """Buckets whose presence tells the classes apart by a likelihood-ratio test over documents."""
    size = 1 << BUCKET_BITS
    pairs = np.unique(doc.astype(np.int64)[:, None] * size + buckets)
    of, bucket = pairs // size, pairs % size
    have = [np.bincount(bucket[label[of] == c], minlength=size).astype(float) for c in (0, 1)]
    total = [float((label == c).sum()) for c in (0, 1)]
    both = (have[0] + have[1]) / sum(total)
    gain = np.zeros(size)
    with np.errstate(divide="ignore", invalid="ignore"):
        for n, t in zip(have, total, strict=True):
            gain += 2 * np.nan_to_num(n * np.log(n / (t * both))) + 2 * np.nan_to_num((t - n) * np.log((t - n) / (t * (1 - both))))
    return np.flatnonzero((gain >= least_gain) & (have[0] + have[1] >= least_docs))


def _train(buckets: np.ndarray, heads: np.ndarray, sentence_doc: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int, least_docs: int, least_gain: float, shrink: float) -> SentenceModel:
    """Gradient steps (Adam) on the documents' weighted log-likelihood through the noisy-or.

    Only telling buckets get a weight. Weights are shrunk toward zero.
    """
    size = 1 << BUCKET_BITS
    words_of = np.diff(heads, append=len(buckets))
    used = _telling(buckets, np.repeat(sentence_doc, words_of), label, least_docs, least_gain)
    slot = np.full(size, -1, np.int32)
    slot[used] = np.arange(len(used))
    slots = slot[buckets].ravel()
    keep = slots >= 0
    features, of = slots[keep], np.repeat(np.arange(len(heads)), words_of * buckets.shape[1])[keep]
    params = np.append(np.zeros(len(used)), -5.0)
    m, v = np.zeros(len(params)), np.zeros(len(params))
    positive = label == 1
    for step in range(1, steps + 1):
        z = np.bincount(of, params[features], minlength=len(heads)) + params[-1]
        clean = np.bincount(sentence_doc, np.logaddexp(0, z), minlength=len(label))  # -log of the chance that all are clean
        toxic = np.maximum(-np.expm1(-clean), 1e-9)
        # d(-log likelihood)/dz is p for a clean document and -p * (1 - toxic) / toxic for a toxic one
        factor = weight * np.where(positive, -np.exp(-clean) / toxic, 1.0)
        g = np.exp(-np.logaddexp(0, -z)) * factor[sentence_doc]
        grad = np.append(np.bincount(features, g[of], minlength=len(used)), g.sum()) / weight.sum()
        grad[:-1] += shrink * params[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size)
    weights[used] = params[:-1]
    return SentenceModel(weights, float(params[-1]))


#: What ``fit`` chooses from: the least gain of a bucket, and how far weights are shrunk.
SETTINGS = ((7.0, 1e-4), (12.0, 1e-4), (7.0, 3e-5), (12.0, 3e-5))
#: Of the rows that may teach, those with this remainder choose among the settings.
CHOOSING = 1


@dataclass
class Examples:
    """Labelled documents: the bucket numbers of their words, and the first words of their sentences."""

    ids: np.ndarray
    label: np.ndarray
    words: list[np.ndarray]
    heads: list[np.ndarray]

    def take(self, at: np.ndarray) -> Examples:
        return Examples(self.ids[at], self.label[at], [self.words[k] for k in at.tolist()], [self.heads[k] for k in at.tolist()])

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of all, first words of sentences among them, and the document of each sentence."""
        base = np.cumsum([0, *map(len, self.words)])
        heads = np.concatenate([np.zeros(0, np.int64), *(h + b for h, b in zip(self.heads, base, strict=False))])
        return np.concatenate([np.zeros((0, PER_WORD), np.int32), *self.words]), heads, np.repeat(np.arange(len(self.words)), list(map(len, self.heads)))

    def losses(self, model: SentenceModel) -> np.ndarray:
        """Minus the log of the chance that a model gives each document's label."""
        words, heads, doc = self.flat()
        clean = np.bincount(doc, np.logaddexp(0, np.add.reduceat(model.weights[words].sum(axis=1), heads) + model.bias), minlength=len(self.label))
        return np.where(self.label == 1, -np.log(np.maximum(-np.expm1(-clean), 1e-9)), clean)


def choose(examples: Examples, weight: np.ndarray, steps: int, least_docs: int, settings: tuple[tuple[float, float], ...] = SETTINGS) -> tuple[float, float]:
    """The setting with the least weighted loss on the examples of remainder ``CHOOSING``, learnt on the others.

    The first one where either part lacks a class.
    """
    apart = np.array([zlib.crc32(str(i).encode()) % 5 == CHOOSING for i in examples.ids.tolist()])
    inner, outer = np.flatnonzero(~apart), np.flatnonzero(apart)
    if len(settings) == 1 or min(len(set(examples.label[at].tolist())) for at in (inner, outer)) < 2:
        return settings[0]
    learn, test, found = examples.take(inner), examples.take(outer), []
    for gain, shrink in settings:
        model = _train(*learn.flat(), learn.label, weight[inner], steps, least_docs, gain, shrink)
        found.append(float(weight[outer] @ test.losses(model)))
    return settings[int(np.argmin(found))]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, max_words: int = 4000, steps: int = 200, least_docs: int = 3, missed: float = 4.0, settings: tuple[tuple[float, float], ...] = SETTINGS) -> SentenceModel:
    """Learn from at most ``sample`` documents of each class, none of them held out.

    They are those with the smallest hash of their id, weighted back to the classes' shares among all
    labels; missing a toxic document counts ``missed`` times as much as calling a clean one toxic. Settings
    are chosen inside these examples; held-out rows have no part in it. Of several texts with one id the
    smallest is read, and none of more than ``max_words`` words. What comes to the driver is at most
    ``2 * sample * max_words`` words of five bucket numbers.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("k_id"), F.col("toxic").cast("int").alias("k_label")).where("k_id is not null and k_label in (0, 1)").where(~held_out(F.col("k_id"))).groupBy("k_id").agg(F.max("k_label").alias("k_label"))
    nothing = SentenceModel(np.zeros(1 << BUCKET_BITS), -np.inf)
    shares = {r.k_label: r["count"] for r in known.groupBy("k_label").count().collect()}
    if len(shares) < 2:
        return nothing
    chosen = [r for c in (0, 1) for r in known.where(F.col("k_label") == c).orderBy(F.xxhash64("k_id"), "k_id").limit(sample).collect()]
    picked = F.broadcast(spark.createDataFrame(chosen, "k_id long, k_label int"))  # at most 2 * sample rows of two numbers
    texts = docs.select(F.col("doc_id").alias("k_id"), F.col("text").alias("k_text")).join(picked, "k_id").groupBy("k_id", "k_label").agg(F.min("k_text").alias("k_text"))

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Sentences(batch.column("k_text"))
        rows = []
        for i, (doc, label) in enumerate(zip(batch.column("k_id").to_pylist(), batch.column("k_label").to_pylist(), strict=True)):
            a, b = int(s.first[i]), int(s.first[i + 1])
            if 0 < b - a <= max_words:
                low, high = np.searchsorted(s.heads, [a, b])
                rows.append((doc, label, s.buckets[a:b].tobytes(), (s.heads[low:high] - a).astype(np.int32).tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["k_id", "k_label", "words", "heads"])

    rows = sorted(map(tuple, map_text(texts, "k_text", read, "k_id long, k_label int, words binary, heads binary").collect()))
    label = np.array([r[1] for r in rows])
    if len(set(label.tolist())) < 2:
        return nothing
    examples = Examples(np.array([r[0] for r in rows]), label, [np.frombuffer(r[2], np.int32).reshape(-1, PER_WORD) for r in rows], [np.frombuffer(r[3], np.int32).astype(np.int64) for r in rows])
    weight = np.where(label == 1, missed * shares[1] / (label == 1).sum(), shares[0] / (label == 0).sum())
    gain, shrink = choose(examples, weight, steps, least_docs, settings)
    return _train(*examples.flat(), label, weight, steps, least_docs, gain, shrink)


def score(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """doc_id, held_out, score and predicted label of each row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Sentences(batch.column("text"))
        p = noisy_or(s.log_odds(model), s.sentence_row, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    base = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_text(base, "text", work, "doc_id long, held_out boolean, score double, predicted int")


def offending(docs: DataFrame, model: SentenceModel, least: float = 0.5) -> DataFrame:
    """Sentences whose own probability is ``least`` or more: doc_id, its number in the text, text and score."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Sentences(batch.column("text"))
        p = np.exp(-np.logaddexp(0, -s.log_odds(model)))
        at = np.flatnonzero(p >= least)
        row = s.sentence_row[at]
        ends = s.ends[np.append(s.heads[1:], len(s.starts)) - 1] if len(s.heads) else s.heads
        first = np.searchsorted(s.sentence_row, np.arange(batch.num_rows))
        text = [s.buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(s.starts[s.heads[at]].tolist(), ends[at].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(at - first[row], pa.int64()), pa.array(text, pa.string()), pa.array(p[at])], ["doc_id", "sentence", "text", "score"])

    return map_text(docs.select(F.col("doc_id").cast("long"), "text"), "text", work, "doc_id long, sentence long, text string, score double")
