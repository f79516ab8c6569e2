"""Token counts from flat token files by a separator scan.

A token file is nothing but token ids, little-endian and of one width, with an end-of-document id after
each document; there is no index. Files are cut into blocks; in each block one vectorised comparison finds
the separators. Documents inside a block are counted there; of the rest a block tells only how many tokens
stand before its first and after its last separator, and a prefix scan over a file's blocks joins these.
Blocks are read by place, ``UNIT_BLOCKS`` by a task, so that a file of any size is shared by many tasks.

A document begins with its doc_id in ``HEADER`` tokens (14 bits in each, raised above the small ids, so
that none is the separator); a block is read with so many tokens of look-ahead. The writer uses Spark's
text sink with the separator as line separator, so files land in any store that Spark writes.

Defined results: a null or empty text has no tokens and still a document; a null doc_id is written as such
and read back; repeated rows are repeated documents; a text of any length is counted whole, over as many
blocks as it covers; a file that ends without a separator gives its last document as incomplete; an empty
table gives no documents; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import View, deal, files, map_files, map_units, readable, units
from .storage import new_path
from .textkit import map_text

HEADER, DIGIT_BITS, RAISED = 5, 14, 259
NO_ID = RAISED + (1 << DIGIT_BITS)  # each header token of a document without an id
BLOCK_TOKENS = 1 << 18
UNIT_BLOCKS = 32
MOST_PIECES = 1 << 20
#: Characters that are white space to the splitting pattern; a run of so many is not given to it, and a text
#: is given to it in parts of about so many characters.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG_RUN, PART = 4096, 1 << 20


class Tokenizer:
    """A byte-level BPE by its ranks; ``end`` is an id that no text is given. Plain values, to be sent to tasks."""

    #: Fixed value: how this family of vocabularies splits a text before merging.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, ranks: dict[bytes, int], end: int, pattern: str = PATTERN):
        if len(ranks) > MOST_PIECES:
            raise ValueError(f"a vocabulary of {len(ranks)} pieces is more than is sent to every executor")
        if end <= NO_ID:
            raise ValueError("the end of a document has to be told from header tokens")
        self.ranks, self.end, self.pattern = ranks, end, pattern
        self.kind = np.dtype(np.uint16 if max(len(ranks), end) < 1 << 16 else np.uint32)

    @classmethod
    def load(cls, path: str, end: int) -> Tokenizer:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}, end)

    def encoding(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("tokenfiles", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})


_RUN = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")
_EDGE = re.compile(f"[^{WHITE}](?=[{WHITE}])")


def encode(text: str, encoding: tiktoken.Encoding) -> np.ndarray:
    """The ids of a text, of any length.

    The pattern that splits a text before merging can't take white space of a million characters, so long
    runs of it are merged outright: all of a run but its last character is one piece (all of it at the end
    of the text). White space after another character is always a boundary; long texts are cut there.
    """
    if len(text) < LONG_RUN:
        return np.array(encoding.encode_ordinary(text), np.int64)
    out, at = [np.zeros(0, np.int64)], 0

    def plain(low: int, high: int) -> None:
        while low < high:
            edge = _EDGE.search(text, low + PART, high) if high - low > PART else None
            stop = edge.end() if edge else high
            out.append(np.array(encoding.encode_ordinary(text[low:stop]), np.int64))
            low = stop

    for run in _RUN.finditer(text):
        plain(at, run.start())
        at = run.end() if run.end() == len(text) else run.end() - 1
        out.append(np.array(encoding._encode_single_piece(text[run.start() : at]), np.int64))
    plain(at, len(text))
    return np.concatenate(out)


_encodings: dict[int, tiktoken.Encoding] = {}  # of this worker process: that of the tokenizer in use


def _encoding(tokenizer: Tokenizer) -> tiktoken.Encoding:
    if id(tokenizer) not in _encodings:
        _encodings.clear()
        _encodings[id(tokenizer)] = tokenizer.encoding()
    return _encodings[id(tokenizer)]


def header(doc_id: int | None) -> np.ndarray:
    if doc_id is None:
        return np.full(HEADER, NO_ID)
    return np.array([RAISED + ((doc_id % 2**64) >> (DIGIT_BITS * k)) % (1 << DIGIT_BITS) for k in range(HEADER)])


def write(docs: DataFrame, path: str, tokenizer: Tokenizer, documents_per_file: int = 2048) -> None:
    """Encode the texts of ``docs`` into token files under ``path``."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    kind = tokenizer.kind

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding = _encoding(shared.value)
        rows = [np.concatenate([header(i), encode(t or "", encoding)]).astype(kind).tobytes() for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    coded = map_text(docs.select(F.col("doc_id").cast("long"), "text"), "text", work, "value binary")
    separator = np.array([tokenizer.end], kind).tobytes().decode("latin-1")  # Latin-1 has a character for each byte
    coded.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", documents_per_file).text(path)


def _ids(tokens: np.ndarray, starts: np.ndarray) -> list[int | None]:
    """The doc_ids in the headers at ``starts``."""
    digits = tokens[starts[:, None] + np.arange(HEADER)].astype(np.int64) - RAISED
    whole = np.zeros(len(starts), np.uint64)
    for k in range(HEADER):
        whole |= digits[:, k].astype(np.uint64) << np.uint64(DIGIT_BITS * k)
    return [None if missing else x for missing, x in zip((digits[:, 0] == NO_ID - RAISED).tolist(), whole.view(np.int64).tolist(), strict=True)]


SCAN = "file string, block long, separated boolean, head long, tail long, doc_id long, named boolean, start long, n long"


def scan(spark: SparkSession, path: str, tokenizer: Tokenizer, block_tokens: int = BLOCK_TOKENS, unit_blocks: int = UNIT_BLOCKS) -> DataFrame:
    """Blocks with what they hold: a row for each document inside a block, and one for the block's edges.

    ``unit_blocks`` blocks of a file are the unit of work.
    """
    kind, end = tokenizer.kind, tokenizer.end
    width = kind.itemsize

    def blocks(view: View, unit: dict) -> Iterator[pa.RecordBatch]:
        for at in range(unit["low"] // width, unit["high"] // width, block_tokens):
            read = view.get(at * width, (block_tokens + HEADER) * width)
            tokens = np.frombuffer(read, kind, len(read) // width)
            yield one(unit["path"], at // block_tokens, at, tokens, min(block_tokens, len(tokens)))

    def one(name: str, block: int, at: int, tokens: np.ndarray, size: int) -> pa.RecordBatch:
        """``tokens`` go on after the block's ``size`` tokens by a header's length, or to the file's end."""
        seps = np.flatnonzero(tokens[:size] == end)
        starts = seps + 1 if block else np.concatenate([[0], seps + 1])  # where documents begin
        starts = starts[starts + HEADER <= len(tokens)]
        ids = _ids(tokens, starts)
        inside = int(np.searchsorted(starts, seps[-1])) if len(seps) else 0  # documents that also end here
        ends = seps[len(seps) - inside :]
        opens = len(starts) > inside
        head = int(seps[0]) if len(seps) else size
        if block == 0:  # nothing came before: the first document is either inside or the open one
            head = 0
        tail = size - int(starts[inside]) if opens else 0
        separated = bool(len(seps)) or block == 0
        cols = [
            [name] * (inside + 1), [block] * (inside + 1), [None] * inside + [separated], [0] * inside + [head], [0] * inside + [tail],
            [*ids[:inside], ids[inside] if opens else None], [True] * inside + [opens], [*(starts[:inside] + at).tolist(), at + int(starts[inside]) if opens else None], [*(ends - starts[:inside] - HEADER).tolist(), None],
        ]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCAN.split(", ")])

    listed = files(spark, path)
    if not readable(listed):
        return map_files(spark, path, blocks, SCAN)
    cut = units(listed, unit_blocks * block_tokens * width)
    return map_units(spark, deal(cut, cut.count()), blocks, SCAN)


def counts(spark: SparkSession, path: str, tokenizer: Tokenizer, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Every document of the files: file, start (in tokens), doc_id, n_tokens, and whether its end was found."""
    found = scan(spark, path, tokenizer, block_tokens)
    inside = found.where("separated is null").select("file", "start", "doc_id", F.col("n").alias("n_tokens"), F.lit(True).alias("complete"))
    edges = found.where("separated is not null")
    # the prefix scan: an open document is numbered by how many blocks before and with its own hold a separator
    order = Window.partitionBy("file").orderBy("block")
    numbered = edges.withColumn("upto", F.sum(F.col("separated").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.select("file", F.explode(F.array(
        F.struct(F.when(F.col("separated"), F.col("upto") - 1).otherwise(F.col("upto")).alias("k"), F.col("head").alias("n"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("start"), F.lit(False).alias("named"), (F.col("separated") & (F.col("block") > 0)).alias("closed")),
        F.struct(F.when(F.col("separated"), F.col("upto")).alias("k"), F.when(F.col("separated"), F.col("tail")).alias("n"), F.col("doc_id"), F.col("start"), F.col("named"), F.lit(False).alias("closed")),
    )).alias("p")).select("file", "p.*").where("k is not null")
    joined = parts.groupBy("file", "k").agg(F.sum("n").alias("n"), F.max("doc_id").alias("doc_id"), F.max("start").alias("start"), F.max("named").alias("named"), F.max("closed").alias("complete"))
    stitched = joined.where("named").select("file", "start", "doc_id", (F.col("n") - HEADER).alias("n_tokens"), "complete")
    return inside.unionByName(stitched)


def round_trip(docs: DataFrame, tokenizer: Tokenizer, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and count them: doc_id and n_tokens of each document."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path, tokenizer)
    return counts(spark, path, tokenizer, block_tokens).select("doc_id", "n_tokens")
