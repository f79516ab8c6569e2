"""SentencePiece encoding and decoding by streaming Viterbi.

The search goes over a text from left to right. Each place holds its best way there: its score, and the
piece it ends with as a back pointer. For a unigram model the score is the sum of the pieces' scores. For
a BPE model the ids must be those of merging, which sums can't express; there a step from one piece to the
next costs nothing if the vocabulary lets the two stay apart (their joined text merges into just these two)
and is impossible else. A sequence whose neighbours all stay apart is what merging the whole gives, so one
way to each place is left.

Only a window of the longest piece can still change. Whenever the back pointers of all surviving paths meet
in one boundary, the ids before it are committed.

Some boundaries are certain beforehand: before a word mark if no piece holds a mark after another character,
around characters that no longer piece holds, and at sides of signs where no piece crosses them. What stands
between two of them is a segment whose ids depend on nothing else, so segments are searched once and
remembered (a bounded number of them).

Defined results: a null or empty text has no ids; a text of any length is read whole, in memory that its
longest stretch without a boundary bounds; characters without a piece become byte pieces; decoding gives
the text back, but for U+2581, which the model takes for a space; equal rows give equal ids; an empty
table gives an empty result; other columns are passed through or left out as said.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import REMEMBERED, map_text

MARK = "▁"
MOST_REMEMBERED, LONGEST_REMEMBERED, MOST_NEIGHBOURS = 600_000, 64, 400_000
_PANE = 4096  # characters that are looked at together
_END = "\U0010ffff"  # no piece holds this
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces with scores, as the search needs them; plain values, so that it can be sent to tasks."""

    def __init__(self, pieces: list[tuple[str, float, str]], merges: bool):
        """``pieces`` has the text, the score and the kind (normal, byte, control or unknown) of each id.

        ``merges`` says that it is a BPE model, whose scores rank merges.
        """
        self.merges = merges
        self.ids = {text: k for k, (text, _, kind) in enumerate(pieces) if kind == "normal"}
        self.scores = [score for _, score, _ in pieces]
        self.texts = [text for text, _, _ in pieces]
        self.longest = max(map(len, self.ids), default=1)
        normal = [score for _, score, kind in pieces if kind == "normal"]
        self.unknown_score = min(normal, default=0.0) - UNKNOWN_PENALTY
        found = {int(text[1:-1], 16): k for k, (text, _, kind) in enumerate(pieces) if kind == "byte"}
        self.bytes = [found[b] for b in range(256)] if len(found) == 256 else None
        self.unknown = next((k for k, p in enumerate(pieces) if p[2] == "unknown"), 0)
        self.surface = [bytes([int(text[1:-1], 16)]) if kind == "byte" else text.replace(MARK, " ").encode() if kind == "normal" else b" \xe2\x81\x87 " if kind == "unknown" else b"" for text, _, kind in pieces]
        inner = {c for text in self.ids if len(text) > 1 for c in text}
        alone = "".join(re.escape(chr(c)) for c in [*range(0x20), 0x7F] if chr(c) not in inner)
        crossing = any(MARK in text.lstrip(MARK) for text in self.ids)
        inside = f"[^{alone}]" if crossing else f"[^{MARK}{alone}]"
        self.segments = (f"[{alone}]|" if alone else "") + (f"{inside}+" if crossing else f"{MARK}*{inside}+|{MARK}+")
        # where no piece holds a sign next to another character, sides of a sign are boundaries too; texts
        # with one of the few characters that do stand next to a sign in some piece aren't cut there
        signs = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        touching = {pair for text in self.ids for pair in zip(text, text[1:], strict=False)} if not crossing else set()
        beside = {a if b in signs else b for a, b in touching if (a in signs) != (b in signs)} - {MARK}
        self.beside = "" if crossing else "[" + "".join(map(re.escape, sorted(beside))) + "]" if beside else ""
        sign = "".join(map(re.escape, sorted(signs)))
        self.fine_segments = self.segments if crossing else (f"[{alone}]|" if alone else "") + f"{MARK}*[{sign}]+|{MARK}*[^{MARK}{alone}{sign}]+|{MARK}+"
        if any(_END in text for text in self.ids):
            raise ValueError("a piece holds the character that marks the end of a pane")
        self._apart: dict[int, bool] = {}
        self._trie: dict | None = None

    def __getstate__(self):
        return self.__dict__ | {"_apart": {}, "_trie": None}

    @property
    def trie(self) -> dict:
        """Pieces by their characters: for each, the id of what ends with it (-1 if that is no piece), and what may follow."""
        if self._trie is None:
            nested: dict = {}
            for text, k in self.ids.items():
                node = nested
                for c in text:
                    node = node.setdefault(c, {})
                node[""] = k
            self._trie = _nodes(nested)
        return self._trie

    def apart(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when their joined text is merged; ``left`` is -1 for none."""
        key = left * len(self.scores) + right
        if (known := self._apart.get(key)) is None:
            if len(self._apart) >= MOST_NEIGHBOURS:
                self._apart.clear()
            want = [self.texts[right]] if left < 0 else [self.texts[left], self.texts[right]]
            known = self._apart[key] = merged("".join(want), self) == want
        return known

    @classmethod
    def ranked(cls, path: str) -> Vocabulary:
        """A unigram model by rule: a file's pieces, each with a score of minus the log of its number."""
        found = cls.load(path, True)
        kinds = ["normal" if found.ids.get(t) == k else "byte" if k in (found.bytes or ()) else "unknown" if k == found.unknown else "control" for k, t in enumerate(found.texts)]
        return cls([(t, -math.log(k + 1), kind) for k, (t, kind) in enumerate(zip(found.texts, kinds, strict=True))], False)

    @classmethod
    def load(cls, path: str, merges: bool) -> Vocabulary:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda k: "unknown" if sp.is_unknown(k) else "byte" if sp.is_byte(k) else "control" if sp.is_control(k) or sp.is_unused(k) else "normal"
        return cls([(sp.id_to_piece(k), sp.get_score(k), kind(k)) for k in range(sp.get_piece_size())], merges)

    def __len__(self) -> int:
        return len(self.scores)


def _nodes(nested: dict) -> dict:
    return {c: (node.get("", -1), _nodes(node)) for c, node in nested.items() if c}


def merged(text: str, vocabulary: Vocabulary) -> list[str]:
    """Merge the neighbours with the best-scored joint piece, leftmost first, until none is left."""
    ids, scores = vocabulary.ids, vocabulary.scores
    parts: list[str] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    queue: list[tuple[float, int, str]] = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] < len(parts):
            joint = parts[at] + parts[after[at]]
            if joint in ids:
                heapq.heappush(queue, (-scores[ids[joint]], at, joint))

    for at in range(len(parts)):
        offer(at)
    while queue:
        _, at, joint = heapq.heappop(queue)
        to = after[at]
        if not parts[at] or to >= len(parts) or parts[at] + parts[to] != joint:
            continue  # one of the two has been merged otherwise
        parts[at], parts[to] = joint, ""
        after[at] = after[to]
        if after[to] < len(parts):
            before[after[to]] = at
        offer(before[at])
        offer(at)
    return [p for p in parts if p]


def commits(text: str, vocabulary: Vocabulary) -> Iterator[list[tuple[int, int]]]:
    """The best segmentation in commits, each a list of (end, id); a negative id is an unknown character.

    Places and their back pointers are a tree. A place is a leaf while pieces may still begin there; one that
    none began at is cut off, and its way back with it. As soon as the last committed boundary has a single
    branch, all surviving paths go through that branch's place, which is committed. What is held are the places
    from the last boundary on; a place that no piece reaches any more is at most one longest piece back.
    On equal scores the piece that begins first stays.
    """
    trie, ids, scores, merges, longest = vocabulary.trie, vocabulary.ids, vocabulary.scores, vocabulary.merges, vocabulary.longest
    apart, known, size, unknown = vocabulary.apart, vocabulary._apart.get, len(vocabulary), vocabulary.unknown_score
    off, base, begin, n = 0, 0, 0, len(text)  # the pane's first place; in the pane: the last boundary, the place to go on
    # of a pane's places: the id of the best way's last piece (none: not reached), where that begins, the way's
    # score, branches and the sum of their places
    last: list[int | None] = [-1]
    back, score, branches, sums = [0], [0.0], [0], [0]
    pane = _PANE
    while True:
        view = text[off : off + pane] + _END
        held = len(view)
        ends = off + held > n
        more = held - len(last)
        last += [None] * more
        back += [0] * more
        branches += [0] * more
        sums += [0] * more
        if not merges:
            score += [0.0] * more
        stop = held - 1 if ends else held - longest
        for at in range(begin, stop):
            left = last[at]
            if left is None:
                continue
            children, end, mine, total, cut = trie, at, 0, 0, at == base
            if merges:
                row = left * size
                while (node := children.get(view[end])) is not None:
                    piece, children = node
                    end += 1
                    if piece >= 0 and last[end] is None and (apart(left, piece) if (ok := known(row + piece)) is None else ok):
                        last[end], back[end] = piece, at
                        mine += 1
                        total += end
                if last[at + 1] is None and view[at] not in ids:  # an unknown character is a step of its own
                    last[at + 1], back[at + 1] = -1, at
                    mine += 1
                    total += at + 1
            else:
                here = score[at]
                found = [] if view[at] in ids else [(at + 1, -1, here + unknown)]
                while (node := children.get(view[end])) is not None:
                    piece, children = node
                    end += 1
                    if piece >= 0:
                        found.append((end, piece, here + scores[piece]))
                for end, piece, way in found:
                    if last[end] is not None:
                        if way <= score[end]:
                            continue
                        cut |= _leave(end, back, branches, sums, base)  # the place leaves its former branch
                    score[end], last[end], back[end] = way, piece, at
                    mine += 1
                    total += end
            if mine:
                branches[at], sums[at] = mine, total
            else:
                cut |= _leave(at, back, branches, sums, base)
            if cut and branches[base] == 1:
                out = []
                while base <= at and branches[base] == 1:
                    base = sums[base]
                    out.append((base + off, last[base]))
                yield out
        if ends:
            return
        # the next pane begins with the last boundary
        pane = max(_PANE, 2 * (stop - base) + longest)
        off, begin = off + base, stop - base
        last, back, branches, sums = last[base:], [x - base for x in back[base:]], branches[base:], [x - base * k for x, k in zip(sums[base:], branches[base:], strict=True)]
        score, base = score[base:], 0


def _leave(place: int, back: list[int], branches: list[int], sums: list[int], base: int) -> bool:
    """Take a place off its branch, and those before it that had no other and are done with; always true."""
    while place > base:
        before = back[place]
        if not branches[before]:  # the place at work: its branches aren't counted yet
            break
        branches[before] -= 1
        sums[before] -= place
        if branches[before]:
            break
        place = before
    return True


def encode_segment(text: str, vocabulary: Vocabulary) -> list[int]:
    out: list[int] = []
    for part in commits(text, vocabulary):
        for end, piece in part:
            if piece >= 0:
                out.append(piece)
            elif vocabulary.bytes is None:
                out.append(vocabulary.unknown)
            else:
                out += [vocabulary.bytes[b] for b in text[end - 1].encode("utf-8", "surrogatepass")]
    return out


class Encoder(dict):
    """Remembers segments: text to ids as bytes. Those not asked for while as many others were are forgotten."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.kind, self.code = (np.uint16, "H") if len(vocabulary) <= 1 << 16 else (np.uint32, "I")
        self.whole, self.fine = (re.compile(x, re.S).findall for x in (vocabulary.segments, vocabulary.fine_segments))
        self.beside = re.compile(vocabulary.beside).search if vocabulary.beside else lambda _: False
        self.older: dict[str, bytes] = {}

    def __missing__(self, segment: str) -> bytes:
        ids = self.older.get(segment)
        if ids is None:
            ids = array(self.code, encode_segment(segment, self.vocabulary)).tobytes()
        if len(segment) <= LONGEST_REMEMBERED:
            if len(self) >= MOST_REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[segment] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, as little-endian numbers of the encoder's kind."""
        if not text:
            return b""
        find = self.whole if self.beside(text) else self.fine
        return b"".join(map(self.__getitem__, find(MARK + text.replace(" ", MARK))))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that ids stand for, without the mark that was put before it."""
        whole = b"".join(map(self.vocabulary.surface.__getitem__, np.frombuffer(ids, self.kind).tolist()))
        return whole[1:] if whole.startswith(b" ") else whole


_encoders: dict[int, Encoder] = {}  # of this worker process: that of the vocabulary in use
REMEMBERED.append(_encoders)


def _encoder(vocabulary: Vocabulary) -> Encoder:
    key = id(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def share(spark: SparkSession, vocabulary: Vocabulary, most: int = 1 << 20):
    """Send a vocabulary of at most ``most`` pieces to all executors."""
    if len(vocabulary) > most:
        raise ValueError(f"a vocabulary of {len(vocabulary)} pieces is more than is sent to every executor")
    return spark.sparkContext.broadcast(vocabulary)


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id if not given) with ids, their number, and whether they decode to the text."""
    keep = ["doc_id"] if keep is None else keep
    shared = share(docs.sparkSession, vocabulary)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(shared.value)
        texts = batch.column("t_text").to_pylist()
        ids = list(map(encoder.encode, texts))
        same = [encoder.decode(x) == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]
        sizes = np.array(list(map(len, ids)), np.int64) // np.dtype(encoder.kind).itemsize
        values = np.frombuffer(b"".join(ids), encoder.kind).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))
        return pa.RecordBatch.from_arrays([*(batch.column(f"c_{c}") for c in keep), lists, pa.array(sizes), pa.array(same)], [*keep, "ids", "n_tokens", "round_trip"])

    base = docs.select(*(F.col(f"`{c}`").alias(f"c_{c}") for c in keep), F.col("text").alias("t_text"))
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")
    return map_text(base, "t_text", work, schema, remembers=True)


def decode(coded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text."""
    shared = share(coded.sparkSession, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = [None if x is None else encoder.decode(np.array(x, encoder.kind).tobytes()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(work, "doc_id long, text string")
