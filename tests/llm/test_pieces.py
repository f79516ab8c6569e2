import random

import numpy as np
import pytest
import sentencepiece

from common import ROWS, awkward, nothing
from peerglyph.llm import pieces as p
from peerglyph.llm.queries import PIECES

RANDOM = random.Random(3)
PARTS = ["a", "b", "  ", " ", "\n", "é", "\U0001d11e", "th", "=", "-", "中", "\t", "#", "\x00", "the", "ing ", "===", "²", "m²", "².", "_", "__", "e.g", "!_", "(_"]


@pytest.fixture(scope="module")
def bpe():
    return p.Vocabulary.load(PIECES, merges=True)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), encoder.kind).tolist()


def test_ids_are_those_of_the_library(bpe, spark, sf_dir):
    sp, encoder = sentencepiece.SentencePieceProcessor(model_file=PIECES), p.Encoder(bpe)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["".join(RANDOM.choice(PARTS) for _ in range(RANDOM.randrange(60))) for _ in range(1000)]
    for text in texts:
        assert ids(encoder, text) == sp.encode(text)
        assert encoder.decode(encoder.encode(text)) == text.encode()


def small(merges=False):
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "bca"]
    return p.Vocabulary([("<unk>", 0.0, "unknown"), *((w, -1.0 - RANDOM.random() * 5, "normal") for w in words), *((f"<0x{b:02X}>", 0.0, "byte") for b in range(256))], merges)


def best(text, v):
    """Greatest total score, by trying all pieces at all places."""
    table = [0.0] + [float("-inf")] * len(text)
    for at in range(len(text)):
        for end in range(at + 1, len(text) + 1):
            k = v.ids.get(text[at:end])
            if k is not None:
                table[end] = max(table[end], table[at] + v.scores[k])
        if v.ids.get(text[at]) is None:
            table[at + 1] = max(table[at + 1], table[at] + v.unknown_score)
    return table[-1]


def test_unigram_search_is_optimal_and_commits_cover_the_text():
    v = small()
    for _ in range(300):
        text = "".join(RANDOM.choice("abcx▁") for _ in range(RANDOM.randrange(1, 40)))
        found = [x for part in p.commits(text, v) for x in part]
        assert sum(v.scores[k] if k >= 0 else v.unknown_score for _, k in found) == pytest.approx(best(text, v))
        ends = [0, *(e for e, _ in found)]
        assert ends[-1] == len(text) and all(text[a:b] == (v.texts[k] if k >= 0 else text[a]) for a, b, (_, k) in zip(ends, ends[1:], found, strict=False))


def test_commits_keep_the_window_bounded(bpe):
    parts = [len(x) for x in p.commits("=" * 20000 + "ththere" * 5000, bpe)]
    assert len(parts) > 1000 and max(parts) < 200


def plain_commits(text, v):
    """After each place: the last place that all surviving ways to places that can still be left go through."""
    score, back, out = {0: 0.0}, {}, []
    for at in range(len(text)):
        if at in score:
            known = [(end, v.ids[text[at:end]]) for end in range(at + 1, len(text) + 1) if text[at:end] in v.ids]
            for end, k in [*([(at + 1, -1)] if text[at] not in v.ids else []), *known]:
                way = score[at] + (v.scores[k] if k >= 0 else v.unknown_score)
                if end not in score or way > score[end]:
                    score[end], back[end] = way, at
        ways = []
        for leaf in (x for x in score if x > at):
            way = [leaf]
            while way[-1]:
                way.append(back[way[-1]])
            ways.append(set(way))
        out.append(max(set.intersection(*ways)))
    return out


def test_ids_are_committed_as_soon_as_all_ways_meet():
    v = small()
    for _ in range(300):
        text = "".join(RANDOM.choice("abcx▁") for _ in range(RANDOM.randrange(1, 30)))
        want = [0, *plain_commits(text, v)]
        got = [part[-1][0] for part in p.commits(text, v)]
        assert got == [b for a, b in zip(want, want[1:], strict=False) if b > a]


def unigram_model(pieces):
    """A unigram model file: pieces with scores, kinds and byte pieces; nothing is changed in a text but spaces."""
    import struct

    def field(number, value):
        if isinstance(value, bytes):
            return bytes([number << 3 | 2]) + length(len(value)) + value
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        return length(number << 3) + length(value)

    def length(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    kinds = {"normal": 1, "unknown": 2, "byte": 6}
    body = b"".join(field(1, field(1, t.encode()) + field(2, score) + field(3, kinds[kind])) for t, score, kind in pieces)
    return body + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


def test_unigram_ids_are_those_of_the_library():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcé▁") for _ in range(rng.randrange(2, 6))) for _ in range(120)})
    pieces = [("<unk>", 0.0, "unknown"), *((f"<0x{b:02X}>", 0.0, "byte") for b in range(256)), *((w, -rng.randrange(1024, 10240) / 1024, "normal") for w in ["▁", "a", "b", "c", "é", *words])]  # sums are exact, so ties are ties
    sp = sentencepiece.SentencePieceProcessor(model_proto=unigram_model(pieces))
    v = p.Vocabulary([(t, score, kind) for t, score, kind in pieces], False)
    encoder = p.Encoder(v)
    for _ in range(2000):
        text = "".join(rng.choice("abcé x中 ") for _ in range(rng.randrange(60)))
        assert ids(encoder, text) == sp.encode(text), text
        assert encoder.decode(encoder.encode(text)) == text.encode()


def test_a_model_by_rule_scores_by_rank():
    v = p.Vocabulary.ranked(PIECES)
    assert not v.merges and len(v) == 32000 and v.scores[999] == pytest.approx(-np.log(1000)) and v.bytes and v.unknown == 0
    encoder = p.Encoder(v)
    for text in ("the theory of things", "  two  spaces\n中", ""):
        assert encoder.decode(encoder.encode(text)) == text.encode()
        whole = p.MARK + text.replace(" ", p.MARK) if text else ""
        found = [k for part in p.commits(whole, v) for _, k in part]
        assert sum(v.scores[k] if k >= 0 else v.unknown_score for k in found) == pytest.approx(best(whole, v) if whole else 0)


def test_one_search_over_the_whole_is_the_segments_in_turn(bpe):
    encoder = p.Encoder(bpe)
    for _ in range(300):
        text = "".join(RANDOM.choice([*PARTS, " " * 17, " " * 30]) for _ in range(20))
        if text:
            whole = [k for part in p.commits("▁" + text.replace(" ", "▁"), bpe) for _, k in part if k >= 0]
            assert [k for k in ids(encoder, text) if k not in bpe.bytes] == whole


def test_memory_of_segments_is_bounded(bpe, monkeypatch):
    monkeypatch.setattr(p, "MOST_REMEMBERED", 10)
    encoder = p.Encoder(bpe)
    for k in range(100):
        encoder.encode(f"word{k} other{k}")
        assert len(encoder) + len(encoder.older) <= 10
        assert encoder.encode("word1") == p.Encoder(bpe).encode("word1")


def test_awkward_rows(spark, bpe):
    rows = p.encode(awkward(spark), bpe)
    assert rows.count() == len(ROWS) and rows.where("not round_trip").count() == 0
    assert {r.n_tokens for r in rows.where("doc_id in (2, 3)").collect()} == {0}
    back = {r.doc_id: r.text for r in p.decode(rows.where("doc_id is not null"), bpe).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in ROWS if i is not None)
    assert p.encode(awkward(spark), bpe, ["doc_id", "lang"]).columns == ["doc_id", "lang", "ids", "n_tokens", "round_trip"]
    assert p.encode(nothing(spark), bpe).count() == 0
    assert p.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), bpe).first().text is None


def test_vocabularies_that_are_sent_are_bounded(spark, bpe):
    with pytest.raises(ValueError):
        p.share(spark, bpe, most=10)


def test_panes_give_what_one_look_gives(bpe, monkeypatch):
    v = small()
    texts = ["".join(RANDOM.choice("abcx▁") for _ in range(RANDOM.randrange(1, 300))) for _ in range(100)] + ["ab" * 200, "x" * 200, "▁" * 200]
    more = [p.MARK + "".join(RANDOM.choice(PARTS) for _ in range(80)).replace(" ", p.MARK) for _ in range(100)] + ["=" * 500, p.MARK * 500]
    whole = [[list(p.commits(t, voc)) for t in some] for voc, some in ((v, texts), (bpe, more))]
    for pane in (20, 33, 100):
        monkeypatch.setattr(p, "_PANE", pane)
        assert [[list(p.commits(t, voc)) for t in some] for voc, some in ((v, texts), (bpe, more))] == whole
