import numpy as np
import pytest

from common import ROWS, awkward, nothing
from peerglyph.llm import tokenfiles as k
from peerglyph.llm.queries import RANKS, RANKS_END


@pytest.fixture(scope="module")
def tokenizer():
    return k.Tokenizer.load(RANKS, RANKS_END)


@pytest.fixture(scope="module")
def small():
    """Bytes alone, in 32-bit tokens."""
    return k.Tokenizer({bytes([b]): b for b in range(256)}, 70_000)


def expect(rows, tokenizer):
    encode = tokenizer.encoding().encode_ordinary
    return sorted((str(i), len(encode(t or ""))) for i, t, *_ in rows)


@pytest.mark.parametrize("block", [6, 7, 1000, 1 << 18])
def test_counts_at_any_block_size(spark, tokenizer, block):
    rows = [r for r in ROWS if r[0] != 5] + [(-3, "negative id"), (2**62, "large id")]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert sorted((str(r[0]), r[1]) for r in k.round_trip(docs, tokenizer, block).collect()) == expect(rows, tokenizer)


def test_awkward_rows(spark, tokenizer, small):
    assert sorted((str(r[0]), r[1]) for r in k.round_trip(awkward(spark), tokenizer).collect()) == expect(ROWS, tokenizer)
    assert sorted((str(r[0]), r[1]) for r in k.round_trip(awkward(spark), small, 1000).collect()) == expect(ROWS, small)
    assert k.round_trip(nothing(spark), tokenizer).count() == 0


def test_files_are_flat_tokens(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame([(5, "some words"), (6, "")], "doc_id long, text string").coalesce(1)
    k.write(docs, f"file://{tmp_path}/t", tokenizer)
    data = np.frombuffer(next((tmp_path / "t").glob("part-*")).read_bytes(), np.uint16).tolist()
    assert data == [*k.header(5), *tokenizer.encoding().encode_ordinary("some words"), RANKS_END, *k.header(6), RANKS_END]


@pytest.mark.parametrize("block", [6, 8, 1 << 18])
def test_a_file_without_a_last_separator(spark, tokenizer, tmp_path, block):
    tokens = np.array([*k.header(1), 9, 9, RANKS_END, *k.header(2), 9], np.uint16)
    (tmp_path / "cut.bin").write_bytes(tokens.tobytes())
    got = sorted((r.doc_id, r.n_tokens, r.complete, r.start) for r in k.counts(spark, f"file://{tmp_path}/cut.bin", tokenizer, block).collect())
    assert got == [(1, 2, True, 0), (2, 1, False, 8)]


def test_separators_that_could_be_header_tokens_are_refused():
    with pytest.raises(ValueError):
        k.Tokenizer({b"a": 0}, 300)


def test_texts_in_parts_give_the_ids_of_the_whole(tokenizer, monkeypatch):
    encoding = tokenizer.encoding()
    rng = np.random.default_rng(6)
    signs = [" ", " ", " ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "᠎", "​", " ", "　", "a", "word", "é", "中", "1", "!", "'s", "́"]
    for run, part in ((3, 5), (2, 1), (5, 40)):
        monkeypatch.setattr(k, "LONG_RUN", run)
        monkeypatch.setattr(k, "PART", part)
        monkeypatch.setattr(k, "_RUN", k.re.compile(f"[{k.WHITE}]{{{run},}}"))
        for _ in range(1500):
            text = "".join(rng.choice(signs, int(rng.integers(0, 40))))
            assert k.encode(text, encoding).tolist() == encoding.encode_ordinary(text), repr(text)


def test_long_white_space_and_long_words_are_counted_whole(spark, tokenizer):
    texts = [" " * 3_000_000, "\n" * 3_000_000 + "end", "ab" * 1_500_000, "!" * 1_000_000, "word " * 600_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in k.round_trip(docs, tokenizer).collect()}
    encoding = tokenizer.encoding()
    assert got[0] == len(encoding._encode_single_piece(texts[0])) and got[4] == len(encoding.encode_ordinary(texts[4]))
    assert all(encoding.decode(k.encode(t, encoding).tolist()) == t for t in texts)


def test_a_file_is_shared_by_tasks(spark, tokenizer, tmp_path):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat(concat('some words ', id, ' '), 1 + id % 7) as text").coalesce(1)
    k.write(docs, f"file://{tmp_path}/t", tokenizer)
    listed = k.files(spark, f"file://{tmp_path}/t")
    cut = k.units(listed, 4 * 100 * 2)
    assert listed.count() == 1 and cut.count() > 8 and k.deal(cut, cut.count()).rdd.getNumPartitions() == cut.count()
    assert cut.selectExpr("sum(high - low) as n").first().n == listed.first().size
    want = sorted((r.doc_id, len(tokenizer.encoding().encode_ordinary(r.text))) for r in docs.collect())
    for unit in (1, 4):
        found = k.scan(spark, f"file://{tmp_path}/t", tokenizer, 100, unit)
        assert found.rdd.getNumPartitions() > 8
        assert sorted((r.doc_id, r.n_tokens) for r in k.counts(spark, f"file://{tmp_path}/t", tokenizer, 100).collect()) == want


def test_files_that_only_spark_can_open(spark, tokenizer, tmp_path, monkeypatch):
    docs = spark.range(50).selectExpr("id as doc_id", "'some words' as text")
    k.write(docs, f"file://{tmp_path}/t", tokenizer)
    monkeypatch.setattr(k, "readable", lambda listed: False)
    assert k.counts(spark, f"file://{tmp_path}/t", tokenizer, 40).count() == 50
