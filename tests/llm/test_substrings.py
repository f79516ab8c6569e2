import hashlib
import random
from collections import Counter

import pytest

from common import ROWS, awkward, nothing
from peerglyph.llm import substrings as s


def plain(rows, window):
    """For each row: words, removed words, digest of the kept words."""
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, seed", [(5, 1), (6, 2), (9, 3), (35, 4)])
def test_removed_words_are_those_of_a_plain_version(spark, window, seed):
    rng = random.Random(seed)
    passages = [[f"p{k}w{j}" for j in range(rng.randrange(window - 2, 3 * window))] for k in range(12)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(passages)[rng.randrange(3) :] if rng.random() < 0.5 else [f"u{rng.randrange(4)}" for _ in range(rng.randrange(2 * window))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(100, rows[3][1]), (100, rows[3][1]), (101, " ".join(["same"] * 3 * window))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (300, 4 << 20):
        assert sorted((tuple(r) for r in s.measure(df, window, size).collect()), key=str) == plain(rows, window)


def test_a_window_at_any_place_against_blocks(spark):
    """A run of exactly a window's length is found wherever it stands in either text."""
    run = [f"r{k}" for k in range(9)]
    rows = [(i, " ".join([f"a{i}_{k}" for k in range(i)] + run + [f"b{i}_{k}" for k in range(3)])) for i in range(2)]
    for shift in range(12):
        rows[1] = (1, " ".join([f"x{k}" for k in range(shift)] + run))
        got = s.measure(spark.createDataFrame(rows, "doc_id long, text string"), 9).collect()
        assert {r.n_removed for r in got} == {9}


def test_spans_are_maximal(spark):
    run = " ".join(f"r{k}" for k in range(20))
    rows = [(1, f"a b {run} c"), (2, f"{run} d {run}"), (3, "e f")]
    got = sorted((r.doc_id, r.first_word, r.n_words, r.span) for r in s.spans(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect())
    assert got == [(1, 2, 20, run), (2, 0, 20, run), (2, 21, 20, run)]


def test_texts_lose_the_runs_and_nothing_else(spark):
    run = " ".join(f"r{k}" for k in range(10))
    rows = [(1, f"keep\n this  {run} and\nthat", "x", 5), (2, run, "y", 6), (3, " left  as\nit is ", "z", None)]
    got = {r.doc_id: r for r in s.remove(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long"), 7).collect()}
    assert got[1].text == "keep\n this and\nthat" and got[1].n_chars == len(got[1].text) and got[1].lang == "x"
    assert got[2].text == "" and got[2].n_chars == 0
    assert got[3].text == " left  as\nit is " and got[3].n_chars is None


def test_awkward_rows(spark):
    got = sorted((tuple(r) for r in s.measure(awkward(spark), 5).collect()), key=str)
    assert got == plain([(i, t) for i, t, *_ in ROWS], 5)
    removed = s.remove(awkward(spark), 5)
    assert removed.columns == awkward(spark).columns and removed.count() == len(ROWS)
    assert s.measure(nothing(spark)).count() == 0 and s.remove(nothing(spark)).count() == 0 and s.spans(nothing(spark)).count() == 0


def test_packed_keys_come_back():
    import numpy as np

    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    flags = np.random.default_rng(2).random((1000, 2)) < 0.5
    for drop in (0, 24):
        width, body = s._pack(keys, 0, drop, flags, b"tail")
        back, marks, extra = s._unpack(1000, width, body)
        assert (back == keys >> np.uint64(drop)).all() and (marks == flags).all() and extra == b"tail"


def test_messages_grow_with_the_corpus():
    for size in (1 << 20, 1 << 30, 30 << 30, 1 << 40, 100 << 40):
        buckets = max(1, -(-size // s.bucket_size(size)))
        assert buckets**2 <= max(1, size / s.MESSAGE_BYTES * 1.01) and s.bucket_size(size) <= 400 << 20
    assert s.bucket_size(1 << 30) == s.BUCKET_BYTES


def test_equal_rows_are_dealt_to_many_buckets(spark):
    """A row without an id that is a third of the table doesn't lie in one bucket; texts are shuffled once."""
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) as doc_id", f"if(id % 3 = 0, '{text}', concat('text ', id)) as text")
    rows = s.measure(docs, 35, 4000)
    assert rows.where("doc_id is null and n_removed = 40").count() == 1000 and rows.where("doc_id is not null and n_removed = 0").count() == 2000
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("monotonically_increasing_id") and "t_text" in plan
    dealt = docs.selectExpr("doc_id", "pmod(xxhash64(monotonically_increasing_id()), 40) as b").where("doc_id is null").groupBy("b").count()
    assert dealt.agg({"count": "max"}).first()[0] < 80
