import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from common import ROWS, awkward, nothing
from peerglyph.llm import toxicity as t


def test_sentences_and_their_rows():
    s = t.Sentences(pa.array(["One two. Three!four\nfive", None, "", "...", "six"]))
    assert s.heads.tolist() == [0, 2, 3, 4, 5] and s.sentence_row.tolist() == [0, 0, 0, 0, 4]


def test_noisy_or_is_one_minus_the_product():
    rng = np.random.default_rng(1)
    z, row = rng.normal(size=9), np.array([0, 0, 0, 2, 2, 2, 2, 3, 3])
    p = 1 / (1 + np.exp(-z))
    want = [1 - np.prod(1 - p[row == k]) for k in range(4)]
    assert t.noisy_or(z, row, 4) == pytest.approx(want) and want[1] == 0


def test_score_is_that_of_a_plain_version(spark):
    rng = np.random.default_rng(2)
    model = t.SentenceModel(rng.normal(size=1 << t.BUCKET_BITS) * 0.3, -2.0)
    text = "Bad words here. Good ones! and more\nbad again?"
    got = t.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().score
    clean = 1.0
    for sentence in re.split(r"[.!?\n]", text):
        if words := re.findall(r"[a-z0-9]+", sentence.lower()):
            z = model.bias + sum(model.weights[b] for w in words for b in t.Sentences(pa.array([w])).buckets[0])
            clean *= 1 - 1 / (1 + np.exp(-z))
    assert got == pytest.approx(1 - clean)


def corpus(spark, n=400):
    """Documents of which every fifth has an insulting sentence; its place varies."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(words, 8)) for _ in range(6)]
        if i % 5 == 0:
            sentences[int(rng.integers(6))] += " you " + rng.choice(["horrid", "vile"]) + " thing"
        rows.append((i, ". ".join(sentences)))
        labels.append((i, 1, int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_located_sentences(spark):
    docs, labels = corpus(spark)
    model = t.fit(docs, labels)
    rows = t.score(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    found = t.offending(docs, model).collect()
    assert found and np.mean([("horrid" in r.text) or ("vile" in r.text) for r in found]) > 0.95
    assert len({r.doc_id for r in found}) > 70


def test_held_out_labels_are_not_learnt_from(spark):
    docs, labels = corpus(spark)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = t.fit(docs, labels), t.fit(docs, flipped)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_settings_come_from_rows_that_may_teach(spark):
    rng = np.random.default_rng(8)
    ids = np.array([i for i in range(600) if zlib.crc32(str(i).encode()) % 5])
    label = (rng.random(len(ids)) < 0.3).astype(int)
    words = [rng.integers(0, 500, (12, t.PER_WORD)).astype(np.int32) for _ in ids]
    for w, y in zip(words, label, strict=True):
        w[5] = 1000 + rng.integers(2) if y else w[5]
    examples = t.Examples(ids, label, words, [np.array([0, 6]) for _ in ids])
    # a model that shrinks everything away loses on the rows that choose; the order of settings has no part in it
    for settings in (((7.0, 10.0), (7.0, 1e-4)), ((7.0, 1e-4), (7.0, 10.0))):
        assert t.choose(examples, np.ones(len(ids)), 60, 3, settings) == (7.0, 1e-4)
    assert t.choose(examples.take(np.flatnonzero(label == 0)), np.ones(len(ids)), 60, 3) == t.SETTINGS[0]


def test_one_text_is_read_for_an_id(spark):
    docs, labels = corpus(spark, 100)
    many = docs.unionByName(docs.where("doc_id = 5").selectExpr("doc_id", "text").crossJoin(spark.range(500)).select("doc_id", "text"))
    a, b = t.fit(docs, labels), t.fit(many, labels)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_sentences_of_other_scripts():
    s = t.Sentences(pa.array(["你是坏人。今天好！Ja ok｡नमस्ते दुनिया। फिर", "ab中文cd", "สวัสดี"]))
    starts = [s.buf[a:b].tobytes().decode() for a, b in zip(s.starts.tolist(), s.ends.tolist(), strict=True)]
    assert starts == ["你是", "是坏", "坏人", "人", "今天", "天好", "好", "ja", "ok", "नमस्ते", "दुनिया", "फिर", "ab", "中文", "文", "cd", *["สว", "วั", "ัส", "สด", "ดี", "ี"]]
    assert [starts[h] for h in s.heads] == ["你是", "今天", "ja", "नमस्ते", "फिर", "ab", "สว"]
    assert s.sentence_row.tolist() == [0, 0, 0, 0, 0, 1, 2]
    assert (s.buckets[3] == s.buckets[3][0]).all() and s.buckets[2][1] != s.buckets[2][0]


def test_toxic_sentences_without_spaces(spark):
    rng = np.random.default_rng(4)
    signs = [chr(c) for c in range(0x4E00, 0x4E60)]
    rows, labels = [], []
    for i in range(300):
        sentences = ["".join(rng.choice(signs, 10)) for _ in range(5)]
        if i % 4 == 0:
            sentences[int(rng.integers(5))] += "混蛋"
        rows.append((i, "。".join(sentences)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = t.fit(docs, marks)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in t.score(docs, model).where("held_out").collect()]) > 0.95
    assert np.mean(["混蛋" in r.text for r in t.offending(docs, model).collect()]) > 0.95


def test_the_driver_tables(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = t.score(docs, t.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r.score for r in rows if r.toxic == c] for c in (1, 0))
    auc = np.mean([(np.array(clean) < x).mean() + (np.array(clean) == x).mean() / 2 for x in toxic])
    assert auc > 0.95 and np.mean([x >= 0.5 for x in clean]) < 0.01


def test_awkward_rows(spark):
    model = t.SentenceModel(np.zeros(1 << t.BUCKET_BITS), -1.0)
    got = {r.doc_id: r for r in t.score(awkward(spark), model).collect()}
    assert len(t.score(awkward(spark), model).collect()) == len(ROWS)
    assert got[2].score == got[3].score == got[4].score == 0 and got[None].held_out
    assert t.score(nothing(spark), model).count() == 0 and t.offending(nothing(spark), model).count() == 0
    for rows in ([], [(1, 1, 1)], [(1, None, None)]):
        empty = t.fit(awkward(spark), spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert {r.score for r in t.score(awkward(spark), empty).collect()} == {0.0}
