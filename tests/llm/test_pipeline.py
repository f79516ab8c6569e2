import hashlib
from collections import Counter

import corpus_pipeline as cp
import pytest
import sentencepiece

from common import awkward
from oracle import assert_same, connect
from peerglyph.llm import quality, queries
from test_decontaminate import distance, words
from test_simhash import near_low
from test_quality import base

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name])


def cut(text, seen, window=35):
    """A text without the words of windows that stand anywhere else, and its digest."""
    w = text.split()
    gone = {j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
    return [x for j, x in enumerate(w) if j not in gone]


def test_the_pipeline_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r.doc_id for r in quality.judge(docs, field).where("kept").collect()}  # the field has its own tests
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert all(not base(t)[5] for i, t in rows if i in kept)
    rows = [(i, t) for i, t in rows if i in kept]
    rows = [(i, t) for (i, t), first in zip(rows, near_low(rows), strict=True) if i == first]
    seen = Counter(tuple(w[k : k + 35]) for _, t in rows for w in [t.split()] for k in range(len(w) - 34))
    rows = [(i, cut(t, seen)) for i, t in rows]
    items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    exact = lambda p, w: any(w[k : k + len(p)] == p for k in range(len(w) - len(p) + 1))
    want = {i: hashlib.sha256(" ".join(w).encode()).hexdigest() for i, w in rows if not any(exact(p, words(" ".join(w))) for p in items)}
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    got = {r.doc_id: sp.decode(r.ids) for r in cp.run(spark, sf_dir).collect()}
    digest = {i: hashlib.sha256(" ".join(t.split()).encode()).hexdigest() for i, t in got.items()}
    missed = {i for i in want if i not in digest}  # items with edits, which the exact search above leaves
    texts = dict(rows)
    assert all(min(distance(p, words(" ".join(texts[i]))) / len(p) for p in items) <= 0.15 for i in missed) and len(missed) <= 2
    assert {i: want[i] for i in digest} == digest


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_dedup", "substring_dedup", "benchmark_decontamination", "sentencepiece"]
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == COLUMNS and out.dtypes == docs.dtypes


def test_stages_on_awkward_rows(spark, sf_dir):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns with names that operators use."""
    docs = awkward(spark)
    want = {
        "quality_rules": [],  # none of them has 20 words that aren't repeated
        "simhash_dedup": ["1", "2", "5", "6", "7", "8", "None"],
        "substring_dedup": ["1", "2", "3", "4", "5", "6", "7", "7", "8", "None"],
        "benchmark_decontamination": ["1", "2", "3", "4", "5", "6", "7", "7", "8", "None"],
        "sentencepiece": ["1", "2", "3", "4", "5", "6", "7", "7", "8", "None"],
    }
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        assert sorted(str(r.doc_id) for r in out.collect()) == want[name], name
        assert out.columns == (docs.columns if name != "sentencepiece" else ["doc_id", "lang", "source", "ids", "n_tokens", "round_trip"])


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
