import random
import re

import pytest
from pyspark.sql import functions as F

from common import ROWS, awkward, nothing
from peerglyph.llm import decontaminate as d

BENCH = "item_id long, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def distance(pattern, text):
    """Least edit distance to any stretch of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(2000):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 90 if rng.random() < 0.1 else 12))]
        t = [rng.randrange(4) for _ in range(rng.randrange(30))]
        assert d.myers(p, t)[0] == distance(p, t)


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        k = rng.randrange(len(w))
        match rng.randrange(3):
            case 0:
                w[k] = f"new{rng.randrange(99)}"
            case 1:
                del w[k]
            case _:
                w.insert(k, f"add{rng.randrange(99)}")
    return w


@pytest.mark.parametrize("seed", [1, 2])
def test_all_items_within_their_budget_are_found(spark, seed):
    rng = random.Random(seed)
    items = [(k, [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 40))]) for k in range(25)]
    docs = []
    for i in range(150):
        w = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(60))]
        if rng.random() < 0.7:
            _, pattern = rng.choice(items)
            at = rng.randrange(len(w) + 1)
            w[at:at] = edited(rng, pattern, rng.randrange(7)) if len(pattern) > 8 else pattern
        docs.append((i, ", ".join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], BENCH)
    want = set()
    for i, text in docs:
        for k, pattern in items:
            budget = min(int(d.ERROR_RATE * len(pattern)), max(0, len(pattern) // d.LEAST_PIECE - 1))
            least = distance(pattern, words(text))
            if least <= budget:
                want.add((i, k, least))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.distance) for r in d.matches(df, bench, least_words=1).collect()} == want
    assert {(r.doc_id, r.item_id, r.distance) for r in d.matches(df, bench, block_items=4, least_words=1).collect()} == want
    long = {k for k, w in items if len(w) >= d.LEAST_WORDS}
    assert {(r.doc_id, r.item_id, r.distance) for r in d.matches(df, bench).collect()} == {x for x in want if x[1] in long}
    for blocks in ({}, {"block_items": 7}, {"block_items": 7, "most_anchors": 20}):
        dirty = {i for i, k, _ in want}
        assert {r.doc_id for r in d.keep_clean(df, bench, least_words=1, **blocks).collect()} == {i for i, _ in docs} - dirty


def test_no_stage_holds_two_blocks(spark):
    bench = spark.range(60).selectExpr("id as item_id", "concat_ws(' ', transform(sequence(1, 12), k -> concat('w', id * 12 + k))) as text")
    docs = spark.range(300).selectExpr("id as doc_id", "if(id % 10 = 0, concat_ws(' ', transform(sequence(1, 12), k -> concat('w', (id % 60) * 12 + k))), 'other words') as text")
    before = d._without
    stages = []
    d._without = lambda docs, items: stages.append(len(items.ids)) or before(docs, items)
    try:
        clean = d.keep_clean(docs, bench, block_items=10)
    finally:
        d._without = before
    assert stages == [10] * 6 and clean.count() == 270
    assert clean._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # the texts without any piece; the others are written


def test_a_block_is_small_and_built_at_once():
    import pickle
    import time

    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randrange(50_000)}" for _ in range(60))) for k in range(20_000)]
    start = time.process_time()
    items = d.Items.build(rows, d.ERROR_RATE)
    assert time.process_time() - start < 5 and len(pickle.dumps(items)) < 40 << 20


def test_place_of_a_match(spark):
    bench = spark.createDataFrame([(9, "the quick brown fox jumps over the lazy dog again and again today")], BENCH)
    docs = spark.createDataFrame([(1, "so THE quick, brown fox: jumps over a lazy dog again and again today! end")], "doc_id long, text string")
    r = d.matches(docs, bench).first()
    assert (r.doc_id, r.item_id, r.distance, r.first_word, r.n_words, r.item_words) == (1, 9, 1, 1, 13, 13)


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "two three four five six"), (2, "two three four five six"), (3, None), (4, ""), (5, "..."), (None, "one"), (6, "twice the same row"), (7, "中文 \U00010348")], BENCH).withColumn("text2", F.lit(1))
    got = sorted((str(r.doc_id), r.item_id) for r in d.matches(awkward(spark), bench, least_words=1).collect())
    assert got == [("1", 1), ("1", 2), ("6", 7), ("7", 6), ("7", 6)]
    assert sorted((str(r.doc_id), r.item_id) for r in d.matches(awkward(spark), bench).collect()) == [x for x in got if x[1] != 7]
    clean = d.keep_clean(awkward(spark), bench, least_words=1)
    assert clean.columns == awkward(spark).columns and clean.count() == len(ROWS) - 4
    assert d.matches(nothing(spark), bench).count() == 0 and d.keep_clean(nothing(spark), bench).count() == 0
    none = spark.createDataFrame([], BENCH)
    assert d.matches(awkward(spark), none).count() == 0 and d.keep_clean(awkward(spark), none).count() == len(ROWS)
