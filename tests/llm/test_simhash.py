import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from common import ROWS, awkward, nothing
from peerglyph.llm import simhash as sh


def plain(text, k=3):
    """The fingerprint, shingle by shingle and bit by bit."""
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(fps, radius=2):
    """The smallest reachable id of each row, over all pairs."""
    n = len(fps)
    low = [i for i, _ in fps]
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in range(n):
                if (fps[a][1] ^ fps[b][1]).bit_count() <= radius and low[b] < low[a]:
                    low[a], changed = low[b], True
    return low


def test_fingerprints_are_those_of_a_plain_version(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["The", "tHe", "été", "ÉTÉ", "x", "中文", "a\tb", "c\n\nd"]) for _ in range(n)) for n in [*range(12), 100, 700]] + [None, "", " ", "one"]
    assert [sh.fingerprint(t) for t in texts] == [plain(t) for t in texts]
    spark_hash = spark.range(1).select(F.xxhash64(F.lit("ab cd ef"))).first()[0]
    assert sh.fingerprint("Ab  cd\nef") == spark_hash % 2**64


def test_two_points_within_two_bits_share_a_cell():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = int(rng.integers(0, 2**63)) * 2 + 1
        flips = rng.choice(64, rng.integers(0, 3), replace=False)
        b = a
        for f in flips:
            b ^= 1 << int(f)
        cells = [set(sh.cells(np.array([x], np.uint64))[0].tolist()) for x in (a, b)]
        assert cells[0] & cells[1]
    for edge in (0, 2**64 - 1):
        assert len(sh.cells(np.array([edge], np.uint64))[0]) == 17


@pytest.mark.parametrize("seed", [1, 2])
def test_components_reach_over_chains(spark, seed):
    rng = random.Random(seed)
    fps = []
    for _ in range(6):  # chains of one or two flipped bits, and copies
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.append(x)
            if rng.random() < 0.8:
                for _ in range(rng.randrange(1, 3)):
                    x ^= 1 << rng.randrange(64)
    rows = list(enumerate(fps))
    rng.shuffle(rows)
    signed = [(i, f - 2**64 if f >= 2**63 else f) for i, f in rows]
    distinct = spark.createDataFrame(signed, "doc_id long, fp long").groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = {r.node: r.root for r in sh.connect(sh.links(distinct)).collect()}
    low = {}
    for i, f in signed:
        root = roots.get(f, f)
        low[root] = min(low.get(root, i), i)
    rows.sort()
    assert [low[roots.get(f, f)] for _, f in sorted(signed)] == reachable(rows)


@pytest.mark.parametrize("crowd", [1, 3, 10])
def test_large_cells_are_dealt_out_anew(spark, monkeypatch, crowd):
    """The same components however few rows of a cell are compared in it."""
    monkeypatch.setattr(sh, "CROWD", crowd)
    monkeypatch.setattr(sh, "HELD", 3)
    rng = random.Random(7)
    fps = {0, 3}
    for _ in range(4):
        center = rng.getrandbits(64)
        for _ in range(40):
            fps.add(center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64) if rng.random() < 0.5 else 0))
    rows = list(enumerate(sorted(fps)))
    signed = [(i, f - 2**64 if f >= 2**63 else f) for i, f in rows]
    roots = {r.node: r.root for r in sh.connect(sh.links(spark.createDataFrame(signed, "low long, fp long"))).collect()}
    low = {}
    for i, f in signed:
        low.setdefault(roots.get(f, f), i)
    assert [low[roots.get(f, f)] for _, f in signed] == reachable(rows)


def test_groups_stay_whole_over_batches():
    rng = np.random.default_rng(4)
    key = np.sort(np.concatenate([rng.integers(0, 30, 100), np.full(60, 31), rng.integers(32, 40, 40)]))
    sizes = dict(zip(*np.unique(key, return_counts=True), strict=True))
    for size in (1, 2, 7, 50, 200):
        table = pa.table({"cell": key, "row": np.arange(200)})
        got = list(sh._groups(iter(table.to_batches(max_chunksize=size)), 9))
        for large in (False, True):
            rows = np.concatenate([np.zeros(0, int), *(c[1] for is_large, c in got if is_large == large)])
            assert rows.tolist() == [k for k in range(200) if (sizes[key[k]] > 9) == large and sizes[key[k]] > 1]
        assert all(set(c[0]).isdisjoint(d[0]) for (_, c), (x, d) in zip(got, got[1:], strict=False) if not x)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def word_prints(text):
    """Fingerprints of words, bit by bit; the words' hashes are the operator's."""
    words = (text or "").encode().lower().split()
    one = sh.Words(pa.array([b" ".join(words).decode()]))
    weight = {}
    for h in one.hashes.tolist():
        weight[h] = min(weight.get(h, 0) + 1, sh.MOST_WEIGHT)
    out = []
    for k in range(sh.TABLES):
        hashes = {h: int(sh.mix(np.array([h], np.uint64) + sh.mix(np.array([k + 1], np.uint64)))[0]) for h in weight}
        out.append(sum(1 << b for b in range(64) if 2 * sum(w for h, w in weight.items() if hashes[h] >> b & 1) > sum(weight.values())))
    return out


def near_low(rows, candidates=True):
    """The smallest reachable id of each row over pairs of similar texts (that meet in a cell)."""
    sets, prints, out = [shingles(t) for _, t in rows], [word_prints(t) for _, t in rows], [i for i, _ in rows]

    def meets(a, b):
        return any((x ^ y).bit_count() <= 2 and ((u ^ v) & 0xFFFFFFFF).bit_count() <= sh.OTHER_BITS for x, y, u, v in zip(prints[a], prints[b], prints[a][1:] + prints[a][:1], prints[b][1:] + prints[b][:1], strict=True))

    same = [(t or "").encode().lower().split() for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(len(rows)) if same[a] == same[b] or (5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and (not candidates or meets(a, b)))]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if out[b] < out[a]:
                out[a], changed = out[b], True
    return out


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.random()}"
    return words


@pytest.mark.parametrize("crowd", [2048, 3])
def test_near_copies_are_those_of_all_pairs_that_meet(spark, monkeypatch, crowd):
    monkeypatch.setattr(sh, "CROWD", crowd)
    rng = random.Random(3)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for _ in range(12):
        base = [f"w{rng.random()}" for _ in range(rng.randint(60, 200))]
        rows += [common + base, common + edited(rng, base, 2), edited(rng, common + base, 5), base[: len(base) * 9 // 10]]
        rows.append(common + edited(rng, edited(rng, base, 2), 2))
    rows += [edited(rng, rows[0], 1 + k % 12) for k in range(60)]
    rows += [["a"], ["A"], [], ["a", "b", "c", "d", "e"], rows[3]]
    texts = [(200 - i, " ".join(w)) for i, w in enumerate(rows)]
    want = sorted(zip((i for i, _ in texts), near_low(texts), strict=True))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3).withColumn("tid", sh.text_key())
    got = sorted((r.doc_id, r.leader.doc_id) for r in sh.similar(docs).collect())
    assert got == want and 20 < len({c for _, c in got}) < len(texts)


def test_near_copies_of_the_driver_table(spark, sf_dir):
    """Nine of ten groups of similar texts, over all pairs, become one; nothing else does."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {i for (i, _), first in zip(rows, near_low(rows, False), strict=True) if i != first}
    got = {i for i, _ in rows} - {r.doc_id for r in sh.keep_similar(docs).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b = "the same text of several words here", "another text that stands alone in it"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (5, a), (3, a), (None, a)], "doc_id long, text string")
    for keep in (sh.keep_first, sh.keep_similar):
        assert sorted(map(str, map(tuple, keep(docs).collect()))) == sorted(map(str, [(3, a), (5, b), (None, a)]))


def test_long_chain_and_star_end(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 500)]
    edges = spark.createDataFrame(chain + star, "u long, v long")
    got = {r.node: r.root for r in sh.connect(edges).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and all(got[1000 + k] == 1000 for k in range(1, 500))


def test_documents_end_to_end(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in sh.components(docs).collect())
    assert [c for _, _, c in got] == reachable([(i, f) for i, f, _ in got])
    kept = sh.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got}) and kept.columns == docs.columns


def test_awkward_rows(spark):
    got = sh.components(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == by[3].component_id == by[4].component_id == 2 and by[2].fingerprint == "0" * 16
    assert by[7].component_id == 7 and by[None].component_id is None
    kept = sh.keep_first(awkward(spark))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "5", "6", "7", "8", "None"])
    assert kept.columns == awkward(spark).columns
    assert sorted((r.doc_id for r in sh.keep_similar(awkward(spark)).collect()), key=str) == sorted([1, 2, 5, 6, 7, 8, None], key=str)
    assert sh.keep_similar(nothing(spark)).count() == 0
    assert sh.components(nothing(spark)).count() == 0 and sh.keep_first(nothing(spark)).count() == 0


def test_larger_radius_is_refused(spark):
    with pytest.raises(ValueError):
        sh.links(spark.createDataFrame([(1,)], "fp long"), 3)
