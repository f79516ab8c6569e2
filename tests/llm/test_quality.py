import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from common import ROWS, awkward, nothing
from peerglyph.llm import quality as q

RNG = np.random.default_rng(5)


def base(text):
    """The base counts, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        repeated += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), repeated, len(covered), n < 20 or 100 * len(covered) > 30 * n


def counts(text_list):
    v = q.verdicts(pa.array(text_list, pa.string()), q.LineModel())
    return list(zip(*(v[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), strict=True))


@given(st.lists(st.text(alphabet="ab é#\n\t中|\x0b", max_size=80) | st.none(), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_base_counts_are_those_of_a_plain_version(texts):
    assert counts(texts) == [base(t) for t in texts]


def test_base_counts_of_repeats():
    words = [f"w{k}" for k in range(30)]
    text = " ".join(words + words[:8] + ["end"])
    assert counts([text])[0] == base(text) and base(text)[4] == 16


def model():
    return q.LineModel(RNG.normal(size=(len(q.FEATURES), 2)), RNG.normal(size=(2, 2)), RNG.normal(size=2))


def paths(scores, m):
    """Every state sequence of a text with its score."""
    for path in itertools.product((0, 1), repeat=len(scores)):
        total = m.start[path[0]] + sum(scores[t, s] for t, s in enumerate(path)) + sum(m.transition[a, b] for a, b in zip(path, path[1:], strict=False))
        yield path, total


def test_viterbi_and_marginals_against_all_paths():
    m = model()
    sizes = [3, 1, 5, 2, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = RNG.normal(size=(first[-1], 2))
    states = q.viterbi(scores, first, m)
    p, pair, begin = q.marginals(scores, first, m)
    want_pair, want_begin = np.zeros((2, 2)), np.zeros(2)
    for a, b in zip(first, first[1:], strict=False):
        every = list(paths(scores[a:b], m))
        assert tuple(states[a:b]) == max(every, key=lambda x: x[1])[0]
        weights = np.exp([x[1] for x in every])
        weights /= weights.sum()
        for t in range(b - a):
            assert p[a + t, 1] == pytest.approx(sum(w for (path, _), w in zip(every, weights, strict=True) if path[t]))
        for (path, _), w in zip(every, weights, strict=True):
            want_begin[path[0]] += w
            for x, y in zip(path, path[1:], strict=False):
                want_pair[x, y] += w
    assert np.allclose(pair, want_pair) and np.allclose(begin, want_begin)


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_blocks_of_long_texts_give_the_same_states(block):
    for _ in range(30):
        m = model()
        sizes = RNG.integers(1, 25, RNG.integers(1, 6))
        first = np.concatenate([[0], np.cumsum(sizes)])
        scores = RNG.normal(size=(first[-1], 2)) * 3
        assert (q.viterbi(scores, first, m, block) == q.viterbi(scores, first, m)).all()
    assert len(q.viterbi(np.zeros((0, 2)), np.zeros(1, np.int64), model(), block)) == 0


def test_very_long_texts():
    import time
    import tracemalloc

    m = model()
    start = time.process_time()
    for text, words in (("a line of it\n" * 300_000, 1_200_000), (" " * 32_000_000, 0), ("x" * 32_000_000, 1), ("word and more " * 1_000_000, 3_000_000)):
        column = pa.array([text])
        tracemalloc.start()
        assert q.verdicts(column, m)["n_words"].tolist() == [words]
        assert tracemalloc.get_traced_memory()[1] < 350e6
        tracemalloc.stop()
    assert time.process_time() - start < 40


def test_long_spans_hash_like_short_ones(monkeypatch):
    from peerglyph.llm import textkit

    buf = RNG.integers(0, 256, 5000).astype(np.uint8)
    starts = np.sort(RNG.integers(0, 4000, 50))
    ends = np.minimum(starts + RNG.integers(0, 900, 50), 5000)
    whole, (a, b) = textkit.span_hashes(buf, starts, ends), textkit.nested_hashes(buf, starts, [ends, (starts + ends) // 2])
    words = RNG.integers(0, 2**63, 300).astype(np.uint64)
    windows, edges = textkit.window_hashes(words, 8), textkit.runs(buf, np.array([0, 700, 701, 5000]))
    places = np.sort(RNG.integers(0, 5001, 40))
    counts = textkit.counts_between(buf, textkit.SPACE, places[:20], places[20:])
    assert counts.tolist() == [int(textkit.SPACE[buf[i:j]].sum()) for i, j in zip(places[:20], places[20:], strict=True)]
    monkeypatch.setattr(textkit, "_SPAN", 100)
    monkeypatch.setattr(textkit, "_STRETCH", 37)
    assert (textkit.span_hashes(buf, starts, ends) == whole).all() and (a == whole).all()
    assert (textkit.nested_hashes(buf, starts, [ends, (starts + ends) // 2])[1] == b).all()
    assert (textkit.window_hashes(words, 8) == windows).all()
    assert all((x == y).all() for x, y in zip(textkit.runs(buf, np.array([0, 700, 701, 5000])), edges, strict=True))
    assert textkit.counts_between(buf, textkit.SPACE, places[:20], places[20:]).tolist() == counts.tolist()


def test_one_text_is_read_for_an_id(spark):
    docs = spark.range(40).selectExpr("id as doc_id", "repeat(concat(if(id % 2 = 0, 'some prose of it ', '*** ### '), '\n'), 5) as text")
    labels = spark.range(40).selectExpr("id as doc_id", "cast(id % 2 = 0 as int) as quality")
    many = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(2000).select("id")).select("doc_id", "text"))
    a, b = q.fit(docs, labels), q.fit(many, labels)
    assert (a.emission == b.emission).all() and a.emission.any()


def line_features(line, earlier):
    raw = line.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    size, n = max(1, len(raw)), max(1, len(words))
    share = lambda test: sum(map(test, raw)) / size
    repeated = bool(words) and line in earlier
    return [1, min(1, 5 * share(lambda c: chr(c) in "#*$%&|<>")), min(1, 5 * share(lambda c: c == 33)), share(lambda c: 65 <= c <= 90), min(1, 8 * share(lambda c: c == 124)), share(lambda c: 48 <= c <= 57), len(words) < 4, min(1, size / n / 20), repeated], len(words)


def plain_verdict(text, m):
    """Features, Viterbi and the share of content words, line by line."""
    score, back, counts, earlier = None, [], [], set()
    for line in (text or "").split("\n"):
        x, n = line_features(line, earlier)
        earlier.add(line)
        emit = [sum(float(np.float32(v)) * m.emission[k, s] for k, v in enumerate(x)) for s in (0, 1)]
        if score is None:
            score = [m.start[s] + emit[s] for s in (0, 1)]
        else:
            back.append([int(score[1] + m.transition[1, s] > score[0] + m.transition[0, s]) for s in (0, 1)])
            score = [max(score[a] + m.transition[a, s] for a in (0, 1)) + emit[s] for s in (0, 1)]
        counts.append(n)
    state, content = int(score[1] > score[0]), 0
    for t in range(len(counts) - 1, -1, -1):
        content += counts[t] * (state == 0)
        state = back[t - 1][state] if t else state
    return content / max(1, sum(counts)) >= m.content_share


def test_the_whole_query_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = q.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = q.judge(docs, m).collect()
    assert len(rows) == len(texts)
    for r in rows:
        *counts, failed = base(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] == [*counts, failed]
        assert r.kept == (not failed and plain_verdict(texts[r.doc_id], m)), r.doc_id
    assert 0 < sum(r.kept for r in rows) < sum(not r.base_failed for r in rows)


def test_learns_junk_lines_from_document_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = q.fit(docs, labels)
    rows = {r.doc_id: r for r in q.judge(docs, m).select("doc_id", "base_failed", "kept").collect()}
    known = [r for r in labels.collect() if not rows[r.doc_id].base_failed]
    good, bad = [r for r in known if r.quality == 1], [r for r in known if r.quality == 0]
    assert np.mean([rows[r.doc_id].kept for r in good]) > 0.99
    assert bad and np.mean([rows[r.doc_id].kept for r in bad]) < 0.1
    prose = [f"Thand the of inerly{k} ere was. Onthe ingan to be and the. An{k} erly of the thes." for k in range(8)]
    junk = [f"edge{k}*** thing### onan$$$ theran%%% inlyan&&& restou*** onbleed$$$ hean%%%" for k in range(4)]
    text = "\n".join([*prose[:4], *junk, "", *prose[4:]])
    marked = sorted(q.mark_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), m).collect(), key=lambda r: r.line)
    assert [r.label for r in marked] == ["content"] * 4 + ["boilerplate"] * 4 + ["content"] * 4
    assert [r.line for r in marked] == [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12] and text.encode()[marked[4].low : marked[4].high].decode() == junk[0]


def test_awkward_rows(spark):
    rows = q.judge(awkward(spark), q.LineModel()).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words) for r in rows))) == sorted(map(str, ((r[0], base(r[1])[0]) for r in ROWS)))
    kept = q.keep_documents(awkward(spark), q.LineModel())
    assert kept.columns == awkward(spark).columns and kept.count() == sum(not base(r[1])[5] for r in ROWS)
    assert q.judge(nothing(spark), q.LineModel()).count() == 0 and q.mark_lines(nothing(spark), q.LineModel()).count() == 0


def test_without_examples_of_both_classes_all_lines_are_content(spark):
    for rows in ([], [(1, 1)], [(None, 0), (1, None)]):
        m = q.fit(awkward(spark), spark.createDataFrame(rows, "doc_id long, quality int"))
        assert not m.emission.any()
