"""C11_score_sequences covers the whole job."""

from peerglyph.operators.candidates import ALPHABET
from peerglyph.plans.catalog import all_queries
from peerglyph.sources import renders


def test_all_sequences_and_all_targets_are_rendered(spark, sf_dir, monkeypatch):
    asked, render = [], renders.render
    monkeypatch.setattr(renders, "render", lambda jobs, *rest: asked.append(jobs) or render(jobs, *rest))
    all_queries()[0]["C11_score_sequences"](spark, sf_dir)
    sources, targets = ({r.ch for r in jobs.select("ch").distinct().collect()} for jobs in asked)
    assert sources == {a + b for a in ALPHABET for b in ALPHABET} and targets == set(ALPHABET)
    assert [jobs.count() for jobs in asked] == [3 * 3844, 3 * 62]
