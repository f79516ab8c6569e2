import random

import pytest
from pyspark.sql import functions as F

from peerglyph.llm import urlfilter as u
from peerglyph.llm.queries import URL_RULES

PAGE = "page_id long, url string, html string"


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[end:]
    cut = min((tail.index(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), tail[:cut]


def judged(rows, rules, default="allow"):
    out = []
    for i, url, *_ in rows:
        host, path = split(url)
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=None)
        out.append((i, host, path, rule[2] if rule else None, rule[1] if rule else default))
    return sorted(out, key=str)


URLS = [
    "http://example.org/es/x", "https://EXAMPLE.org/es/", "http://example.org/es", "http://a.b.example.org/en/123", "http://badexample.org/en/1", "http://org", "http://org/", "http://x.org?/es/", "ftp://www.site.com/fr/x?y#z",
    "http://com/de/", "http://a.com/de", "no scheme", "", None, "http://", "http:///en/1", "http://x.org:80/", "http://É.org/", "a://b://c.org/", "http://..org/x", "http://x.org/\nline", "http://x.com/FR/", "http://" + "a." * 3000 + "org/" + "p" * 20000,
]


def rows_of(spark, urls):
    return spark.createDataFrame([(k, x, None) for k, x in enumerate(urls)], PAGE)


def test_verdicts_are_those_of_a_plain_version(spark):
    pages = rows_of(spark, URLS)
    got = sorted((tuple(r) for r in u.judge(pages, u.rule_table(spark, URL_RULES)).collect()), key=str)
    assert got == judged(list(enumerate(URLS)), URL_RULES)


def test_random_rules(spark):
    rng = random.Random(4)
    label = lambda: rng.choice(["a", "b", "com", "x"])
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 5)))
    path = lambda: "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(5)))
    rules = [(rng.choice(["allow", "block"]), host(), rng.choice(["", path()])) for _ in range(40)]
    urls = [f"http://{host()}{path()}" for _ in range(300)]
    got = sorted((tuple(r) for r in u.judge(rows_of(spark, urls), u.rule_table(spark, rules), "block").collect()), key=str)
    # equal rule strings from different splits, or both verdicts, block
    assert got == judged(list(enumerate(urls)), rules, "block")


def test_the_join_is_on_the_prefix_and_the_digest_confirms(spark, monkeypatch):
    """With a prefix of one digit nearly all expressions meet some rule; the verdicts stay the same."""
    plan = u.judge(rows_of(spark, URLS), u.rule_table(spark, URL_RULES))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and all("prefix" in line and "digest" not in line and "host" not in line for line in joins)
    want = judged(list(enumerate(URLS)), URL_RULES)
    monkeypatch.setattr(u, "PREFIX_DIGITS", 1)
    pages = rows_of(spark, URLS)
    assert sorted((tuple(r) for r in u.judge(pages, u.rule_table(spark, URL_RULES)).collect()), key=str) == want


def test_many_path_lengths_of_one_host_cost_other_hosts_nothing(spark):
    rules = [("block", "big.org", "/" + "a" * k) for k in range(200)] + [("allow", "x.com", "/")]
    urls = ["http://www.big.org/" + "a" * 150 + "b", "http://x.com/" + "a" * 300, "http://other.net/" + "a" * 300]
    got = sorted((tuple(r) for r in u.judge(rows_of(spark, urls), u.rule_table(spark, rules)).collect()), key=str)
    assert got == judged(list(enumerate(urls)), rules)


def test_a_url_that_many_rows_share(spark):
    pages = spark.range(20_000).selectExpr("id % 3 as page_id", "'http://a.example.org/es/' as url")
    got = u.judge(pages, u.rule_table(spark, URL_RULES)).groupBy("page_id", "rule", "verdict").count().collect()
    assert sorted(map(tuple, got)) == [(0, "example.org/es/", "block", 6667), (1, "example.org/es/", "block", 6667), (2, "example.org/es/", "block", 6666)]


def test_plan_is_native(spark):
    plan = u.judge(rows_of(spark, URLS), u.rule_table(spark, URL_RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://org/", "x"), (1, "http://org/", "y"), (None, "http://org/", None)], PAGE).withColumns({c: F.lit("z") for c in ("host", "path", "rule", "times", "digest")})
    got = u.judge(pages, u.rule_table(spark, URL_RULES)).collect()
    assert len(got) == 3 and {r.rule for r in got} == {"org/"}
    assert u.judge(spark.createDataFrame([], PAGE), u.rule_table(spark, URL_RULES)).count() == 0
    assert {r.verdict for r in u.judge(pages, u.rule_table(spark, [])).collect()} == {"allow"}


@pytest.mark.parametrize("threshold", [-1])
def test_the_same_without_broadcast(spark, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = sorted((tuple(r) for r in u.judge(rows_of(spark, URLS), u.rule_table(spark, URL_RULES)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == judged(list(enumerate(URLS)), URL_RULES)
