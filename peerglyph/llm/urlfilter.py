"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

Every URL gives an expression for each of its host's suffixes that has rules and each path prefix that one of
these could name. Suffixes meet hosts, and expressions meet rules, on the first eight hex digits of their
SHA-256; the host itself or the whole digest confirms a meeting, and the longest rule that fits decides.
DataFrame functions only.

Defined results: a null URL or one without "://" has an empty host and path and fits no rule; a URL of
any length is taken whole; repeated rows stay repeated; a rule given twice with both verdicts blocks;
an empty table or rule list works; other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules from (verdict, host, path) triples."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({', '.join(map(quoted, r))})" for r in rules)
    if not rows:
        return spark.createDataFrame([], "verdict string, host string, path string")
    return spark.sql(f"select * from values {rows} as t(verdict, host, path)")


def _prefix(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, PREFIX_DIGITS)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, the rule that decides (null if none) and its verdict, else ``default``.

    ``rules`` has verdict (allow or block), host and path. A rule fits its host and all subdomains, and
    paths that start with its path; the longest wins (of equally long ones, one that blocks). Spark broadcasts
    the rules only if their size is under its broadcast threshold; a larger list is joined by a shuffle on the
    hash prefix, where a hot prefix is split. A URL that many rows share is judged once.
    """
    rules = rules.where("host is not null").select("verdict", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    labels = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels")).first().labels or 1  # no longer suffix can be a rule's host
    named = rules.select(F.concat("host", "path").alias("rule"), "verdict").groupBy("rule").agg(F.max("verdict").alias("rule_verdict"))  # block over allow
    named = named.withColumn("r_digest", F.sha2("rule", 256)).withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_DIGITS))
    # the path lengths that a host's rules have: other prefixes of a path needn't be made
    hosts = rules.groupBy(F.col("host").alias("r_host")).agg(F.collect_set(F.length("path")).alias("lengths")).withColumn("h_prefix", _prefix(F.col("r_host")))

    urls = pages.select(F.col("url").alias("u_url")).where("u_url is not null").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    sites = urls.select("u_url", host_of(F.col("u_url")).alias("host"), path_of(F.col("u_url")).alias("path")).select("u_url", "path", F.explode(suffixes).alias("suffix"))
    sites = sites.withColumn("prefix", _prefix(F.col("suffix")))
    # what confirms a meeting stands above the join: as a filter it would become a key beside the prefix
    fitting = F.when(F.col("suffix") == F.col("r_host"), F.filter("lengths", lambda n: n <= F.length("path")))
    placed = sites.join(hosts, sites.prefix == hosts.h_prefix).select("u_url", "suffix", "path", F.explode(fitting).alias("n"))
    probes = placed.select("u_url", F.sha2(F.concat("suffix", F.substring(F.col("path"), F.lit(1), F.col("n"))), 256).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    # expressions meet rules on the short prefix; the whole digest confirms the meeting
    met = probes.join(named, probes.prefix == named.r_prefix)
    confirmed = F.when(F.col("digest") == F.col("r_digest"), F.struct(F.length("rule").alias("n"), F.col("rule_verdict"), F.col("rule")))
    best = met.groupBy("u_url").agg(F.max(confirmed).alias("best"))
    # joined on the URL's text with a mark, so that either side is a plain shuffle and a hot URL's rows can be split
    keyed = best.select(F.concat(F.lit("="), "u_url").alias("u_key"), "best")
    rows = pages.select("page_id", "url").withColumn("key", F.concat(F.lit("="), "url"))
    found = rows.join(keyed, rows.key == keyed.u_key, "left")
    return found.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
