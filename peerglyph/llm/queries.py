"""Queries of the training-data operators, one for each, over whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, htmltext, pieces, quality, ranges, simhash, substrings, tokenfiles, toxicity, urlfilter, warc
from .storage import materialise, new_path

#: A public BPE model of SentencePiece; executors get its pieces from the driver.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: A public byte-level BPE for many languages, and its free id.
RANKS, RANKS_END = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", 50256
ORACLE_SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL["op5_warc"] = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h from pages),
d as (select *, min(page_id) over (partition by h) as low,
      array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(h, 1 + 10 * (i // 8), 10) as bigint) >> (35 - 5 * (i % 8))) & 31)::int, 1) for i in range(32)], '') as b
      from p)
select page_id, cast(n as bigint) as payload_bytes, b as payload_digest,
       case when page_id = low then 'response' else 'revisit' end as record_type,
       case when page_id <> low then low end as refers_to
from d
"""

@query
def warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages come back from archives in which every fiftieth record is broken, and whether the log of gaps and the
    records found account for every byte."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = new_path(spark, "warc-broken")
    broken = F.regexp_replace("value", "Content-Length: ", "Content-Length= ")
    warc.write_records(warc.records(pages).withColumn("value", F.when(F.col("page_id") % 50 == 7, broken).otherwise(F.col("value"))), path)
    found, _ = materialise(warc.read_archive(spark, path, 1 << 20).select("reason", "length", F.col("page_id").alias("found_id")), "warc-found")
    sizes = ranges.files(spark, path).agg(F.sum("size").alias("size"))
    told = found.agg(F.sum("length").alias("told"), F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("length"))), F.lit(0)).alias("lost"))
    back = found.where("reason is null").select("found_id").distinct()
    rows = pages.select("page_id").join(back, pages.page_id == back.found_id, "left").select("page_id", F.col("found_id").isNotNull().alias("recovered"))
    return rows.crossJoin(F.broadcast(sizes.crossJoin(told).select((F.col("size") == F.col("told")).alias("accounted"), (F.col("lost") > 0).alias("logged"))))  # one row


ORACLE_SQL["warc_salvage"] = "select page_id, page_id % 50 <> 7 as recovered, true as accounted, (select count(*) > 0 from pages where page_id % 50 = 7) as logged from pages"

#: Fixed rules of the query: verdict, host, path.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, URL_RULES))


ORACLE_SQL["op8_url_filters"] = f"""
with rules(v, h, p) as (values {", ".join(map(str, URL_RULES))}),
u as (select page_id, row_number() over () as k,
      case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
s as (select page_id, k,
      translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select s.*, r.h || r.p as rule, r.v, row_number() over (partition by k order by length(r.h || r.p) desc nulls last, r.v desc) as o
      from s left join rules r on (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where o = 1
"""


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


# These pages have one article each and nothing to be left out inside it; what the operator makes of other pages
# is tested.
ORACLE_SQL["op9_html_extraction"] = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as body from pages),
b as (select page_id, url, regexp_replace(regexp_replace(body, '</?(p|br|h1)>', ' ', 'g'), '</?b>', '', 'g') as body from a),
t as (select page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) as text from b)
select page_id, url, text, length(text) as n_chars from t
"""


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.measure(table(spark, sf_dir, "documents"))


ORACLE_SQL["op3_substring_dedup"] = r"""
with d as (select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select k, unnest(range(1, len(w) - 33)) as i, unnest([array_to_string(w[j:j + 34], ' ') for j in range(1, len(w) - 33)]) as s from d where len(w) >= 35),
r as (select k, i from s where s in (select s from s group by s having count(*) > 1)),
c as (select k, list(distinct i + o) as gone from r, range(35) t(o) group by k),
f as (select d.k, doc_id, w, coalesce(gone, []) as gone from d left join c on d.k = c.k),
h as (select k, doc_id, len(w) as n_words, len(gone) as n_removed, unnest(range(1, len(w) + 1)) as i, unnest(w) as word, gone from f where len(w) > 0),
x as (select h.k, string_agg(word, ' ' order by h.i) as kept from h left join (select distinct k, i + o as i from r, range(35) t(o)) g on g.k = h.k and g.i = h.i where g.i is null group by h.k)
select f.doc_id, cast(len(f.w) as bigint) as n_words, cast(len(f.gone) as bigint) as n_removed, sha256(coalesce(x.kept, '')) as kept_sha256 from f left join x on x.k = f.k
"""


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.Vocabulary.load(model, merges=True))


@query
def unigram_pieces(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    """The same search where scores decide: a unigram model by rule, over the turns of conversations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return pieces.encode(turns, pieces.Vocabulary.ranked(model), ["conv_id", "turn"])


@query
def op7_token_counts(spark: SparkSession, sf_dir: str, ranks: str = RANKS, end: int = RANKS_END) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), tokenfiles.Tokenizer.load(ranks, end))
