"""A corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes what
a stage returns as a table in the shared folder, and the next stage reads that, so a lost executor never
costs more than the stage at work. All stages but the last return the columns of documents.

Defined results: a null or empty text fails the base rules, so that the first stage drops it; later stages, given
such a text, keep it as it is (near-dedup: one of them, as they are equal). Nulls in other columns are kept. A text
of any length is read whole. Of equal rows one stays after near-dedup; ties go to the smallest doc_id, and rows
without one all stay. An empty table gives an empty table. Further columns are passed on, whatever their names, by
all stages but the last, which keeps doc_id, lang and source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from peerglyph.llm import decontaminate, pieces, quality, simhash, substrings
from peerglyph.llm.queries import PIECES
from peerglyph.llm.storage import drop, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line field reject go."""
    return quality.keep_documents(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word similarity of 0.8 or more), the document with the smallest id stays."""
    return simhash.keep_similar(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of words that stand anywhere else are cut out of the texts."""
    return substrings.remove(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its budget of edits, go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts that are left."""
    return pieces.encode(docs, pieces.Vocabulary.load(PIECES, merges=True), ["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: Training, hashing and encoding aren't expressible in SQL; the tests hold ``run`` against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
