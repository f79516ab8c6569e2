"""Recorded document experiments: run plans, scores and their aggregates."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.documents import RUN_KEY
from ..sources.schemas import CLAUSES, TRAPS


def plan(models: DataFrame, variants: DataFrame, runs: int) -> DataFrame:
    """Every model with every variant (once, whatever suites name it) and every run number."""
    return models.distinct().crossJoin(variants.dropDuplicates(["variant"])).select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))


def next_run(done: DataFrame) -> DataFrame:
    """The number of the next run of each model and variant."""
    return done.groupBy("model", "variant").agg((F.max("run") + 1).alias("next_run"))


def unscored(runs: DataFrame, scores: DataFrame, model: str = "") -> DataFrame:
    """Runs without a score, of models whose name holds ``model``."""
    mine = runs.where(F.contains("model", F.lit(model)))
    return mine.join(scores.select(*RUN_KEY).distinct(), RUN_KEY, "left_anti").orderBy(*RUN_KEY)


def metrics(scores: DataFrame) -> DataFrame:
    """Clause recall, trap detection, anomaly rate, omissions and length of each model and variant."""
    share = lambda part, names: sum((F.coalesce(F.col(f"{part}.{n}"), F.lit(False)).cast("int") for n in names), F.lit(0)) / len(names)
    rows = scores.withColumn("recall", share("clauseRecall", CLAUSES)).withColumn("traps", share("trapDetection", TRAPS))
    return rows.groupBy("model", "variant").agg(F.count("*").alias("runs"), F.avg("recall").alias("clause_recall"), F.avg("traps").alias("trap_detection"), F.avg(F.col("detectedAnomalies").cast("int")).alias("anomaly_rate"), F.avg(F.size("silentOmissions")).alias("omissions"), F.avg("responseLength").alias("length"))


def token_usage(runs: DataFrame) -> DataFrame:
    """Mean of each kind of token count."""
    return runs.select("model", "variant", F.explode("usage").alias("kind", "n")).groupBy("model", "variant", "kind").agg(F.avg("n").alias("mean"))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a two-by-two table: tables with its margins that are no likelier than it."""
    n, row, col = a + b + c + d, a + b, a + c
    if not n:
        return 1.0
    p = lambda x: comb(row, x) * comb(n - row, col - x) / comb(n, col)
    mine = p(a)
    return min(1.0, sum(q for x in range(max(0, col - (n - row)), min(row, col) + 1) if (q := p(x)) <= mine * (1 + 1e-9)))


def substitutions(clean: DataFrame, changed: DataFrame) -> DataFrame:
    """Characters that replace others at the same place of a document: original, substitute and how often.

    Both have name and text; documents of different lengths are no substitutions.
    """
    a = clean.select("name", F.split("text", "").alias("a"))
    b = changed.select("name", F.split("text", "").alias("b"))
    met = a.join(b, "name").where(F.size("a") == F.size("b")).select("name", F.explode(F.arrays_zip("a", "b")).alias("p"))
    return met.where("p.a <> p.b").groupBy(F.col("p.a").alias("original"), F.col("p.b").alias("substitute")).agg(F.count("*").alias("n"))
