"""Command line.

    python -m peerglyph FONT --tr39 PATH --novel PATH [--cross-script PATH] [--threshold 0.7] [--compare FONT] [--json]
    python -m peerglyph --list-fonts --tr39 PATH --novel PATH
    python -m peerglyph scripts --index PATH --out PATH [--pair A B] [--script A] [--fresh] [--dry-run]
    python -m peerglyph runs --results PATH --variants PATH [--models A,B] [--suite NAME] [--model NAME] [--times 3] [--dry-run]
    python -m peerglyph unscored --results PATH --scores PATH [--model NAME] [--rescore]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import experiments as exp
from .operators import fontquery as fq
from .operators import similarity as sim
from .plans import jobs
from .sources import documents, json_files
from .sources.sinks import table_lines, to_document, write_unit
from .streaming.incremental import remaining

#: Script pairs that are scored before the others.
FIRST_PAIRS = (("Cyrillic", "Latin"), ("Greek", "Latin"), ("Cyrillic", "Greek"))


def fonts(arguments: list[str], spark: SparkSession) -> str:
    """A font's look-alikes, two fonts compared, or the list of fonts."""
    parser = argparse.ArgumentParser(prog="peerglyph")
    parser.add_argument("font", nargs="?")
    parser.add_argument("--list-fonts", action="store_true")
    parser.add_argument("--threshold", type=float, default=0.7)
    parser.add_argument("--compare")
    parser.add_argument("--json", action="store_true")
    for origin in ("tr39", "novel", "cross-script"):
        parser.add_argument(f"--{origin}", dest=origin)
    given = vars(parser.parse_args(arguments))
    files = {k: given[k] for k in ("tr39", "novel", "cross-script") if given[k]}
    if not files.keys() - {"cross-script"}:
        parser.error("a file of pairs is needed: --tr39 or --novel")
    if given["list_fonts"]:
        facts = [jobs.read_comparisons(spark, v) for k, v in files.items() if k != "cross-script"]
        rows = facts[0] if len(facts) == 1 else facts[0].unionByName(facts[1])
        return "\n".join(r.font for r in fq.list_fonts(rows).orderBy("font").collect())
    if not given["font"]:
        parser.error("a font is needed")
    found = jobs.query_files(spark, files, given["font"], given["threshold"])
    if given["compare"]:
        other = jobs.query_files(spark, files, given["compare"], given["threshold"])
        found, widths = fq.compare_fonts(found, other, given["font"], given["compare"]), {"source": 8, "target": 8, "ssim_a": 10, "ssim_b": 10, "delta": 10, "note": 30}
    else:
        widths = {"source": 8, "target": 8, "ssim": 10, "source_font": 24, "target_font": 24, "origin": 14}
    return to_document({"font": given["font"], "threshold": given["threshold"]}, found) if given["json"] else "\n".join(table_lines(found, widths))


def scripts(arguments: list[str], spark: SparkSession) -> str:
    """Score script pairs of a render index (a table with a script column) into a folder each; finished ones are skipped.

    Pairs are taken in order, those of ``FIRST_PAIRS`` first. ``--pair`` and ``--script`` choose among them, ``--fresh``
    scores finished ones again, ``--dry-run`` only names them.
    """
    parser = argparse.ArgumentParser(prog="peerglyph scripts")
    parser.add_argument("--index", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--pair", nargs=2)
    parser.add_argument("--script")
    parser.add_argument("--fresh", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    given = parser.parse_args(arguments)
    index = spark.read.parquet(given.index)
    names = index.groupBy("script").agg(F.min("script").alias("ord"))  # by name: some tens of rows
    first = spark.createDataFrame([(k, *p) for k, p in enumerate(FIRST_PAIRS)], "rank int, script_a string, script_b string")
    pairs = sim.order_script_pairs(sim.script_pairs(names), first)
    if given.pair:
        pairs = pairs.where(F.array_sort(F.array("script_a", "script_b")) == F.array(*map(F.lit, sorted(given.pair))))
    if given.script:
        pairs = pairs.where(F.lit(given.script).isin(F.col("script_a"), F.col("script_b")))
    if not given.fresh and json_files.exists(spark, given.out):
        done = documents.read_score_folder(spark, given.out).select("script_a", "script_b").distinct()
        wanted = {tuple(r) for r in remaining(pairs.select("script_a", "script_b"), done, ["script_a", "script_b"]).collect()}
    else:
        wanted = None
    said = []
    for r in pairs.select("script_a", "script_b").collect():
        if wanted is not None and tuple(r) not in wanted:
            continue
        if not given.dry_run:
            side = lambda name: index.where(F.col("script") == name).drop("script")
            found = jobs.score_scripts(side(r.script_a), side(r.script_b), prefilter="Han" in tuple(r))
            write_unit(found.withColumns({"script_a": F.lit(r.script_a), "script_b": F.lit(r.script_b)}), given.out, ["script_a", "script_b"])
        said.append(f"{r.script_a} {r.script_b}")
    return "\n".join(said)


def _lines(rows: DataFrame) -> str:
    return "\n".join(" ".join(map(str, r)) for r in rows.select("model", "variant", "run").orderBy("model", "variant", "run").collect())


def runs(arguments: list[str], spark: SparkSession) -> str:
    """The runs of an experiment that are still to be made: models with variants (of a suite), ``--times`` each.

    Variants are files named ``suite-variant.txt``. No model is called here, so there is only the dry run.
    """
    parser = argparse.ArgumentParser(prog="peerglyph runs")
    parser.add_argument("--results", required=True)
    parser.add_argument("--variants", required=True)
    parser.add_argument("--models", default="")
    parser.add_argument("--model", default="")
    parser.add_argument("--suite", default="")
    parser.add_argument("--times", type=int, default=3)
    parser.add_argument("--dry-run", action="store_true")
    given = parser.parse_args(arguments)
    done = documents.read_runs(spark, given.results)
    named = spark.createDataFrame([(m,) for m in given.models.split(",") if m], "model string").unionByName(done.select("model"))
    variants = documents.read_documents(spark, given.variants).select(F.regexp_extract("name", r"^(?:.*-)?([^-]*)\.[^.]*$", 1).alias("variant"), F.regexp_extract("name", r"^(.*)-[^-]*$", 1).alias("suite"))
    variants = variants.where(F.col("suite") == given.suite) if given.suite else variants
    planned = exp.plan(named.where(F.contains("model", F.lit(given.model))), variants.select("variant"), given.times)
    return _lines(exp.unscored(planned, done))


def unscored(arguments: list[str], spark: SparkSession) -> str:
    """Recorded runs without a score; with ``--rescore`` all of them."""
    parser = argparse.ArgumentParser(prog="peerglyph unscored")
    parser.add_argument("--results", required=True)
    parser.add_argument("--scores", required=True)
    parser.add_argument("--model", default="")
    parser.add_argument("--rescore", action="store_true")
    given = parser.parse_args(arguments)
    done = documents.read_runs(spark, given.results)
    scores = documents.read_scores(spark, given.scores) if json_files.exists(spark, given.scores) and not given.rescore else done.limit(0)
    return _lines(exp.unscored(done, scores, given.model))


COMMANDS = {"scripts": scripts, "runs": runs, "unscored": unscored}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    arguments = sys.argv[1:] if arguments is None else arguments
    spark = spark or SparkSession.builder.getOrCreate()
    if arguments and arguments[0] in COMMANDS:
        return COMMANDS[arguments[0]](arguments[1:], spark)
    return fonts(arguments, spark)


if __name__ == "__main__":
    print(main())
