"""The filter run from source tables to final references, by language: sample, cascade, duplicates, strata, files; and its command line."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import cascade, dedup, near_text
from loomtext.session import checkpointer, session
from loomtext.sources import records

# The languages of a run.
LANGUAGES = ("julia", "lua", "ocaml", "r", "racket")


def sampled(spark: SparkSession, path: str, ratio: float = 0.1) -> DataFrame:
    """Step 1: (index, content) of the first int(n * ratio) rows; index is the row's number where the table has none."""
    rows = records.dense_row_id(spark.read.parquet(path))
    index = F.col("index") if "index" in rows.columns else F.col("row_id").alias("index")
    return dedup.head_fraction(rows.select("row_id", index, "content"), "row_id", ratio).drop("row_id")


def deduplicated(kept: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], group: str = "lang", threshold: float = 0.85) -> DataFrame:
    """Step 3, first half: of equal summaries of a language the first row, then no row near an earlier one that stays."""
    names = [group, "summary", *(c for c in kept.columns if c not in (group, "summary"))]
    rows = checkpoint(dedup.keep_first(kept.select(*names), [group, "summary"], ["index"]).withColumn("_id", F.concat_ws(":", group, F.lpad(F.col("index").cast("string"), 20, "0"))))
    return near_text.near_first_wins(rows, "_id", "summary", checkpoint, threshold, part=group).drop("_id")


def final_sample(kept: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], target: int = 3000, threshold: float = 0.85) -> DataFrame:
    """Step 3: survivors (lang, index, summary, code, overlap, similarity, length) without duplicates, at most target of each language by strata."""
    unique = checkpoint(deduplicated(kept, checkpoint, threshold=threshold))
    return dedup.stratified_sample(unique, "lang", F.col("length"), "index", target)


def run(
    spark: SparkSession,
    source: str,
    out: str,
    languages: tuple[str, ...] = LANGUAGES,
    ratio: float = 0.1,
    target: int = 3000,
    ports: cascade.Ports | None = None,
    steps: tuple[int, ...] = (1, 2, 3),
) -> dict[str, dict[str, DataFrame]]:
    """By language, from source (a path with {lang}): out/raw, out/candidates and out/final, tables of Parquet, JSON lines and tab-separated files.

    A step that is left out takes what the run before left in `out`. Languages without a source are skipped. Returns layers, reasons and mean length of each.
    """
    checkpoint = checkpointer(spark)
    reports: dict[str, dict[str, DataFrame]] = {}
    for lang in languages:
        path, raw, candidates = source.format(lang=lang), f"{out}/raw/{lang}", f"{out}/candidates/{lang}"
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if 1 in steps else raw if 2 in steps else candidates)
        if not found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found):
            continue
        report = reports[lang] = {}
        if 1 in steps:
            sampled(spark, path, ratio).write.mode("overwrite").parquet(raw)
        if 2 in steps:
            rows = spark.read.parquet(raw).withColumn("code_lang", F.lit(lang))
            judged = checkpoint(cascade.reject_cascade(rows, ports))
            report["layers"], report["reasons"] = cascade.layer_counts(judged), cascade.top_reasons(judged)
            cascade.survivors(judged).write.mode("overwrite").json(candidates)
        if 3 in steps:
            kept = spark.read.schema("index long, summary string, code string, overlap double, similarity double, length int").json(candidates)
            chosen = checkpoint(final_sample(kept.withColumn("lang", F.lit(lang)), checkpoint, target))
            report["mean_length"] = cascade.mean_length(chosen)
            records.write_tsv(chosen.orderBy("index").select("index", "summary"), f"{out}/final/{lang}", bom=True, mode="overwrite")
    return reports


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Filter code tables to reference summaries.")
    parser.add_argument("source", help="path of the source tables, with {lang}")
    parser.add_argument("out")
    parser.add_argument("--langs", nargs="+", default=list(LANGUAGES))
    parser.add_argument("--sample_ratio", type=float, default=0.1)
    parser.add_argument("--target_size_per_lang", type=int, default=3000)
    for step in (1, 2, 3):
        parser.add_argument(f"--skip_step{step}", action="store_true")
    given = parser.parse_args(arguments)
    steps = tuple(step for step in (1, 2, 3) if not getattr(given, f"skip_step{step}"))
    for lang, report in run(session(), given.source, given.out, tuple(given.langs), given.sample_ratio, given.target_size_per_lang, steps=steps).items():
        for name, rows in report.items():
            print(lang, name)
            rows.show(truncate=False)


if __name__ == "__main__":
    main()
