"""The select stage: back-translated candidates are scored against their source, and each record's best code is chosen; and its command line.

Every usable candidate gets the cosine of the embeddings of source and back-translation, their BLEU and the weighted sum. Scores are worked out on flat
rows and put back by position, so candidates keep their order and those that aren't usable stay without scores.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as t
from loomtext.operators import metrics, selection
from loomtext.operators.gated import BatchPort
from loomtext.plans.ports import CANDIDATE
from loomtext.session import session

RECORD = f"index string, code string, source_code string, translations array<{CANDIDATE}>, valid_count int, status string"
#: sources and back-translations to their cosines (null: none).
Similar = Callable[[list[str], list[str]], list[float | None]]


def scored(df: DataFrame, key: str, source: str, factory: Callable[[], Similar], w_bleu: float = 0.5, w_cosine: float = 0.5) -> DataFrame:
    """df (key unique) with `scores` (jina, bleu, hybrid) and hybrid_score in every usable candidate of translations."""
    flat = df.select(key, F.coalesce(source, F.lit("")).alias("src"), F.posexplode("translations").alias("at", "c")).filter(selection.usable(F.col("c")))
    flat = flat.select(key, "src", "at", F.col("c.back_translation").alias("bt"), F.array("src").alias("refs"))
    parts = metrics.bleu_parts(flat, key, "bt", "refs", keep=["at", "src", "bt"], tokens=metrics.cased_tokens)
    rows = parts.select(key, "at", "src", "bt", metrics.corpus_bleu_of_sums().alias("bleu")).withColumn("jina", BatchPort(factory, ("src", "bt"), "double").column(F.lit(True)))
    scores = F.struct("jina", "bleu", selection.hybrid(F.col("jina"), F.col("bleu"), F.lit(w_cosine), F.lit(w_bleu)).alias("hybrid"))
    by_place = rows.select(key, F.struct("at", scores.alias("scores")).alias("e")).groupBy(key).agg(F.map_from_entries(F.collect_list("e")).alias("_s"))
    none = F.lit(None).cast("struct<jina: double, bleu: double, hybrid: double>")
    own = lambda i: F.coalesce(F.try_element_at("_s", i), none)
    new = F.transform("translations", lambda c, i: c.withField("scores", own(i)).withField("hybrid_score", own(i)["hybrid"]))
    return df.join(by_place, key, "left").withColumn("translations", new).drop("_s")


def selected(df: DataFrame, key: str, source: str, factory: Callable[[], Similar], w_bleu: float = 0.5, w_cosine: float = 0.5) -> DataFrame:
    """Scored records with their best candidate: best_candidate_info, best_python_code, best_score_hybrid."""
    return selection.with_best(scored(df, key, source, factory, w_bleu, w_cosine))


def run(spark: SparkSession, source: str, out: str, factory: Callable[[], Similar], models: list[str], languages: list[str], weights: list[tuple[float, float]] = [(0.5, 0.5)]) -> int:  # noqa: B006
    """JSON lines source to out, paths with {lang} and {model} (a folder tag), out also with {wb} and {ws}; pairs without a source, and sources without a usable candidate, are skipped. Returns how many files were written."""
    written = 0
    for path_of_model in models:
        tag = spark.range(1).select(t.model_tag(F.lit(path_of_model))).first()[0]
        for lang in languages:
            path = source.format(lang=lang, model=tag)
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                continue
            rows = spark.read.schema(RECORD).json(path).withColumn("_source", F.coalesce("code", "source_code"))
            if not rows.filter(F.exists("translations", selection.usable)).limit(1).count():
                continue
            for w_bleu, w_cosine in weights:
                chosen = selected(rows, "index", "_source", factory, w_bleu, w_cosine).drop("_source")
                chosen.write.mode("overwrite").json(out.format(lang=lang, model=tag, wb=w_bleu, ws=w_cosine))
                written += 1
    return written


def main(factory: Callable[[], Similar], arguments: list[str] | None = None) -> int:
    """The command line, for a program that has an embedder."""
    parser = argparse.ArgumentParser(description="Choose each record's best candidate by BLEU and embedding cosine of its back-translation.")
    parser.add_argument("source", help="path with {lang} and {model}")
    parser.add_argument("out", help="path with {lang}, {model}, {wb} and {ws}")
    parser.add_argument("--models", nargs="+", required=True)
    parser.add_argument("--langs", nargs="+", required=True)
    parser.add_argument("--bleu_weights", nargs="+", type=float, default=[0.5])
    parser.add_argument("--jina_weights", nargs="+", type=float, default=[0.5])
    given = parser.parse_args(arguments)
    if len(given.bleu_weights) != len(given.jina_weights):
        parser.error("as many weights of one kind as of the other")
    return run(session(), given.source, given.out, factory, given.models, given.langs, list(zip(given.bleu_weights, given.jina_weights, strict=True)))
