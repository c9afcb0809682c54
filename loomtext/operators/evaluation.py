"""Whole evaluations: pairs of files, the local report, the comparison of variants, and token matching from sentences."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions import text as t
from loomtext.operators import joins, metrics, nested

#: A port that adds a column with a score in 0 to 1 to rows (reference, hypothesis).
Score = Callable[[Column, Column], Column]


def line_pairs(references: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(row_id, reference, hypothesis) of files of lines (row_id, text), paired by position as far as the shorter goes; empty hypothesis lines go after that."""
    both = hypotheses.select("row_id", F.col("text").alias("hypothesis")).join(references.select("row_id", F.col("text").alias("reference")), "row_id")
    return both.filter("hypothesis <> ''").select("row_id", t.trim(F.col("reference")).alias("reference"), t.trim(F.col("hypothesis")).alias("hypothesis"))


def local_report(pairs: DataFrame, meteor: Score | None = None) -> DataFrame:
    """(metric, score) over line_pairs(), in percent to two places: mean sentence BLEU, METEOR where a port gives it, stemmed ROUGE-L. Scores without pairs are null."""
    rows = metrics.bleu_parts(pairs.withColumn("_r", F.array("reference")), "row_id", "hypothesis", "_r", keep=["reference", "hypothesis"])
    scores = {"BLEU": metrics.bleu_from_parts()[0], "ROUGE-L": metrics.rouge_l()(F.col("hypothesis"), F.array("reference"))}
    if meteor is not None:
        scores["METEOR"] = meteor(F.col("reference"), F.col("hypothesis"))
    one = rows.select(*(c.alias(name) for name, c in scores.items())).agg(*(F.bround(F.avg(f"`{name}`") * 100, 2).alias(name) for name in scores))
    return one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("metric"), F.col(f"`{name}`").alias("score")) for name in scores))))


@F.pandas_udf(T.DoubleType())
def rouge_f1(candidates: pd.Series, references: pd.Series) -> pd.Series:
    """E4's ROUGE-L of arrays of tokens: the F1 of the longest common subsequence; 0 where nothing is common."""
    out = []
    for c, r in zip(candidates, references, strict=True):
        n = metrics._lcs(list(r), list(c))
        out.append(2 * n / (len(c) + len(r)) if n else 0.0)
    return pd.Series(out, dtype=float)


def ascii_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def comparison_scores(rows: DataFrame, variants: list[str], reference: str = "summary", ports: dict[str, Score] | None = None) -> DataFrame:
    """M8 for each variant's column of aligned rows (uid, reference, variants): (variant, metric, score in 0 to 1): corpus BLEU over 13a tokens, mean ROUGE-L F1, and the ports' means.

    Variants are worked out in one pass. Without rows every score is 0.
    """
    longer = rows.select("uid", F.col(reference).alias("reference"), F.inline(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(f"`{v}`").alias("hypothesis")) for v in variants))))
    parts = metrics.bleu_parts(longer.withColumn("_r", F.array("reference")), "uid", "hypothesis", "_r", keep=["variant", "reference", "hypothesis"], tokens=metrics.cased_tokens)
    means = {"ROUGE-L": rouge_f1(ascii_tokens(F.col("hypothesis")), ascii_tokens(F.col("reference")))}
    means |= {name: port(F.col("reference"), F.col("hypothesis")) for name, port in (ports or {}).items()}
    parts = parts.select("*", *(c.alias(f"_{name}") for name, c in means.items()))
    totals = parts.groupBy("variant").agg(*metrics.part_sums(), *(F.avg(f"`_{name}`").alias(name) for name in means))
    scored = totals.select("variant", metrics.corpus_bleu_of_sums().alias("BLEU"), *(f"`{name}`" for name in means))
    long = scored.select("variant", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("score")) for m in ("BLEU", *means)))))
    empty = rows.sparkSession.createDataFrame([(v, m) for v in variants for m in ("BLEU", *means)], "variant string, metric string")
    return empty.join(F.broadcast(long), ["variant", "metric"], "left").select("variant", "metric", F.coalesce("score", F.lit(0.0)).alias("score"))


def comparison_report(references: DataFrame, predictions: dict[str, DataFrame], ports: dict[str, Score] | None = None) -> DataFrame:
    """References (uid, summary) and files of predictions (row_id, text) to one row a metric and one column a variant, in percent to four places."""
    scores = comparison_scores(joins.align(references, predictions), list(predictions), ports=ports)
    return scores.groupBy("metric").pivot("variant", list(predictions)).agg(F.round(F.first("score") * 100, 4))


def match_scores(
    df: DataFrame,
    key: str,
    candidate: str,
    references: str,
    encode: Callable[[DataFrame], DataFrame],
    idf: DataFrame | bool = False,
    baseline: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """(key, p, r, f): token matching of each candidate with its array of references, the best of each over the references.

    encode adds to sentences (text) one row for each token: (text, pos, token, vector); it sees each distinct sentence once.
    idf is a table (token, idf) whose missing tokens weigh as those of no sentence, or True for one from the references. baseline: see rescale().
    """
    pairs = df.select(key, F.col(candidate).alias("candidate"), F.posexplode(references).alias("at", "reference")).withColumn("pair", F.struct(key, "at"))
    sentences = pairs.select(F.col("candidate").alias("text")).unionAll(pairs.select("reference")).distinct()
    tokens = encode(sentences).select("text", "pos", "token", "vector")
    if idf is True:
        listed = tokens.join(pairs.select(F.col("reference").alias("text")), "text").groupBy("text", "pos").agg(F.first("token").alias("token"))
        idf = metrics.idf_weights(listed.groupBy("text").agg(F.collect_list("token").alias("w")), "w")
    if idf is False:
        tokens = tokens.withColumn("weight", F.lit(1.0))
    else:
        unseen = idf.agg(F.max("idf").alias("most"))  # one row
        tokens = tokens.join(idf, "token", "left").crossJoin(F.broadcast(unseen)).withColumn("weight", F.coalesce("idf", "most", F.lit(0.0)))
    side = lambda text: pairs.select("pair", F.col(text).alias("text")).join(tokens, "text").select("pair", F.col("pos").alias("token"), "vector", "weight")
    scores = metrics.rescale(metrics.greedy_match(side("candidate"), side("reference")), baseline, strict)
    return nested.best_reference(scores.select(F.col(f"pair.{key}").alias(key), "p", "r", "f"), key)
