"""Choosing among the candidates of a record, and the statistics of the choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses that count as usable.
USABLE = ("valid", "repaired_success", "success")


def usable(c: Column) -> Column:
    """Usable and with a back-translation."""
    return c["status"].isin(*USABLE) & (F.coalesce(c["back_translation"], F.lit("")) != "")


def to_back_translate(c: Column) -> Column:
    """Usable, or the greedy one whatever its status."""
    return F.coalesce(c["status"].isin(*USABLE), F.lit(False)) | F.coalesce(c["temperature"] == 0.0, F.lit(False))


def is_hole(c: Column) -> Column:
    """P25: usable, its back-translation missing or blank."""
    return c["status"].isin(*USABLE) & (F.coalesce(F.btrim(c["back_translation"]), F.lit("")) == "")


def best_candidate(candidates: Column) -> Column:
    """struct(index, status, score): the usable candidate with the highest hybrid_score (missing is -1, ties to the lowest index); without any the first one; -1 and `failed` without candidates."""
    indexed = F.transform(candidates, lambda c, i: F.struct(F.coalesce(c["hybrid_score"], F.lit(-1.0)).alias("score"), (-i).alias("minus"), c["status"].alias("status")))
    best = F.array_max(F.filter(indexed, lambda c: c["status"].isin(*USABLE)))
    first = F.get(candidates, F.lit(0))
    return (
        F.when(F.coalesce(F.size(candidates), F.lit(0)) <= 0, F.struct(F.lit(-1).alias("index"), F.lit("failed").alias("status"), F.lit(0.0).alias("score")))
        .when(best.isNotNull(), F.struct((-best["minus"]).alias("index"), best["status"].alias("status"), best["score"].alias("score")))
        .otherwise(F.struct(F.lit(0).alias("index"), first["status"].alias("status"), F.lit(0.0).alias("score")))
    )


def with_best(df: DataFrame, candidates: str = "translations") -> DataFrame:
    """Df with best_candidate_info (index, status, python_code, back_translation, scores) and its code and score flattened beside it; the code is null without candidates."""
    rows = df.withColumn("_b", best_candidate(F.col(candidates)))
    chosen = F.get(F.col(candidates), F.col("_b.index"))
    has = lambda field: field in df.schema[candidates].dataType.elementType.names
    scores = chosen["scores"] if has("scores") else F.struct(F.lit(None).cast("double").alias("jina"), F.lit(None).cast("double").alias("bleu"), chosen["hybrid_score"].alias("hybrid"))
    info = F.struct(F.col("_b.index").alias("index"), F.col("_b.status").alias("status"), chosen["code"].alias("python_code"), chosen["back_translation"].alias("back_translation"), scores.alias("scores"))
    return rows.withColumns({"best_candidate_info": info, "best_python_code": chosen["code"], "best_score_hybrid": F.col("_b.score")}).drop("_b")


def shortest_invalid(candidates: Column) -> Column:
    """Of the candidates that aren't valid, the one with the shortest code (an empty one counts as 9999 long), the first on ties."""
    ranked = F.transform(candidates, lambda c, i: F.struct(F.when(F.coalesce(F.length(c["code"]), F.lit(0)) > 0, F.length(c["code"])).otherwise(9999).alias("n"), i.alias("i"), c.alias("c")))
    return F.array_min(F.transform(F.filter(ranked, lambda r: r["c"]["status"] != "valid"), lambda r: F.struct(r["n"], r["i"])))["i"]


def greedy_candidate(candidates: Column, tolerance: float | None = None) -> Column:
    """The first candidate of temperature 0, exactly, or within tolerance and else candidate 0."""
    if tolerance is None:
        return F.get(F.filter(candidates, lambda c: c["temperature"] == 0.0), F.lit(0))
    return F.coalesce(F.get(F.filter(candidates, lambda c: F.abs(c["temperature"]) < tolerance), F.lit(0)), F.get(candidates, F.lit(0)))


def candidate_status(candidates: Column) -> tuple[Column, Column]:
    """A4: (valid_count, row status)."""
    n = F.size(F.filter(candidates, lambda c: c["status"] == "valid"))
    return n, F.when(n > 0, "success").otherwise("all_failed")


def hybrid(cosine: Column, bleu: Column, w_cosine: Column, w_bleu: Column) -> Column:
    """L5's score: BLEU above 1 is a percentage; a missing BLEU is 0."""
    b = F.coalesce(bleu, F.lit(0.0))
    return w_cosine * cosine + w_bleu * F.when(b > 1, b / 100).otherwise(b)


def weight_grid(scored: DataFrame, weights: list[tuple[float, float]]) -> DataFrame:
    """L5 for each (w_bleu, w_cosine): scored (item, cand, cosine, bleu) to the best candidate of each item."""
    grid = F.explode(F.array(*(F.struct(F.lit(b).alias("w_bleu"), F.lit(c).alias("w_cosine")) for b, c in weights)))
    rows = scored.withColumn("_w", grid).select("item", "cand", "_w.w_bleu", "_w.w_cosine", F.round(hybrid(F.col("cosine"), F.col("bleu"), F.col("_w.w_cosine"), F.col("_w.w_bleu")), 9).alias("score"))
    best = F.max(F.struct("score", (-F.col("cand")).alias("minus")))
    return rows.groupBy("item", "w_bleu", "w_cosine").agg(best.alias("b")).select("item", "w_bleu", "w_cosine", (-F.col("b.minus")).alias("cand"), F.col("b.score").alias("score"))


def base_vs_best(rows: DataFrame, metrics: list[str], group: str = "lang", name: str = "AVERAGE") -> DataFrame:
    """Means by group, and a row of the unweighted means of those means."""
    means = rows.groupBy(group).agg(*(F.avg(m).alias(m) for m in metrics))
    return means.unionByName(means.agg(F.lit(name).alias(group), *(F.avg(m).alias(m) for m in metrics)))


def temperature_curve(rows: DataFrame, temperatures: list[float], model: str = "model", item: str = "item") -> DataFrame:
    """(model, temperature, mean, max): each item's mean and maximum at a temperature (matched within 1e-4), averaged over items."""
    at = F.lit(None).cast("double")
    for x in temperatures:
        at = F.when(F.abs(F.col("temperature") - x) < 1e-4, x).otherwise(at)
    each = rows.withColumn("t", at).filter("t is not null").groupBy(model, item, "t").agg(F.avg("score").alias("mean"), F.max("score").alias("max"))
    return each.groupBy(model, F.col("t").alias("temperature")).agg(F.avg("mean").alias("mean"), F.avg("max").alias("max"))
