"""Joins and record combination. Positional pairing is always an equi-join on an explicit row_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomtext.functions import text as t
from loomtext.operators.dedup import keep_first


def last_wins_merge(a: DataFrame, b: DataFrame, order: str, field: str = "raw_code", key_a: str = "idx", key_b: str = "id") -> DataFrame:
    """Rows of b with their `field` added to the row of a that has b's id; of a's rows with one idx the last counts."""
    latest = keep_first(a.filter(F.col(key_a).isNotNull()), [key_a], [order], last=True)
    return latest.drop(field).join(b.select(F.col(key_b).alias(key_a), field), key_a)


def merge_counts(a: DataFrame, b: DataFrame, field: str = "raw_code", key_a: str = "idx", key_b: str = "id", corrupt: str | None = None) -> DataFrame:
    """J1's report: merged, not_found, missing_field, and json_error if `corrupt` names the column of b's lines that didn't parse."""
    known = a.select(F.col(key_a).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    rows = b.join(known, F.col(key_b) == F.col("_k"), "left")
    bad = F.col(corrupt).isNotNull() if corrupt else F.lit(False)
    lacks = ~bad & (F.col(field).isNull() | F.col(key_b).isNull())
    whole = ~bad & ~lacks
    return rows.agg(
        F.count_if(whole & F.col("_hit").isNotNull()).alias("merged"),
        F.count_if(whole & F.col("_hit").isNull()).alias("not_found"),
        F.count_if(lacks).alias("missing_field"),
        *([F.count_if(bad).alias("json_error")] if corrupt else []),
    )


def verify_anchor(summaries: DataFrame, source: DataFrame, index: str = "index") -> DataFrame:
    """Summaries with content and verified: whether the normalised summary lies in the source row's; rows without a source row are left out."""
    rows = summaries.join(source.select(F.col("row_id").alias(index), "content"), index)
    return rows.withColumn("verified", F.contains(t.alnum(F.col("content")), t.alnum(F.col("summary"))))


def anchor_report(checked: DataFrame) -> DataFrame:
    """A3: rows checked and passed, and the rate in percent."""
    n, ok = F.count(F.lit(1)), F.count_if("verified")
    return checked.agg(n.alias("checked"), ok.alias("passed"), F.try_divide(ok * 100.0, n.cast("double")).alias("pass_rate"))


def zip_inputs(code: DataFrame, structure: DataFrame | None = None, ranked: DataFrame | None = None, gapless: bool = False) -> DataFrame:
    """Inputs paired by row_id, as many rows as the shortest has; a bad ranked line is an empty list, any other drops the row.

    structure and ranked take part only if given. Records are null where a line was bad. idx counts from 1, with gaps or without.
    """
    out = code
    if structure is not None:
        out = out.join(structure, "row_id")
    if ranked is not None:
        lines = ranked.withColumn("candidates", F.coalesce("candidates", F.array().cast(ranked.schema["candidates"].dataType)))
        out = out.join(lines, "row_id")
    out = out.filter(F.col("code").isNotNull())
    if structure is not None:
        out = out.filter(F.col("snippets").isNotNull())
    if not gapless:
        return out.withColumn("idx", F.col("row_id") + 1)
    return dense_rank(out, "row_id", "idx")


def dense_rank(df: DataFrame, order: str, name: str, rows_a_range: int = 1 << 20) -> DataFrame:
    """name: 1, 2, ... by `order` (unique, whole numbers) without sorting all in one task: ranges are ranked apart and shifted by the counts of those before."""
    ranged = df.withColumn("_b", F.floor(F.col(order) / rows_a_range))
    counts = ranged.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_b", (F.sum("_c").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_c")).alias("_o"))
    ranged = ranged.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(order)))
    return ranged.join(F.broadcast(before), "_b").withColumn(name, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def common_ids(references: DataFrame, predictions: list[DataFrame], one_based: bool = False) -> DataFrame:
    """The reference ids for which every prediction file has a line; one_based if lines are numbered from 1 there."""
    ids = references.select("uid").distinct()
    for p in predictions:
        ids = ids.intersect(p.select((F.col("row_id") + int(one_based)).alias("uid")))
    return ids


def align(references: DataFrame, predictions: dict[str, DataFrame], one_based: bool = False) -> DataFrame:
    """References with the text of each prediction as a column, for the common ids."""
    out = references.join(common_ids(references, list(predictions.values()), one_based), "uid")
    for name, p in predictions.items():
        out = out.join(p.select((F.col("row_id") + int(one_based)).alias("uid"), F.col("text").alias(name)), "uid")
    return out


def pair_maps(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, prediction, references[]): the last prediction of an id, and its golds in order, for ids that have both. Inputs: (row_id, id, text)."""
    last = keep_first(predictions, ["id"], ["row_id"], last=True).select("id", F.col("text").alias("prediction"))
    refs = gold.join(last.select("id"), "id", "left_semi").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "text"))), lambda r: r["text"]).alias("references"))
    return last.join(refs, "id")
