"""Nested arrays: flatten, re-nest, select, pad and update, without joins where the ids travel along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_candidates(df: DataFrame, key: str, main: str, candidates: str) -> DataFrame:
    """One row for the main item and one for each candidate: (key, pos, item_id, item); pos 0 is the main one."""
    items = F.concat(F.array(main), F.coalesce(candidates, F.array().cast(df.schema[candidates].dataType)))
    flat = df.select(key, F.posexplode_outer(items).alias("pos", "item"))
    name = F.when(F.col("pos") == 0, "main").otherwise(F.concat(F.lit("cand_"), (F.col("pos") - 1).cast("string")))
    return flat.select(key, "pos", F.concat(F.col(key).cast("string"), F.lit("_"), name).alias("item_id"), "item")


def renest(flat: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the main value and the candidates' in order."""
    rows = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("_all"))
    values = F.transform("_all", lambda r: r[value])
    return rows.select(key, F.get(values, F.lit(0)).alias(value), F.slice(values, F.lit(2), F.greatest(F.size(values), F.lit(1))).alias(f"candidate_{value}"))


def masked_select(items: Column, labels: Column) -> Column:
    """Items whose label is 1."""
    return F.filter(items, lambda x, i: F.coalesce(F.get(labels, i) == 1, F.lit(False)))


def padded(items: Column, n: int, pad: Column) -> tuple[Column, Column]:
    """(exactly n items, 0/1 mask of the real ones)."""
    cut = F.slice(items, 1, n)
    size = F.size(cut)
    return F.concat(cut, F.array_repeat(pad, F.lit(n) - size)), F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), F.lit(n) - size))


def padded_tokens(statements: Column, most: int = 32, each: int = 32, pad: str = "") -> tuple[Column, Column, Column]:
    """The first `most` statements as arrays of exactly `each` tokens, with the mask of real tokens of each statement and the mask of real statements."""
    split = F.transform(statements, lambda s: F.slice(F.filter(F.split(s, r"\s+"), lambda w: w != ""), 1, each))
    rows, mask = padded(split, most, F.array().cast("array<string>"))
    fill = lambda r, x: F.concat(r, F.array_repeat(x, F.lit(each) - F.size(r)))
    real = F.transform(rows, lambda r: fill(F.transform(r, lambda _: F.lit(1)), F.lit(0)))
    return F.transform(rows, lambda r: fill(r, F.lit(pad))), real, mask


def update_each(items: Column, field: str, new) -> Column:
    """One field of every element set to new(element), the others kept."""
    return F.transform(items, lambda x: x.withField(field, new(x)))


def snippet_fallback(snippets: Column, function_def: Column, first_of_list: bool = False) -> Column:
    """Snippets; if none has text, the function's definition line; else none. first_of_list takes it from a list."""
    some = F.exists(F.coalesce(snippets, F.array().cast("array<string>")), lambda s: F.coalesce(F.btrim(s), F.lit("")) != "")
    one = F.get(function_def, F.lit(0)) if first_of_list else function_def
    return F.when(some, snippets).when(F.coalesce(F.btrim(one), F.lit("")) != "", F.array(one)).otherwise(F.array().cast("array<string>"))


def best_reference(scores: DataFrame, key: str) -> DataFrame:
    """The maximum over references of precision, recall and F, each for itself."""
    return scores.groupBy(key).agg(*(F.max(c).alias(c) for c in ("p", "r", "f")))
