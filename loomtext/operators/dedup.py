"""Duplicates, samples, order and limits. Rows have an explicit order column; nothing depends on partitions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str], last: bool = False) -> DataFrame:
    """D1, and J1's last-wins: one row of each key, the first (or last) in order. The extreme is aggregated before the shuffle."""
    names = [c for c in df.columns if c not in keys]
    rank = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    best = (F.max_by if last else F.min_by)(F.struct(*names), rank)
    return df.groupBy(*keys).agg(best.alias("_row")).select(*(F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns))


def length_stratum(n_words: Column) -> Column:
    """D3."""
    return F.when(n_words.between(3, 15), "short").when(n_words.between(16, 30), "medium").when(n_words.between(31, 50), "long")


def hash_rank(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def bottom_k(df: DataFrame, by: list[str], k: int, order: list[Column | str], slices: int = 64) -> DataFrame:
    """df's first k rows of each group in order, with their rank `_r`, merged in two steps.

    Each task keeps k rows of a group; those of the tasks of one slice meet first and leave k, then the slices meet. So no task reads more than k rows of a
    group from each of its share of the tasks, however large the group is.
    """
    rank = lambda keys: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    first = df.withColumn("_slice", F.spark_partition_id() % slices).withColumn("_r", rank([*by, "_slice"])).filter(F.col("_r") <= k).drop("_slice", "_r")
    return first.withColumn("_r", rank(by)).filter(F.col("_r") <= k)


def stratified_sample(df: DataFrame, group: str, n_words: Column, key: str, target: int = 3000, shares: tuple = (0.4, 0.4, 0.2), seed: int = 42) -> DataFrame:
    """Per group, quotas of the strata by hash order, topped up from the rest by a second hash to min(n, target) rows.

    At most target keys are taken by strata, so the first 2 * target by the second hash hold all that can be topped up; both come from bottom_k().
    """
    narrow = df.select(group, F.col(key).alias("_k"), length_stratum(n_words).alias("_s"))
    sizes = narrow.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col("_s") == s).alias(f"_{s}") for s in ("short", "medium", "long")))
    goal = F.least(F.col("_n"), F.lit(target))
    quota = {s: F.least(F.col(f"_{s}"), F.floor(goal * share)) for s, share in zip(("short", "medium", "long"), shares, strict=True)}
    q = F.when(F.col("_s") == "short", quota["short"]).when(F.col("_s") == "medium", quota["medium"]).when(F.col("_s") == "long", quota["long"]).otherwise(0)
    sizes = F.broadcast(sizes)  # one row a group, a language or the like
    order = lambda seed: [hash_rank(seed, F.col("_k")), "_k"]
    first = bottom_k(narrow, [group, "_s"], target, order(seed)).join(sizes, group).filter(F.col("_r") <= q).select(group, "_k")
    rest = bottom_k(narrow.select(group, "_k"), [group], 2 * target, order(seed + 1)).drop("_r").join(first, [group, "_k"], "left_anti")
    rest = rest.withColumn("_t", F.row_number().over(W.partitionBy(group).orderBy(*order(seed + 1)))).join(sizes, group)  # 2 * target rows a group
    more = rest.filter(F.col("_t") <= goal - (quota["short"] + quota["medium"] + quota["long"])).select(group, "_k")
    chosen = first.unionAll(more)
    return df.join(chosen.select(group, F.col("_k").alias(key)), [group, key], "left_semi")


def cpython_sample(strata: dict[str, list], target: int = 3000, seed: int = 42) -> list:
    """D4 with CPython's generator, on the driver: for groups small enough to list, where the very same draw is wanted."""
    draw = random.Random(seed)
    total = min(sum(map(len, strata.values())), target)
    chosen: list = []
    for name, share in (("short", 0.4), ("medium", 0.4), ("long", 0.2)):
        rows = strata.get(name, [])
        chosen += draw.sample(rows, min(len(rows), int(total * share)))
    taken = set(chosen)
    rest = [x for rows in strata.values() for x in rows if x not in taken]
    if len(chosen) < total:
        chosen += draw.sample(rest, min(len(rest), total - len(chosen)))
    return chosen


def seeded_cap(df: DataFrame, key: str, cap: int, seed: int = 42) -> DataFrame:
    """At most cap rows, by hash order."""
    return df.orderBy(hash_rank(seed, F.col(key)), key).limit(cap)


def row_cap(df: DataFrame, row_id: str, n: int | None) -> DataFrame:
    """The first n rows by row_id; None is all, 0 none."""
    return df if n is None else df.filter(F.col(row_id) < n)


def head_fraction(df: DataFrame, row_id: str, ratio: float) -> DataFrame:
    """The first int(n * ratio) rows by dense 0-based row_id."""
    n = df.agg(F.floor(F.count(F.lit(1)) * F.lit(ratio)).alias("_n"))
    return df.join(F.broadcast(n), F.col(row_id) < F.col("_n")).drop("_n")


def top_k(df: DataFrame, by: list[str], k: int, order: list[Column]) -> DataFrame:
    """D8, with its rank from 1."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
