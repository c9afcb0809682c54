"""Statistics over scores: intervals and the paired signed-rank test. Quantiles are plan-time literals, found on the driver."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomtext.session import stored


def wilson(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """struct(lower, upper); null unless 0 <= k <= n and n > 0."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.when((n > 0) & (k >= 0) & (k <= n), F.struct((middle - half).alias("lower"), (middle + half).alias("upper")))


def wilson_interval(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """E12 for two numbers; errors where there is no interval."""
    if n <= 0:
        raise ValueError("n must be positive")
    if not 0 <= k <= n:
        raise ValueError("k must lie in [0, n]")
    z, p = NormalDist().inv_cdf(1 - (1 - confidence) / 2), k / n
    middle, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + term * d), 1 + term / c
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total


def t_quantile(p: float, freedom: int) -> float:
    """Student's t quantile for p in (0.5, 1), by bisection of its distribution function."""
    tail = lambda x: 0.5 * _incomplete_beta(freedom / 2, 0.5, freedom / (freedom + x * x))
    low, high = 0.0, 1.0
    while tail(high) > 1 - p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if tail(middle) > 1 - p else (low, middle)
    return (low + high) / 2


def mean_interval(df: DataFrame, value: str, confidence: float = 0.95) -> DataFrame:
    """One row (n, mean, lower, upper); an error with fewer than two values."""
    one = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    n = one.first()["n"]
    if n < 2:
        raise ValueError("at least two values are needed")
    half = t_quantile(1 - (1 - confidence) / 2, n - 1) * F.col("sd") / F.sqrt("n")
    return one.select("n", "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))


def running_below(groups: DataFrame, order: str, count: str, name: str, ranges: int | None = None) -> DataFrame:
    """groups with name, the sum of `count` over all rows with a smaller `order` (unique, not null).

    Rows are cut into ranges of like size from a sample; each range adds up for itself and is shifted by the sums of those before, one number
    a range. No task sees more than its range.
    """
    spark = groups.sparkSession
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(stored(groups, "groups").repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = {r["_p"]: r["_c"] for r in ranged.groupBy("_p").agg(F.sum(count).alias("_c")).collect()}  # one row a range
    shifts = list(itertools.accumulate([sums.get(p, 0) for p in range(parts)], initial=0))
    shift = F.broadcast(spark.createDataFrame(list(enumerate(shifts[:-1])), "_p int, _o long"))
    within = F.sum(count).over(W.partitionBy("_p").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(count)
    return ranged.withColumn(name, within).join(shift, "_p").withColumn(name, F.col(name) + F.col("_o")).drop("_p", "_o")


def signed_ranks(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, w_plus, w_minus, ties): sums of average ranks of the non-zero differences; ties is the sum of t^3 - t over tied groups.

    Ranks come from counts of distinct absolute differences: how many rows lie below each is a running sum over ranges of them.
    """
    d = df.select((F.col(a) - F.col(b)).alias("d")).filter("d is not null and d <> 0")
    groups = d.groupBy(F.abs("d").alias("v")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = running_below(groups, "v", "c", "below").withColumn("rank", F.col("below") + (F.col("c") + 1) / 2)
    return ranked.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("rank") * F.col("up")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.col("rank") * (F.col("c") - F.col("up"))), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")), F.lit(0)).alias("ties"),
    )


def signed_rank_p(n: int, w_plus: float, ties: int, alternative: str = "two-sided", exact_up_to: int = 50) -> float:
    """The p value: exact for n up to exact_up_to without ties, else by the tie-corrected normal approximation."""
    if alternative not in ("two-sided", "less", "greater"):
        raise ValueError(alternative)
    if n == 0:
        return 1.0
    top = n * (n + 1) / 2
    if n <= exact_up_to and not ties:
        ways = [1] + [0] * int(top)
        for r in range(1, n + 1):
            for s in range(int(top), r - 1, -1):
                ways[s] += ways[s - r]
        total, w = 2**n, int(w_plus)
        less, greater = sum(ways[: w + 1]) / total, sum(ways[w:]) / total
        return {"less": less, "greater": greater, "two-sided": min(1.0, 2 * min(less, greater))}[alternative]
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    z = (w_plus - top / 2) / sd
    if alternative == "two-sided":
        return 2 * NormalDist().cdf(-abs(z))
    return NormalDist().cdf(z if alternative == "less" else -z)


def wilcoxon(df: DataFrame, a: str, b: str, alternative: str = "two-sided") -> dict[str, float]:
    """Statistic (the smaller sum for two-sided, else the positive one) and p value."""
    row = signed_ranks(df, a, b).first()
    p = signed_rank_p(row["n"], row["w_plus"], row["ties"], alternative)
    return {"statistic": min(row["w_plus"], row["w_minus"]) if alternative == "two-sided" else row["w_plus"], "p": p}
