"""Near-duplicate texts by sequence ratio (Ratcliff-Obershelp): exact candidates from a prefix filter, and the ordered rule without all pairs.

A ratio above t means M matched characters with 2 * M > t * T, T being the characters of both texts. The matched blocks stand in one order in
both texts, with a character that isn't matched between any two, so there are at most T - 2 * M + 1 blocks, and the texts share at least
3 * M - T - 1 pairs of neighbouring characters as multisets (the k-th occurrence of a pair is an element of its own). That is a bound on the overlap of two sets. With the elements in one order
for all texts, rarest first, two texts that reach it share an element among the first of each: as many as its size less the least overlap with any
partner, and one. Texts so short that they may share no pair of characters are joined by single characters as well, and for thresholds up to 2/3 all are.

The order follows counts over all texts. The most frequent elements are ranked, at most MOST_RANKED; the others are rarer than those and come first.
"""

from __future__ import annotations

import difflib
import functools
import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.operators import near_blocks
from loomtext.session import stored

#: Elements whose rank every task holds, of about 100 bytes each.
MOST_RANKED = 100_000
#: Rounds in which texts meet the earliest ones of their elements, before what is left is joined pair by pair.
ROUNDS = 6
#: Texts that are compared in one wave; more are dealt by id to PIECES ranges, and the waves end before these.
AT_ONCE, PIECES, WAVES = 20_000, 64, [1, 8, 64]


def least_overlap(total: int, threshold: float, width: int) -> int:
    """The least number of shared elements of two texts of `total` characters together: of pairs of characters (width 2) or characters (1)."""
    matched = math.floor(threshold * total / 2 - 1e-9) + 1
    return 3 * matched - total - 1 if width == 2 else matched


def shortest_partner(n: int, threshold: float) -> int:
    """The fewest characters that a text near one of n characters can have."""
    return max(1, math.floor(n * threshold / (2 - threshold) - 1e-9) + 1)


@functools.lru_cache(10_000)
def least_with_any(n: int, threshold: float, width: int) -> int:
    """The least overlap of a text of n characters with any partner."""
    longest = math.ceil(n * (2 - threshold) / threshold) + 1
    return min(least_overlap(n + m, threshold, width) for m in range(shortest_partner(n, threshold), longest + 1))


@functools.lru_cache(16)
def bare_total(threshold: float) -> float:
    """Texts of so many characters together may share no pair of characters."""
    if threshold <= 2 / 3:
        return math.inf
    enough = math.ceil(2 / (1.5 * threshold - 1)) + 2
    return max((total for total in range(2, enough) if least_overlap(total, threshold, 2) < 1), default=0)


def elements(text: str, width: int) -> list[str]:
    """The pairs of characters, or characters, numbered by occurrence."""
    seen: Counter[str] = Counter()
    out = []
    for i in range(len(text) - width + 1):
        part = text[i : i + width]
        seen[part] += 1
        out.append(f"{width}{part}{seen[part]}")
    return out


def widths_of(n: int, threshold: float) -> list[int]:
    """The kinds of elements by which a text of n characters finds all its partners."""
    bare = bare_total(threshold)
    return [1] if bare == math.inf else [2, 1] if n + shortest_partner(n, threshold) <= bare else [2]


def prefix(text: str, threshold: float, rank: dict[str, int]) -> list[str]:
    """The elements of which one is shared with every text near this one."""
    out = []
    for width in widths_of(len(text), threshold):
        own = sorted(elements(text, width), key=lambda e: (rank.get(e, -1), e))
        least = max(1, least_with_any(len(text), threshold, width))
        out += own[: max(0, len(own) - least + 1)]
    return out


def bag(text: str) -> list[int] | None:
    """How many characters fall in each of 16 classes, eight to a number of 64 bits; null if a class has more than 255."""
    counts = [0] * 16
    for c, n in Counter(text).items():
        counts[ord(c) & 15] += n
    if max(counts) > 255:
        return None
    return [int.from_bytes(bytes(counts[i : i + 8]), "little", signed=True) for i in range(0, 16, 8)]


def _counts(threshold: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for part in parts:
            for text in part["x"]:
                counts.update(e for width in widths_of(len(text), threshold) for e in elements(text, width))
            if len(counts) > MOST_RANKED:
                yield pd.DataFrame({"element": list(counts), "n": list(counts.values())})
                counts.clear()
        if counts:
            yield pd.DataFrame({"element": list(counts), "n": list(counts.values())})

    return run


def ranks(texts: DataFrame, threshold: float) -> dict[str, int]:
    """Rank by frequency of the most frequent elements of texts (x)."""
    counted = texts.select("x").mapInPandas(_counts(threshold), "element string, n long").groupBy("element").agg(F.sum("n").alias("n"))
    most = counted.orderBy(F.desc("n"), "element").limit(MOST_RANKED).collect()  # bounded
    return {r.element: len(most) - i for i, r in enumerate(most)}


def index(texts: DataFrame, threshold: float) -> DataFrame:
    """(p, element, id, n, bag): the prefixes of texts (p, id, x)."""
    rank = ranks(texts, threshold)
    kinds = texts.select("p", "id").schema.fields + [T.StructField("n", T.IntegerType()), T.StructField("bag", T.ArrayType(T.LongType())), T.StructField("elements", T.ArrayType(T.StringType()))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in filter(len, parts):
            yield part[["p", "id"]].assign(n=part["x"].map(len).astype("int32"), bag=part["x"].map(bag), elements=part["x"].map(lambda x: prefix(x, threshold, rank)))

    found = texts.select("p", "id", "x").mapInPandas(run, T.StructType(kinds))
    return found.select("p", F.explode("elements").alias("element"), "id", "n", *(F.get("bag", F.lit(i)).alias(f"b{i}") for i in range(2)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(later: pd.Series, earlier: pd.Series) -> pd.Series:
    """The ratio; the order of the arguments matters."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(later, earlier, strict=True)], dtype=float)


def _ratio_above(threshold: float):
    """The ratio where it is above the threshold, else null. Upper bounds go first, and what is known of the earlier text is kept for its next pair."""

    @F.pandas_udf(T.DoubleType())
    def run(later: pd.Series, earlier: pd.Series) -> pd.Series:
        matcher, out = difflib.SequenceMatcher(None), []
        for a, b in zip(later, earlier, strict=True):
            if matcher.b is not b and matcher.b != b:
                matcher.set_seq2(b)
            matcher.set_seq1(a)
            near = matcher.real_quick_ratio() > threshold and matcher.quick_ratio() > threshold
            ratio = matcher.ratio() if near else 0.0
            out.append(ratio if ratio > threshold else None)
        return pd.Series(out, dtype=float)

    return run


def _texts(df: DataFrame, row_id: str, text: str, part: str | None) -> DataFrame:
    p = F.col(part).cast("string") if part else F.lit("")
    return df.select(F.col(row_id).alias("id"), F.coalesce(p, F.lit("")).alias("p"), F.col(text).alias("x")).filter("x <> ''")


#: Of two numbers: with more, the condition of a join would be too large a method for the JVM to compile.
BAG = [f"b{i}" for i in range(2)]


def _close(one: str, other: str, threshold: float) -> Column:
    """Lengths (n) and classes of characters (BAG) of two structs that allow the ratio: no more characters can be matched than the classes share."""
    n, m = F.col(f"{one}.n"), F.col(f"{other}.n")
    count = lambda row, i, k: F.shiftrightunsigned(F.col(f"{row}.b{i}"), 8 * k).bitwiseAND(255)
    shared = functools.reduce(lambda a, b: a + b, [F.least(count(one, i, k), count(other, i, k)) for i in range(2) for k in range(8)])
    return (F.least(n, m) > F.greatest(n, m) * (threshold / (2 - threshold)) - 1e-9) & F.coalesce(2 * shared > (n + m) * threshold - 1e-9, F.lit(True))


def _judged(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(later, earlier, ratio) of the candidates that are near."""
    named = lambda name: texts.select(F.col("id").alias(name), F.col("x").alias(f"{name}_x"))
    both = pairs.join(named("later"), "later").join(named("earlier"), "earlier")
    return both.select("later", "earlier", _ratio_above(threshold)("later_x", "earlier_x").alias("ratio")).filter("ratio is not null")


def _candidates(found: DataFrame, threshold: float) -> DataFrame:
    """(later, earlier): texts that share an element of their prefixes, once."""
    side = lambda name: found.select("p", "element", F.struct("id", "n", *BAG).alias(name))
    joined = side("a").join(side("b"), ["p", "element"]).filter((F.col("b.id") < F.col("a.id")) & _close("a", "b", threshold))
    return joined.select(F.col("a.id").alias("later"), F.col("b.id").alias("earlier")).distinct()


def near_duplicate_pairs(df: DataFrame, row_id: str, text: str, threshold: float = 0.85, part: str | None = None, by_index: bool = False) -> DataFrame:
    """(later, earlier, ratio) of all pairs, within a part, whose ratio is above threshold. Null and empty texts have none; ids are unique.

    The result holds every pair of a group of copies; near_first_wins() keeps the first of each without them. by_index pays where most pairs of characters are rare.
    """
    texts = stored(_texts(df, row_id, text, part), "near-texts")
    return _judged(_candidates(index(texts, threshold), threshold), texts, threshold) if by_index else near_blocks.near_pairs(texts, threshold)


def first_wins(pairs: DataFrame, df: DataFrame, row_id: str, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Df without the rows that an earlier kept row is near: the first maximal independent set in the order of row_id.

    Each round drops what has a kept earlier neighbour and keeps what has none left undecided; checkpoint(df) cuts the lineage.
    """
    return df.join(_dropped(pairs, checkpoint).withColumnRenamed("id", row_id), row_id, "left_anti")


def _dropped(pairs: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    edges = checkpoint(pairs.select("later", "earlier"))
    state = checkpoint(edges.select(F.explode(F.array("later", "earlier")).alias("id")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while state.filter("kept is null").limit(1).count():
        met = edges.join(state.withColumnRenamed("id", "earlier"), "earlier").groupBy("later").agg(F.max(F.coalesce("kept", F.lit(False))).alias("hit"), F.max(F.col("kept").isNull()).alias("open"))
        found = state.join(met.withColumnRenamed("later", "id"), "id", "left")
        state = checkpoint(found.select("id", F.coalesce("kept", F.when(F.col("hit"), False).when(~F.coalesce("open", F.lit(False)), True)).alias("kept")))
    return state.filter("not kept").select("id")


def _round(open_rows: DataFrame, threshold: float, checkpoint: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Of an index: the ids that are the earliest of all their elements, and the pairs (later, earlier) of others with those."""
    text = F.struct("id", "n", *BAG)
    first = open_rows.groupBy("p", "element").agg(F.min_by(text, "id").alias("first"))
    met = checkpoint(open_rows.select("p", "element", text.alias("own")).join(first, ["p", "element"]).select("own", "first").distinct())
    behind = met.filter("first.id < own.id")
    kept = met.select("own.id").distinct().join(behind.select("own.id"), "id", "left_anti")
    asked = behind.filter(_close("own", "first", threshold)).select(F.col("own.id").alias("later"), F.col("first.id").alias("earlier"))
    return kept, asked.join(kept.withColumnRenamed("id", "earlier"), "earlier", "left_semi")


def near_first_wins(df: DataFrame, row_id: str, text: str, checkpoint: Callable[[DataFrame], DataFrame], threshold: float = 0.85, part: str | None = None, rounds: int = ROUNDS, by_index: bool = False, at_once: int = AT_ONCE) -> DataFrame:
    """D2 without all pairs: df without the rows that an earlier kept row of their part is near. Null and empty texts stay; ids are unique."""
    texts = checkpoint(_texts(df, row_id, text, part))
    lost = _lost_by_index(texts, checkpoint, threshold, rounds) if by_index else _lost_by_blocks(texts, checkpoint, threshold, at_once)
    return df.join(lost.withColumnRenamed("id", row_id), row_id, "left_anti")


def _lost_by_blocks(texts: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], threshold: float, at_once: int) -> DataFrame:
    """The ids that go. More than at_once texts go in waves by id, the first ones being few: what is near a kept text of an earlier wave goes without its pairs,
    so of a large group of near texts only those of the first wave are paired with each other."""
    pieces, shares = (1, [1]) if texts.count() <= at_once else (PIECES, WAVES)
    texts = checkpoint(texts.repartitionByRange(pieces, "id").withColumn("piece", F.spark_partition_id()))
    lost, kept, start = texts.select("id").limit(0), None, 0
    for end in shares:
        wave = texts.filter(F.col("piece").between(start, end - 1)).drop("piece")
        if kept is not None:
            both = kept.withColumn("old", F.lit(True)).unionByName(wave.withColumn("old", F.lit(False)))
            gone = checkpoint(near_blocks.near_pairs(both, threshold, cross=True, once=True).select(F.col("later").alias("id")).distinct())
            wave, lost = wave.join(gone, "id", "left_anti"), lost.unionAll(gone)
        wave = checkpoint(wave)
        gone = _dropped(near_blocks.near_pairs(wave, threshold), checkpoint)
        lost, start = lost.unionAll(gone), end
        if end < pieces:
            left = wave.join(gone, "id", "left_anti")
            kept = checkpoint(left if kept is None else kept.unionByName(left))
    return lost


def _lost_by_index(texts: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], threshold: float, rounds: int) -> DataFrame:
    """The ids that go.

    In a round every open text meets the earliest open text of each element of its prefix, if lengths allow a ratio. A text that is the earliest of all its elements
    is kept: no open text before it is near. All that share an element with it are compared with it in that round, and those near it go, so it is
    done with. A round compares no more pairs than there are elements; a group of copies is gone after its first text is kept. Texts still open after
    `rounds` rounds are unlike what was kept; they are joined pair by pair, through the same index.
    """
    open_rows = checkpoint(index(texts, threshold))
    lost = texts.select("id").limit(0)
    for _ in range(rounds):
        if not open_rows.limit(1).count():
            break
        kept, asked = _round(open_rows, threshold, checkpoint)
        gone = checkpoint(_judged(asked, texts, threshold).select(F.col("later").alias("id")).distinct())
        lost = lost.unionAll(gone)
        open_rows = checkpoint(open_rows.join(kept.unionAll(gone), "id", "left_anti"))
    if open_rows.limit(1).count():
        lost = lost.unionAll(_dropped(_judged(_candidates(open_rows, threshold), texts, threshold), checkpoint))
    return lost
