"""Near texts by sequence ratio where an index doesn't help: letters and short syllables are in most texts, so texts meet in blocks, and bounds in numpy go before the ratio.

Texts are dealt to buckets by length, so wide that near texts are in one bucket or in two neighbours, and a bucket to slots by hash. Two slots that may hold near texts
meet in one group of rows, a cell. In a cell two bounds on M, the matched characters, are taken for many pairs at a time: what the bags of characters (in CLASSES
classes) share, then the longest common subsequence by bits, of which only the words within the band of allowed shifts are worked on. Matched blocks are a common subsequence, and one that
leaves out at most n - M characters of one text and m - M of the other doesn't leave that band, so no near pair is lost. What passes gets its ratio.

Comparing is quadratic in the texts of a bucket, at some nanoseconds a pair; memory is that of two slots. There are as many slots as keep a slot at about
LEAST_BLOCK texts or 1 / SLOTS of all, so a text is copied to a bounded number of cells, however many texts there are.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

LEAST_BLOCK, SLOTS = 2048, 64
#: Characters of a slot.
BLOCK_CHARACTERS = 4 << 20
#: Classes of characters of the bags, and of the subsequences: the most frequent characters have one each, the others share the last.
CLASSES, SYMBOLS = 32, 63
#: Texts of more characters get their subsequence one pair at a time, as whole numbers of Python.
LONG = 1024
#: Texts of a tile, and pairs whose subsequences are found together.
TILE, PAIRS = (64, 4096), 16384
MOST_TASKS = 2000


def _matched(total, threshold: float):
    """The least number of matched characters of texts of `total` characters together."""
    return np.floor(threshold * np.asarray(total) / 2 - 1e-9).astype(np.int64) + 1


class Texts:
    """Texts in order of length: the codes of their characters (places x texts, SYMBOLS beyond a text's end) and bags."""

    def __init__(self, texts: list[str], codes: np.ndarray):
        self.texts, self.n = texts, np.array([len(x) for x in texts], np.int64)
        most = int(self.n.max())
        self.matrix = np.full((len(texts), min(most, LONG)), SYMBOLS, np.uint8)
        bags = np.zeros((len(texts), CLASSES), np.uint8 if most <= 255 else np.uint16 if most <= 65535 else np.int64)
        for row, x in enumerate(texts):
            own = codes[np.frombuffer(x.encode("utf-32-le"), "<u4")]
            bags[row] = np.bincount(own % CLASSES, minlength=CLASSES)
            if len(x) <= LONG:
                self.matrix[row, : len(x)] = own
        self.matrix, self.bags = self.matrix.T.copy(), bags.T.copy()

    def masks(self, at: np.ndarray, words: int) -> np.ndarray:
        """For each word of 64 places and text, the places of each symbol as bits; none for SYMBOLS."""
        out = np.zeros((words, len(at), SYMBOLS + 1), np.uint64)
        every = np.arange(len(at))
        for j, codes in enumerate(self.matrix[: int(self.n[at].max()), at]):
            out[j >> 6, every, codes] |= np.uint64(1 << (j & 63))
        out[:, :, SYMBOLS] = 0
        return out.reshape(words, -1)


def by_bags(a: Texts, b: Texts, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) whose lengths and bags allow the ratio, tile by tile; each pair once where a is b."""
    wide = max(a.bags.dtype, b.bags.dtype)
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    for i in range(0, len(a.n), TILE[0]):
        n = a.n[i : i + TILE[0]]
        first, last = np.searchsorted(b.n, n[0] * least - 1e-6), np.searchsorted(b.n, n[-1] * most + 1e-6, "right")
        for j in range(max(first, i) if a is b else first, last, TILE[1]):
            m = b.n[j : min(last, j + TILE[1])]
            # no more is shared than the shorter text has, so 8 bits do where one side has at most 255
            kind = wide if min(n[-1], m[-1]) > 255 else np.dtype(np.uint8)
            x, y = (np.minimum(bags, 255).astype(kind) if kind != wide else bags for bags in (a.bags[:, i : i + len(n)], b.bags[:, j : j + len(m)]))
            shared = np.minimum(x[0][:, None], y[0])
            for c in range(1, CLASSES):
                shared += np.minimum(x[c][:, None], y[c])
            s, t = np.nonzero(shared >= np.minimum(_matched(n[0] + m, threshold), np.iinfo(kind).max).astype(kind))  # for the shortest of the tile
            ok = shared[s, t] >= _matched(n[s] + m[t], threshold)
            s, t = s[ok] + i, t[ok] + j
            yield (s[s < t], t[s < t]) if a is b else (s, t)


def _subsequence(x: str, y: str) -> int:
    """The length of the longest common subsequence, with the bits of one whole number."""
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(x)) - 1
    v = whole
    for c in y:
        if u := v & places.get(c, 0):
            v = (v + u | v - u) & whole
    return len(x) - v.bit_count()


def by_subsequence(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the longest common subsequences of pairs (i, j) allow the ratio."""
    n, m = a.n[i], b.n[j]
    need, ok = _matched(n + m, threshold), np.zeros(len(i), bool)
    for at in np.nonzero((n > LONG) | (m > LONG))[0]:
        ok[at] = _subsequence(a.texts[i[at]], b.texts[j[at]]) >= need[at]
    short = np.nonzero((n <= LONG) & (m <= LONG))[0]
    for start in range(0, len(short), PAIRS):
        at = short[start : start + PAIRS]
        ok[at] = _lengths(a, b, i[at], j[at], n[at], m[at], need[at]) >= need[at]
    return ok


def _lengths(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs; where that is below need it may be less, as matches outside the band aren't seen."""
    words, width = (int(n.max()) + 63) >> 6, int(m.max())
    own, i = np.unique(i, return_inverse=True)
    masks, codes = a.masks(own, words), b.matrix
    v = np.full((words, len(i)), np.uint64(2**64 - 1))
    back, on = int((m - need).max()), int((n - need).max())  # how far the place of a match may lie before or behind that in the other text
    base = i * (SYMBOLS + 1)
    for k in range(width):
        at, carry = base + codes[k][j], None
        first, last = max(0, k - back) >> 6, min(words - 1, (k + on) >> 6)
        for w in range(first, last + 1):
            x = v[w]
            u = x & masks[w][at]
            s = x + u
            over = s < u if w < last else None
            if carry is not None:
                s += carry
                over = over | ((s == 0) & carry) if over is not None else None
            v[w] = s | (x - u)
            carry = over
    found = np.zeros(len(i), np.int64)
    for w in range(words):
        kept = np.clip(n - 64 * w, 0, 64)
        inside = np.where(kept >= 64, np.uint64(2**64 - 1), (np.uint64(1) << (kept % 64).astype(np.uint64)) - np.uint64(1))
        found += np.bitwise_count(~v[w] & inside)
    return found


def _codes(texts: list[str]) -> np.ndarray:
    """The symbol of each code point."""
    counts: Counter[str] = Counter()
    for x in texts:
        counts.update(x)
    out = np.full(0x110000, SYMBOLS - 1, np.uint8)
    for k, (c, _) in enumerate(counts.most_common(SYMBOLS - 1)):
        out[ord(c)] = k
    return out


def _compared(one: pd.DataFrame, other: pd.DataFrame | None, codes: np.ndarray, threshold: float, once: bool) -> Iterator[tuple]:
    """(later, earlier, ratio) of rows (id, x) of one with those of other, or with each other; once: no second pair for a row of other."""
    sides = [rows.iloc[np.argsort(rows["x"].str.len().to_numpy(), kind="stable")] for rows in (one, one if other is None else other)]
    ids = [rows["id"].tolist() for rows in sides]
    a = Texts(sides[0]["x"].tolist(), codes)
    b = a if other is None else Texts(sides[1]["x"].tolist(), codes)
    done = np.zeros(len(ids[1]), bool)
    matcher = difflib.SequenceMatcher(None)

    def judged(waiting: list) -> Iterator[tuple]:
        s, t = (np.concatenate(x) for x in zip(*waiting, strict=True))
        ok = by_subsequence(a, b, s, t, threshold)
        # (earlier, later) with their texts: what is known of the earlier text is kept for its next pair
        pairs = [(*sorted([(ids[0][i], a.texts[i]), (ids[1][j], b.texts[j])]), j) for i, j in zip(s[ok].tolist(), t[ok].tolist(), strict=True)]
        for (earlier, y), (later, x), j in sorted(pairs):
            if once and done[j]:
                continue
            if matcher.b is not y and matcher.b != y:
                matcher.set_seq2(y)
            matcher.set_seq1(x)
            if matcher.real_quick_ratio() > threshold and matcher.quick_ratio() > threshold and (ratio := matcher.ratio()) > threshold:
                done[j] = True
                yield later, earlier, ratio

    waiting, size = [], 0
    for s, t in by_bags(a, b, threshold):
        if once:
            s, t = s[~done[t]], t[~done[t]]
        waiting, size = [*waiting, (s, t)], size + len(s)
        if size >= 16 * PAIRS:
            yield from judged(waiting)
            waiting, size = [], 0
    if size:
        yield from judged(waiting)


def near_in_cell(rows: pd.DataFrame, threshold: float, cross: bool, once: bool) -> pd.DataFrame:
    """(later, earlier, ratio) of the rows of a cell; cross: of an old and another text."""
    alone, side, old = rows["k"].iat[0] == rows["l"].iat[0] and rows["s"].iat[0] == rows["t"].iat[0], rows["side"] == 1, rows["old"]
    if cross:
        meetings = [(rows[old], rows[~old])] if alone else [(rows[old & ~side], rows[~old & side]), (rows[old & side], rows[~old & ~side])]
    else:
        meetings = [(rows, None)] if alone else [(rows[~side], rows[side])]
    meetings = [(one, other) for one, other in meetings if len(one) and (other is None or len(other))]
    codes = _codes(rows["x"].tolist()) if meetings else None
    found = [pair for one, other in meetings for pair in _compared(one, other, codes, threshold, once)]
    return pd.DataFrame(found, columns=["later", "earlier", "ratio"])


def cells(texts: DataFrame, threshold: float) -> DataFrame:
    """texts (p, id, x, old) dealt to cells: (p, k, s, l, t, side, id, x, old), k and l being buckets, s and t their slots."""
    wide = math.log((2 - threshold) / threshold * (1 + 1e-6))
    found = texts.withColumn("n", F.char_length("x")).withColumn("bucket", F.floor(F.log(F.col("n").cast("double")) / wide).cast("int"))
    block = max(LEAST_BLOCK, found.count() // SLOTS)
    slots = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_CHARACTERS)).cast("int")
    order = W.partitionBy("p").orderBy("bucket")  # a row for each bucket
    beside = lambda step: F.when(F.lead("bucket", step).over(order) == F.col("bucket") + step, F.lead("own", step).over(order)).otherwise(0)
    plan = found.groupBy("p", "bucket").agg(slots.alias("own")).select("p", "bucket", "own", beside(1).alias("after"), beside(-1).alias("before"))
    found = found.join(plan, ["p", "bucket"]).withColumn("slot", F.pmod(F.xxhash64("id"), F.col("own")).cast("int"))

    def cell(k: Column, s: Column, l: Column, t: Column, side: Column) -> Column:  # noqa: E741
        return F.struct(*(c.cast("int").alias(name) for c, name in ((k, "k"), (s, "s"), (l, "l"), (t, "t"), (side, "side"))))

    def to(count: str, made) -> Column:
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), made)).otherwise(F.array().cast("array<struct<k:int,s:int,l:int,t:int,side:int>>"))

    k, s = F.col("bucket"), F.col("slot")
    all_cells = F.concat(
        to("own", lambda t: cell(k, F.least(s, t), k, F.greatest(s, t), (s > t).cast("int"))),
        to("after", lambda t: cell(k, s, k + 1, t, F.lit(0))),
        to("before", lambda t: cell(k - 1, t, k, s, F.lit(1))),
    )
    return found.select("p", "id", "x", "old", F.explode(all_cells).alias("cell")).select("p", "cell.*", "id", "x", "old")


def near_pairs(texts: DataFrame, threshold: float, cross: bool = False, once: bool = False) -> DataFrame:
    """(later, earlier, ratio) of texts (p, id, x) that are near, which are read three times.

    cross: texts have `old`, and pairs are those of an old text and another, which is later; once: of the pairs of a later text some are enough.
    """
    texts = texts if cross else texts.withColumn("old", F.lit(False))
    key = ["p", "k", "s", "l", "t"]
    tasks = min(MOST_TASKS, 8 * texts.sparkSession.sparkContext.defaultParallelism)
    ids = texts.schema["id"].dataType
    schema = T.StructType([T.StructField("later", ids), T.StructField("earlier", ids), T.StructField("ratio", T.DoubleType())])
    return cells(texts, threshold).repartition(tasks, *key).groupBy(*key).applyInPandas(lambda rows: near_in_cell(rows, threshold, cross, once), schema)
