"""Quality rules: base statistics, then a hashed n-gram logistic regression with calibrated probabilities.

Training takes at most `most_labelled` labelled rows (those with the least hash of their id), two thirds for the weights and
a third for Platt's calibration. A document's features are its words, pairs of neighbouring words, and the three- and
four-character parts of its words, hashed to 2**18 weights; its score is their mean weight, so each distinct word is
worked out once per worker. A document is kept if it passes the base rules and its probability reaches `threshold`.

A null, empty or blank text has no words and fails the base rules. Without labels of both classes the base rules decide
alone (probability null). Repeated rows get equal verdicts; equal ids with unlike labels all count in training. A very long
text is scored whole. An empty table gives an empty result. Other columns are kept; those named like result columns give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import Hashes, chunks, merged_ranges, mixed, ngram_cells, packed, rolling, sums_by_word, table, trimmed, unpacked, word_hashes

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
MADE = [*BASE, "quality", "kept"]
BITS = 18
SYMBOLS = [c.encode() for c in "#*$%&|<>"]
WHITE = b" \t\n\x0b\x0c\r"
MOST_LABELLED = 2000
_SEED = 6
_BASE3, _PAIR = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def part_features(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells of the three- and four-character parts of words between marks, with the number of each word's."""
    texts = [w.decode("utf-8", "replace") for w in words]
    return [ngram_cells(texts, n, BITS) for n in (3, 4)]


def word_features(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def pair_features(hashes: np.ndarray) -> np.ndarray:
    return (mixed(rolling(hashes, 2, _PAIR)) >> np.uint64(64 - BITS)).astype(np.int64)


class _Weights(dict):
    """Word to (sum of its parts' weights, number of parts) as one complex number, which sums keep apart."""

    def __init__(self, weights: np.ndarray, most: int = 200_000):
        super().__init__()
        self.weights, self.most = weights, most

    def learn(self, words: list[bytes]) -> None:
        """Add the words that are new, all at once; forgets the others first when it gets large."""
        new = set(words).difference(self)
        if len(self) + len(new) > self.most:
            self.clear()
            new = set(words)
        new = list(new)
        total = np.zeros(len(new), np.complex128)
        for cells, counts in part_features(new):
            total += sums_by_word(self.weights[cells], counts) + 1j * counts
        self.update(zip(new, total.tolist(), strict=True))


def _base_counts(texts: list[bytes | None], hashes: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    ends = np.cumsum(counts)
    starts = ends - counts
    n = len(hashes)
    doc = np.repeat(np.arange(len(texts)), counts)
    triples = rolling(hashes, 3, _BASE3)
    at = np.flatnonzero(np.repeat(ends, counts)[: len(triples)] - np.arange(len(triples)) >= 3)
    keys = mixed(triples[at] + doc[at].astype(np.uint64) * np.uint64(_PAIR))
    _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = at[times[inverse] > 1]
    covered = np.concatenate([[0], np.cumsum(merged_ranges(again, again + 3, n))])
    out = {"n_words": counts, "n_repeat_words": covered[ends] - covered[starts]}
    chars, symbols, lines = [], [], []
    for text in texts:
        text = text or b""
        bare = text.translate(None, WHITE)
        chars.append(len(bare.decode()))
        symbols.append(sum(bare.count(c) for c in SYMBOLS))
        own = [x for x in text.split(b"\n") if x.strip()]
        lines.append(len(own) - len(set(own)))
    return out | {"word_chars": np.array(chars), "n_symbols": np.array(symbols), "n_dup_lines": np.array(lines)}


def _scores(texts: list[bytes | None], hashes: np.ndarray, counts: np.ndarray, weights: np.ndarray, cache: _Weights) -> np.ndarray:
    """The mean weight of all features of each text."""
    ends = np.cumsum(counts)
    starts = ends - counts
    own = [(t or b"").split() for t in texts]
    cache.learn([w for words in own for w in words])
    parts = np.fromiter((sum(map(cache.__getitem__, words)) for words in own), np.complex128, len(texts))
    n_pairs = np.maximum(counts - 1, 0)
    pairs = np.concatenate([[0.0], np.cumsum(weights[pair_features(hashes)], dtype=np.float64)])
    single = np.concatenate([[0.0], np.cumsum(weights[word_features(hashes)], dtype=np.float64)])
    first = np.minimum(starts, len(pairs) - 1)
    total = parts.real + single[ends] - single[starts] + pairs[np.minimum(first + n_pairs, len(pairs) - 1)] - pairs[first]
    return total / np.maximum(parts.imag + counts + n_pairs, 1)


def _scored(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = model.value
        cache, weights = Hashes(_SEED), None
        if got is not None:
            weights, slope, shift = got
            values = _Weights(weights)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            columns: dict[str, list] = {c: [] for c in MADE}
            for a, b in chunks(texts):
                hashes, counts = word_hashes(texts[a:b], cache)
                base = _base_counts(texts[a:b], hashes, counts)
                failed = (counts < 50) | (100 * base["n_repeat_words"] > 50 * counts)
                base["base_failed"], base["kept"] = failed, ~failed
                if weights is not None:
                    p = 1 / (1 + np.exp(-np.clip(slope * _scores(texts[a:b], hashes, counts, weights, values) + shift, -40, 40)))
                    base["quality"], base["kept"] = p, ~failed & (p >= threshold)
                else:
                    base["quality"] = np.full(b - a, np.nan)
                for c in MADE:
                    columns[c].append(base[c])
            arrays = []
            for c in MADE:
                x = np.concatenate(columns[c]) if columns[c] else np.empty(0)
                kind = pa.bool_() if c in ("base_failed", "kept") else pa.float64() if c == "quality" else pa.int64()
                arrays.append(pa.array(x, from_pandas=True).cast(kind))
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("row"), *arrays], ["text", "row", *MADE])

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts to the cells they have and how often."""
    cache = Hashes(_SEED)
    for batch in batches:
        cells, times = [], []
        for text in batch.column("text").to_pylist():
            hashes, _ = word_hashes([text], cache)
            parts = [c for c, _ in part_features((text or b"").split())]
            all_cells = np.concatenate([word_features(hashes), *parts, pair_features(hashes)])
            own, n = np.unique(all_cells, return_counts=True)
            cells.append(own.astype(np.int32).tobytes())
            times.append(n.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(cells, pa.binary()), pa.array(times, pa.binary())], ["quality", "cells", "times"])


def fit(rows: list, steps: int = 60) -> tuple[np.ndarray, float, float] | None:
    """Weights, slope and shift from (quality, cells, times); None without both classes. Empties rows."""
    y = np.array([r["quality"] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(rows)) % 3 == 2

    def matrix(which: np.ndarray):
        chosen = [r for r, x in zip(rows, which, strict=True) if x]
        if not chosen:
            return np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.int32), y[which]
        cells = [np.frombuffer(r["cells"], np.int32) for r in chosen]
        times = [np.frombuffer(r["times"], np.int32) for r in chosen]
        sizes = np.array([len(c) for c in cells])
        share = np.concatenate([t / max(1, t.sum()) for t in times]).astype(np.float32)
        return np.concatenate(cells), share, np.repeat(np.arange(len(chosen), dtype=np.int32), sizes), y[which]

    def mean(data, w):
        return np.bincount(data[2], data[1] * w[data[0]].astype(np.float32), len(data[3]))

    train, held = matrix(~held), matrix(held)
    rows.clear()
    w = np.zeros(1 << BITS)
    m, v, bias = np.zeros_like(w), np.zeros_like(w), 0.0
    balance = np.where(train[3] > 0, 0.5 / max(train[3].mean(), 1e-6), 0.5 / max(1 - train[3].mean(), 1e-6))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(mean(train, w) + bias, -40, 40)))
        error = (p - train[3]) * balance / len(p)
        gradient = np.bincount(train[0], train[1] * error.astype(np.float32)[train[2]], 1 << BITS)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w -= 1.0 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        bias -= 2.0 * error.sum()
    held = held if len(set(held[3].tolist())) == 2 else train
    x, z = mean(held, w), held[3]
    # Platt: targets drawn in from 0 and 1 by the sizes of the classes
    up, down = (z > 0).sum(), (z == 0).sum()
    target = np.where(z > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, bias
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * x * x).sum() + 1e-6, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        g = np.array([((p - target) * x).sum(), (p - target).sum()])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return w, float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text"):
    """The model, from at most most_labelled rows of labels (doc_id, quality)."""
    chosen = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most_labelled)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    # at most most_labelled rows of two numbers
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    spec = "quality int, cells binary, times binary"
    found = rows.select("text", "quality").mapInArrow(_features, spec)
    bounded = found.orderBy(F.xxhash64("cells", "quality")).limit(most_labelled)  # repeated ids in docs
    return fit(bounded.collect())


def quality_rules(docs: DataFrame, labels: DataFrame, labelled_docs: DataFrame | None = None, text_col: str = "text", threshold: float = 0.5, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """docs with the base statistics, `quality` (calibrated probability) and `kept`; the labels' texts come from labelled_docs, or docs."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs if labelled_docs is None else labelled_docs, labels, most_labelled, text_col=text_col))
    rows = packed(docs, text_col)
    kinds = {"base_failed": T.BooleanType(), "kept": T.BooleanType(), "quality": T.DoubleType()}
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, kinds.get(c, T.LongType())) for c in MADE)])
    return unpacked(rows.mapInArrow(trimmed(_scored(model, threshold)), schema), docs, text_col, MADE)


def op6_quality_ngram_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, sf_dir, "labels")).select("doc_id", *BASE, "quality", "kept")
