"""Language identification by mixtures: EM over the words of a document, with a penalised choice of the language set.

Training counts, over all rows given, the letter trigrams of each language's words, in hashed cells. A word's likelihood in
a language is the product of its trigrams' smoothed frequencies. A document's proportions of languages come from
expectation-maximisation over its words. Sets of languages are compared by log-likelihood less a penalty of
`penalty * log(n words)` for each language beyond the first: the single best one, and then the leading 2, 3, ... of the mixture
of all. The prediction is the largest share in the chosen set, the score that share.

A text that is null or without a letter, or any text if nothing was learned, is `und` with score 0. Ties go to the
language first in order. Repeated rows get equal results. A very long text is worked on whole. Null languages teach nothing. An
empty table gives an empty result. Other columns are kept; those named like result columns give way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.bpe import _ranges
from loomtext.llm.common import chunks, ngram_cells, packed, sums_by_word, table, trimmed, unpacked

MADE = ["lang_pred", "score"]
BITS = 16
CELLS = 1 << BITS
ROUNDS = 12


def letter_words() -> re.Pattern:
    return re.compile(f"[{_ranges('L')[0]}]+")


def letters(text: str, any_letter: re.Pattern, ascii_letter: re.Pattern = re.compile("[a-z]+")) -> list[str]:
    """The runs of letters of a text, lower-cased; a text of ASCII characters takes the smaller class."""
    text = text.lower()
    return (ascii_letter if text.isascii() else any_letter).findall(text)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pattern = letter_words()
    totals: dict[str, np.ndarray] = {}
    words: dict[str, Counter] = {}

    def settle(lang: str) -> None:
        total = totals.setdefault(lang, np.zeros(CELLS, np.int64))
        found = words.pop(lang)
        cells, counts = ngram_cells(list(found), 3, BITS)
        times = np.repeat(np.fromiter(found.values(), np.int64, len(found)), counts)
        total += np.bincount(cells, times, CELLS).astype(np.int64)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                words.setdefault(lang, Counter()).update(letters(text.decode(), pattern))
        for lang in [x for x, c in words.items() if len(c) > 50_000]:
            settle(lang)
    for lang in list(words):
        settle(lang)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "cell": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log frequencies: cells x languages); bounded by the number of languages times CELLS."""
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text")).filter("lang is not null")
    counts = rows.mapInArrow(trimmed(_counted), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    n = np.zeros((CELLS, len(languages)))
    if languages:
        n[counts["cell"].to_numpy(np.int64), np.searchsorted(languages, counts["lang"].to_numpy(str))] = counts["n"]
    return languages, np.log((n + 0.1) / (n.sum(axis=0) + 0.1 * CELLS)).astype(np.float32)


class _Words(dict):
    """Word to its row in a table of log-likelihoods by language."""

    def __init__(self, model: np.ndarray, most: int = 200_000):
        super().__init__()
        self.model, self.rows, self.most = model, np.empty((0, model.shape[1]), np.float32), most

    def learn(self, words: list[str]) -> None:
        """Add the words that are new, all at once; forgets the others first when it gets large."""
        new = set(words).difference(self)
        if len(self) + len(new) > self.most:
            self.clear()
            self.rows = self.rows[:0]
            new = set(words)
        new = list(new)
        cells, counts = ngram_cells(new, 3, BITS)
        self.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, sums_by_word(self.model[cells], counts).astype(np.float32)])


def _mixture(likelihood: np.ndarray, starts: np.ndarray, counts: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for each document over its rows of scaled likelihoods, in the languages that use (documents x languages) allows: (shares, log-likelihood)."""
    share = use / use.sum(axis=1, keepdims=True)
    doc = np.repeat(np.arange(len(counts)), counts)
    for _ in range(ROUNDS):
        joint = likelihood * share[doc]
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
        share = np.add.reduceat(joint, starts, axis=0) / counts[:, None]
    total = np.log(np.maximum((likelihood * share[doc]).sum(axis=1), 1e-30))
    return share, np.add.reduceat(total.astype(np.float64), starts)


def predict(ids: np.ndarray, counts: np.ndarray, logs: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(language index, score) of documents of counts (all positive) words, whose rows of logs are ids."""
    own = logs[ids]
    starts = np.cumsum(counts) - counts
    top = own.max(axis=1)
    alone = np.add.reduceat(own.astype(np.float64), starts, axis=0)
    ceiling = np.add.reduceat(top.astype(np.float64), starts)
    best = alone.argmax(axis=1)
    gain_needed = penalty * np.log(counts + 1.0)
    base = alone.max(axis=1)
    score = np.ones(len(counts))
    # no mixture can gain more than the best language of each word
    open_ = np.flatnonzero(ceiling - base > gain_needed)
    if len(open_) and logs.shape[1] > 1:
        rows = np.concatenate([np.arange(starts[d], starts[d] + counts[d]) for d in open_])
        n = counts[open_]
        first = np.cumsum(n) - n
        scaled = np.exp(own[rows] - top[rows][:, None])
        shares, value = _mixture(scaled, first, n, np.ones((len(open_), logs.shape[1]), np.float32))
        order = np.argsort(-shares, axis=1, kind="stable")
        found = base[open_] - ceiling[open_]
        win, part = best[open_], np.ones(len(open_))
        for k in range(2, logs.shape[1] + 1):
            may = np.flatnonzero(value - (k - 1) * gain_needed[open_] > found)
            if not len(may):
                break
            use = np.zeros((len(may), logs.shape[1]), np.float32)
            np.put_along_axis(use, order[may][:, :k], 1, axis=1)
            pick = np.concatenate([np.arange(first[d], first[d] + n[d]) for d in may])
            s, v = _mixture(scaled[pick], np.cumsum(n[may]) - n[may], n[may], use)
            v = v - (k - 1) * gain_needed[open_][may]
            better = v > found[may]
            at = may[better]
            found[at], win[at], part[at] = v[better], s[better].argmax(axis=1), s[better].max(axis=1)
        best[open_], score[open_] = win, part
    return best, score


def _predicted(model, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table_ = model.value
        pattern, words = letter_words(), _Words(table_) if languages else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names: list[str] = ["und"] * len(texts)
            scores = np.zeros(len(texts))
            for a, b in chunks(texts) if languages else ():
                found = [letters(t.decode(), pattern) if t else [] for t in texts[a:b]]
                counts = np.array([len(x) for x in found])
                full = np.flatnonzero(counts)
                if not len(full):
                    continue
                flat = [w for x in found for w in x]
                words.learn(flat)
                ids = np.fromiter(map(words.__getitem__, flat), np.int64, len(flat))
                best, score = predict(ids, counts[full], words.rows, penalty)
                for d, lang, s in zip(full.tolist(), best.tolist(), score.tolist(), strict=True):
                    names[a + d], scores[a + d] = languages[lang], min(1.0, s)
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("row"), pa.array(names, pa.string()), pa.array(scores)], ["text", "row", *MADE])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", penalty: float = 2.0) -> DataFrame:
    """docs with lang_pred and score; model as train() gives it."""
    rows = packed(docs, text_col)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return unpacked(rows.mapInArrow(trimmed(_predicted(shared, penalty)), schema), docs, text_col, MADE)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang").filter(~F.coalesce(held_out(), F.lit(False))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
