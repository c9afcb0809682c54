"""Removal of word windows that occur more than once, with a count-min prefilter.

A window is `window` consecutive words; a word goes if any window over it also starts elsewhere, in the same text or another.

1. Sketch. Each window selects an anchor: the least hash of its eight-word shingles. Equal windows at two places select
   equal anchors at two places, so the number of places of an anchor is an upper bound of the number of its windows. Each
   partition counts its anchors in count-min rows and sends the cells it touched, by block; blocks are merged by adding.
   Selected places are about a fourteenth of the words, which keeps the sketch small.
2. Windows. A window whose anchor is estimated at two or more places is a candidate. Texts without candidates are done.
   The candidates' 128-bit hashes are grouped exactly (with partial sums before the shuffle, so a window of a great many
   places is no hot key). Those that occur once were overestimated: a row of the text and the position goes back, and
   every other candidate is removed. Nothing repeated is lost: the sketch never underestimates.

The merged sketch is a bit for each cell, "two or more". Up to `most_cells` cells a row it is broadcast. Beyond that the texts' anchors go to the
blocks of the sketch instead, in one shuffle of short rows: a block is copied to `SALTS` tasks and a text asks one of them, so an anchor that a third of all
texts have is spread; the anchors found repeated return to their text. Both ways find the same candidates.

Null texts have no words. Texts shorter than the window keep every word. Repeated rows and copies count as places of
their own: all of them lose the windows they share. A very long text is worked on whole, alone. An empty table gives an
empty result. Other columns are kept; those with the names of result columns give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import Hashes, chunks, materialize, merged_ranges, mixed, packed, rolling, table, trimmed, unpacked, word_hashes

MADE = ["n_words", "n_removed", "kept_text"]
SHINGLE = 8
ROWS = 2
BLOCK = 1 << 16
#: Tasks that answer for one block of a sketch that isn't broadcast.
SALTS = 16
_BASE, _BASE2, _BASE3 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
_SEED = 20


class _Words:
    """Words of a chunk of texts with the windows' anchors."""

    def __init__(self, texts: list[bytes | None], cache: Hashes, window: int):
        self.hashes, self.counts = word_hashes(texts, cache)
        n = len(self.hashes)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.n_windows = max(0, n - window + 1)
        to_end = np.repeat(self.ends, self.counts) - np.arange(n)  # words of the text from each word on
        self.valid = to_end[: self.n_windows] >= window
        self.shingle = min(SHINGLE, window)
        shingles = np.maximum(mixed(rolling(self.hashes, self.shingle, _BASE3)), np.uint64(1))
        width = window - self.shingle + 1
        least, have = shingles, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        self.anchor = np.where(self.valid, least[: self.n_windows], np.uint64(0))
        self.shingles, self.width = shingles, width

    def selected(self) -> np.ndarray:
        """The anchors, one for each place that any window selects."""
        w = self.width
        most = np.concatenate([np.zeros(w - 1, np.uint64), self.anchor, np.zeros(w - 1, np.uint64)])
        have = 1
        while have < w:
            step = min(have, w - have)
            most = np.maximum(most[: len(most) - step], most[step:])
            have += step
        return self.shingles[most[: len(self.shingles)] == self.shingles]


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each anchor in a count-min row of 2**bits cells."""
    return (anchors * np.uint64((_BASE, _BASE2)[row]) ^ (anchors >> np.uint64(29))) * np.uint64(_BASE3) >> np.uint64(64 - bits)


def _sketched(window: int, bits: int):
    """The cells that a partition's anchors touch: one place, or two and more, by row and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes(_SEED)
        found: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            anchors = np.concatenate(found) if found else np.empty(0, np.uint64)
            blocks, ones, more = [], [], []
            for row in range(ROWS):
                cells = (row << bits) + _cells(anchors, row, bits).astype(np.int64)
                cells, n = np.unique(cells, return_counts=True)
                block = cells // BLOCK
                starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(cells) else np.empty(0, np.int64)
                for a, b in zip(starts, np.append(starts, len(cells))[1:], strict=True):
                    low, many = (cells[a:b] % BLOCK).astype(np.uint16), n[a:b] > 1
                    blocks.append(int(block[a]))
                    ones.append(low[~many].tobytes())
                    more.append(low[many].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(ones, pa.binary()), pa.array(more, pa.binary())], ["block", "ones", "more"])

        size = 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                found.append(_Words(texts[a:b], cache, window).selected())
                size += len(found[-1])
            if size > 1_000_000:
                yield out()
                found, size = [], 0
        yield out()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block in; for each block, the bitmap of cells of two or more places."""
    at, counts = None, None

    def out() -> pa.RecordBatch:
        bitmap = np.packbits(counts > 1).tobytes()
        return pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int64()), "bitmap": pa.array([bitmap], pa.binary())})

    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != at:
                if at is not None:
                    yield out()
                at, counts = row["block"], np.zeros(BLOCK, np.uint8)
            ones = np.frombuffer(row["ones"], np.uint16)
            counts[ones] = np.minimum(counts[ones] + 1, 2)
            counts[np.frombuffer(row["more"], np.uint16)] = 2
    if at is not None:
        yield out()


def _hits(words: _Words, at: np.ndarray, window: int) -> list[bytes | None]:
    """For each text a bit for each of its windows that is in `at`, null if there is none."""
    hit = np.zeros(words.n_windows + window, bool)
    hit[at] = True
    some = np.add.reduceat(hit, np.minimum(words.starts, len(hit) - 1)) if len(hit) else np.zeros(len(words.starts))
    return [np.packbits(hit[start : start + n - window + 1]).tobytes() if n >= window and k else None for start, n, k in zip(words.starts.tolist(), words.counts.tolist(), some.tolist(), strict=True)]


def _candidates(window: int, bits: int, sketch):
    """Rows with `hit`: a bit for each window that is a candidate, null if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes(_SEED)
        flags = np.frombuffer(sketch.value, np.uint8).reshape(ROWS, -1)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            hits: list[bytes | None] = []
            for a, b in chunks(texts):
                words = _Words(texts[a:b], cache, window)
                at = np.flatnonzero(words.valid)
                for row in range(ROWS):
                    cells = _cells(words.anchor[at], row, bits).astype(np.int64)
                    at = at[flags[row, cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1 > 0]
                hits += _hits(words, at, window)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.binary())], [*batch.schema.names, "hit"])

    return run


ASKED = "block long, salt int, bitmap binary, cell int, rid long, anchor long"


def _asked(window: int, bits: int):
    """What texts (text, rid) ask of the sketch: a row for each of their anchors and row of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes(_SEED)
        for batch in batches:
            texts, rids = batch.column("text").to_pylist(), batch.column("rid").to_numpy()
            for a, b in chunks(texts):
                words = _Words(texts[a:b], cache, window)
                text = np.repeat(np.arange(b - a), words.counts)[: words.n_windows]
                pairs = np.unique(np.rec.fromarrays([text[words.valid], words.anchor[words.valid]], names="text,anchor"))
                rid, anchor = rids[a:b][pairs.text], pairs.anchor
                for row in range(ROWS):
                    cells = (row << bits) + _cells(anchor, row, bits).astype(np.int64)
                    columns = [pa.array(cells // BLOCK), pa.array((rid % SALTS).astype(np.int32)), pa.nulls(len(rid), pa.binary()), pa.array((cells % BLOCK).astype(np.int32)), pa.array(rid), pa.array(anchor.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in ASKED.split(", ")])

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ASKED rows by block and salt, the block's bitmap first: (rid, anchor) of those whose cell has its bit; a block that no anchor touched twice may have none."""
    at, flags = None, None
    for batch in batches:
        block = batch.column("block").to_numpy() * SALTS + batch.column("salt").to_numpy()
        cell, rid, anchor = (batch.column(c) for c in ("cell", "rid", "anchor"))
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
        for a, b in zip(starts, np.append(starts, len(block))[1:], strict=True):
            if block[a] != at:
                at, flags = block[a], None
            if (bitmap := batch.column("bitmap")[int(a)].as_py()) is not None:
                flags = np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool)
                a += 1
            if flags is not None and b > a:
                own = pa.array(flags[cell.slice(a, b - a).to_numpy()])
                yield pa.RecordBatch.from_pydict({"rid": rid.slice(a, b - a).filter(own), "anchor": anchor.slice(a, b - a).filter(own)})


def _marked(window: int):
    """Rows with `hit` from the anchors that were found repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes(_SEED)
        for batch in batches:
            hits: list[bytes | None] = []
            for text, anchors in zip(batch.column("text").to_pylist(), batch.column("anchors"), strict=True):
                own = anchors.as_py()
                words = _Words([text if own else None], cache, window)
                hits += _hits(words, np.flatnonzero(words.valid & np.isin(words.anchor, np.array(own or [], np.int64).view(np.uint64))), window)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("text", "row", "rid")), pa.array(hits, pa.binary())], ["text", "row", "rid", "hit"])

    return run


def _grouped(window: int):
    """Candidates' hashes: (h1, h2, rid, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes(_SEED)
        for batch in batches:
            texts, hits, rids = (batch.column(c).to_pylist() for c in ("text", "hit", "rid"))
            for a, b in chunks(texts):
                hashes, counts = word_hashes(texts[a:b], cache)
                one, two = rolling(hashes, window, _BASE), rolling(mixed(hashes), window, _BASE2)
                starts = np.cumsum(counts) - counts
                where, rid, pos = [], [], []
                for i, start in enumerate(starts.tolist()):
                    if hits[a + i] is not None:
                        p = np.flatnonzero(np.unpackbits(np.frombuffer(hits[a + i], np.uint8), count=int(counts[i]) - window + 1))
                        where.append(p + start)
                        pos.append(p)
                        rid.append(np.full(len(p), rids[a + i], np.int64))
                if where:
                    at = np.concatenate(where)
                    yield pa.RecordBatch.from_pydict({"h1": pa.array(one[at].view(np.int64)), "h2": pa.array(two[at].view(np.int64)), "rid": pa.array(np.concatenate(rid)), "pos": pa.array(np.concatenate(pos).astype(np.int32))})

    return run


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            singles = batch.column("single").to_pylist()
            for text, hit, single in zip(batch.column("text").to_pylist(), batch.column("hit").to_pylist(), singles, strict=True):
                words = text.split() if text else []
                total.append(len(words))
                if hit is None:
                    gone.append(0)
                    kept.append(b" ".join(words))
                    continue
                at = np.unpackbits(np.frombuffer(hit, np.uint8), count=len(words) - window + 1)
                if single:
                    at[np.array(single)] = 0
                at = np.flatnonzero(at)
                out = merged_ranges(at, at + window, len(words))
                gone.append(int(out.sum()))
                kept.append(b" ".join([w for w, x in zip(words, out.tolist(), strict=True) if not x]) if len(at) else b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("row"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["text", "row", *MADE])

    return run


def _sketch_bits(docs: DataFrame, text_col: str) -> int:
    """The bits of a row's cells, for about four cells an anchor."""
    n = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("binary")))).first()[0] or 0
    return max(16, (4 * n // 80).bit_length())  # an anchor for every 80 bytes or more


def _by_broadcast(source: DataFrame, merged: DataFrame, window: int, bits: int, schema: T.StructType) -> DataFrame:
    flags = np.zeros((ROWS << bits) // 8, np.uint8)  # one bit a cell
    for row in merged.toLocalIterator():
        at = row["block"] * BLOCK // 8
        flags[at : at + BLOCK // 8] = np.frombuffer(row["bitmap"], np.uint8)
    sketch = source.sparkSession.sparkContext.broadcast(flags.tobytes())
    return source.mapInArrow(trimmed(_candidates(window, bits, sketch)), schema)


def _by_shuffle(source: DataFrame, merged: DataFrame, window: int, bits: int, schema: T.StructType) -> DataFrame:
    source = materialize(source, "numbered")  # rid has to stay
    none = lambda kind: F.lit(None).cast(kind)
    copies = merged.select("block", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "bitmap", none("int").alias("cell"), none("long").alias("rid"), none("long").alias("anchor"))
    asked = source.select("text", "rid").mapInArrow(trimmed(_asked(window, bits)), ASKED)
    told = copies.unionAll(asked).repartition("block", "salt").sortWithinPartitions("block", "salt", F.col("bitmap").isNull()).mapInArrow(_answered, "rid long, anchor long")
    repeated = told.groupBy("rid", "anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == ROWS)
    anchors = repeated.groupBy("rid").agg(F.collect_list("anchor").alias("anchors"))  # of one text
    return source.join(anchors, "rid", "left").select("text", "row", "rid", "anchors").mapInArrow(trimmed(_marked(window)), schema)


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = 35, most_cells: int = 1 << 28) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the words that stay, joined by one space)."""
    bits = _sketch_bits(docs, text_col)
    text = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"))
    touched = text.mapInArrow(trimmed(_sketched(window, bits)), "block long, ones binary, more binary")
    merged = materialize(touched.repartition("block").sortWithinPartitions("block").mapInArrow(_merged, "block long, bitmap binary"), "sketch")

    source = packed(docs, text_col).withColumn("rid", F.monotonically_increasing_id())
    schema = T.StructType([*source.schema.fields, T.StructField("hit", T.BinaryType())])
    find = _by_broadcast if 1 << bits <= most_cells else _by_shuffle
    source = materialize(find(source, merged, window, bits, schema), "candidates")
    hit = source.filter(F.col("hit").isNotNull())
    places = hit.select("text", "hit", "rid").mapInArrow(trimmed(_grouped(window)), "h1 long, h2 long, rid long, pos int")
    once = places.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid"), F.min("pos").alias("pos")).filter("n = 1")
    single = once.groupBy("rid").agg(F.collect_list("pos").alias("single"))
    shared = hit.join(single, "rid", "left").select("text", "row", "hit", "single")
    alone = source.filter(F.col("hit").isNull()).select("text", "row", "hit", F.lit(None).cast("array<int>").alias("single"))
    schema = T.StructType([source.schema["text"], source.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    done = alone.unionAll(shared).mapInArrow(trimmed(_removed(window)), schema)
    return unpacked(done, docs, text_col, MADE)


def op10_substring_countmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
