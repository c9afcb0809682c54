"""Bounded-space online packing of tokenized documents into sequences.

Each partition keeps `open_windows` windows. A document is cut into full sequences and a remainder; the remainder goes
into the open window that it fills best. When none has room, the fullest open window is emitted and a new one opened. At
the end of the partitions the windows still open, which hold little, are merged: shuffled to few tasks, concatenated and
cut anew, and the last tokens of a task are cut at powers of two, which take no padding.

A null text counts as empty: the end token alone. A very long text is many full sequences. Repeated rows, also of one
doc_id, are packed each for itself. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe
from loomtext.llm.common import materialize, table, trimmed

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split(" ")[0] for c in PIECE.split(", ")]
#: Sequences that a task may number; ids of the merged windows start at the second half of the number space.
_PER_TASK = 1 << 36
_MERGED = 1 << 61


def library_encoder(path: str) -> bpe.TextEncoder:
    """Texts to ids by the tokenizers library, each distinct piece of the pre-split encoded once."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    model = tokenizer.model
    byte_level = {b: ord(c) for c, b in bpe.byte_alphabet().items()}

    def encode(piece: str) -> bytes:
        # the piece is split already, so the library's model alone is asked
        return b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(piece.encode().decode("latin-1").translate(byte_level))])

    return bpe.TextEncoder(encode, bpe.load(path)["added"])


class _Open:
    """A window with room: its pieces as (doc_id, start, doc_tokens, ids)."""

    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces, self.used = [], 0

    def put(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.used += len(piece[3]) // 4


def _rows(sequences: list[tuple[int, list[tuple]]], left: bool) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in _NAMES]
    ids = []
    for sequence, pieces in sequences:
        offset = 0
        for doc, start, total, data in pieces:
            n = len(data) // 4
            for column, x in zip(columns, (doc, start, n, zlib.crc32(data), total, sequence, offset), strict=True):
                column.append(x)
            ids.append(bytes(data) if left else None)
            offset += n
    arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, [*_NAMES, "left_ids"])


def _packer(encoder: Callable[[], Callable[[str], bytes]], size: int, end: bytes, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        width = 4 * size
        sequence = TaskContext.get().partitionId() * _PER_TASK
        windows: list[_Open] = []
        for batch in batches:
            done = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview((encode(text) if text else b"") + end)
                total = len(ids) // 4
                whole = total // size * width
                for at in range(0, whole, width):
                    done.append((sequence, [(doc, at // 4, total, ids[at : at + width])]))
                    sequence += 1
                if whole == len(ids):
                    continue
                piece = (doc, whole // 4, total, bytes(ids[whole:]))
                n = total - whole // 4
                room = [w for w in windows if w.used + n <= size]
                if room:
                    best = max(room, key=lambda w: w.used)
                else:
                    if len(windows) >= open_windows:
                        fullest = max(windows, key=lambda w: w.used)
                        windows.remove(fullest)
                        done.append((sequence, fullest.pieces))
                        sequence += 1
                    windows.append(best := _Open())
                best.put(piece)
                if best.used == size:
                    windows.remove(best)
                    done.append((sequence, best.pieces))
                    sequence += 1
                if len(done) >= 4096:
                    yield _rows(done, False)
                    done = []
            yield _rows(done, False)
        yield _rows([(sequence + i, w.pieces) for i, w in enumerate(windows)], True)

    return run


def _merger(size: int):
    """Concatenate what was left over and cut it at `size`; the rest at powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = _MERGED + TaskContext.get().partitionId() * _PER_TASK
        pieces: list[tuple] = []
        used = 0

        def closed(limit: int) -> tuple[int, list[tuple]]:
            nonlocal pieces, used, sequence
            taken, n = [], 0
            while n < limit:
                doc, start, total, data = pieces[0]
                part = min(len(data) // 4, limit - n)
                taken.append((doc, start, total, data[: 4 * part]))
                n += part
                if 4 * part == len(data):
                    pieces.pop(0)
                else:
                    pieces[0] = (doc, start + part, total, data[4 * part :])
            used -= limit
            sequence += 1
            return sequence - 1, taken

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                pieces.append((row["doc_id"], row["start"], row["doc_tokens"], row["left_ids"]))
                used += row["length"]
                while used >= size:
                    done.append(closed(size))
            yield _rows(done, False)
        done = []
        while used:
            done.append(closed(1 << (used.bit_length() - 1)))
        yield _rows(done, False)

    return run


def pack_documents(
    docs: DataFrame,
    encoder: Callable[[], Callable[[str], bytes]],
    size: int = 1024,
    end_id: int = 0,
    open_windows: int = 64,
    windows_a_merge: int = 1 << 13,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece; pieces with one sequence_id fill a sequence of at most `size` ids, gapless from offset 0."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    end = int(end_id).to_bytes(4, "little")
    packed = materialize(source.mapInArrow(trimmed(_packer(encoder, size, end, open_windows)), f"{PIECE}, left_ids binary"), "packing")
    left = packed.filter(F.col("left_ids").isNotNull())
    n = left.select(F.countDistinct("sequence_id").alias("n")).first()["n"]
    tasks = max(1, -(-n // windows_a_merge))
    merged = left.repartitionByRange(tasks, "sequence_id", "offset") if tasks > 1 else left.coalesce(1)
    merged = merged.sortWithinPartitions("sequence_id", "offset").mapInArrow(_merger(size), f"{PIECE}, left_ids binary")
    return packed.filter(F.col("left_ids").isNull()).select(*_NAMES).unionAll(merged.select(*_NAMES))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, sf_dir, "documents"), lambda: library_encoder(path))
