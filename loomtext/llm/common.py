"""Helpers shared by the training-data operators: shared storage, packing of rows, words."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext import session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Within scratch(), where the paths made are noted; each thread has its own.
_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends or by release()."""
    path = session.shared_path(spark, name)
    if (made := _scratch.get()) is not None:
        made.append(path)
    return path


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """A list that the paths made inside are noted in."""
    made: list[str] = []
    token = _scratch.set(made)
    try:
        yield made
    finally:
        _scratch.reset(token)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete them, once no DataFrame that reads them is needed any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts the lineage there."""
    path, schema = shared_path(df.sparkSession, name), df.schema
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def packed(df: DataFrame, text_col: str) -> DataFrame:
    """(text binary, row struct): the text as UTF-8 bytes beside the other columns, whatever their names."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    row = F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("none"))
    return df.select(F.col(f"`{text_col}`").cast("binary").alias("text"), row.alias("row"))


def unpacked(df: DataFrame, like: DataFrame, text_col: str, made: list[str]) -> DataFrame:
    """Undo packed(); a column of the input with the name of a made column gives way to it."""
    out = []
    for c in like.columns:
        if c in made:
            continue
        out.append(F.col("text").cast("string").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c))
    return df.select(*out, *made)


#: Bytes of a batch's rows that are worked on at once.
PIECE_BYTES = 4 << 20


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Their rows in slices of about PIECE_BYTES; copies of a whole batch as Python objects would take several times its size."""
    for batch in batches:
        rows = max(1, batch.num_rows * PIECE_BYTES // max(PIECE_BYTES, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run over slices of batches, after which a worker gives the memory that it no longer uses back, as it lives on for later tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(_pieces(batches))
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)

    return whole


class Hashes(dict):
    """Word (bytes) to XXH64; forgets everything at `most` words, so memory is bounded."""

    def __init__(self, seed: int, most: int = 200_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value


def word_hashes(texts: list[bytes | None], cache: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ([^\\x20\\x09-\\x0D]+, as bytes.split() takes them) and the number of words of each text."""
    words: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = text.split() if text else []
        counts[i] = len(found)
        words += found
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), counts


def chunks(texts: list[bytes | None], most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most_bytes of text each (a longer text stands alone)."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > most_bytes:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 18), base, np.uint64)
        p[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(p)
    return have[:n]


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """For each i the polynomial hash modulo 2**64 of values[i:i+width] (empty if there are too few); base is odd."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n), out=sums[1:])
    inverse = pow(base, -1, 1 << 64)
    return (sums[width:] - sums[: n - width + 1]) * _powers(inverse, n - width + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngram_cells(words: list[str], n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells, of 2**bits, of the n-character parts of words between marks, and how many each word has."""
    text = "\x03\x02".join(words)
    codes = np.frombuffer(f"\x02{text}\x03".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) if words else np.empty(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    to_end = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    grams = rolling(codes + np.uint64(n << 32), n, 0xD6E8FEB86659FD93)
    cells = (mixed(grams[to_end[: len(grams)] >= n]) >> np.uint64(64 - bits)).astype(np.int64)
    return cells, np.maximum(sizes - n + 1, 0)


def sums_by_word(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of rows of values, of which each word has its count."""
    totals = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return totals[ends] - totals[ends - counts]


def merged_ranges(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of length n that is set in the union of the ranges [start, end)."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:n]) > 0
