"""Vector code compression: product quantization in whole numbers, nearest entries found by annular norm pruning.

Vectors become whole numbers, floor(SCALE * x), and are cut into PARTS equal parts. A part position's codebook starts from the vectors with the smallest ids; each round
assigns every part to its nearest entry and replaces each entry by the floored mean of its parts.

Nearest entries: the entries of a position are sorted by norm. A part starts with the entry whose norm is next to its own; an entry nearer than distance d must have a norm within d
of the part's, so a binary search gives the only interval of entries that are left, ends included. The few entries of it next to the part's norm are evaluated, which
shortens d, then a second search gives the annulus that is evaluated exactly, in whole numbers; of equal distances the lower index wins. Bounds are
widened by more than a rounding error, which adds entries to evaluate and loses none.

A round is one pass in which each task adds up its parts, at most entries x dimensions rows of sums; those are added by Spark, and the codebooks, of as many
numbers, are all that the driver holds. Assigned codes are written once, before errors are added up by label.

Rows whose vector is null or holds null or non-finite components are dropped. The length of vectors is that of the smallest id's; it must divide into the parts. Rows of another length
have no distance to any entry: they stay, with null code and error, and add nothing to label errors. Repeated rows count each for itself; null ids come last, and of equal ids the lesser vector
comes first. With fewer rows than entries a codebook has as many entries as rows. Null labels are one label. An empty table gives an empty result. Components whose squared distances could exceed a
64-bit number (beyond about 2^24 for 64 entries of up to 64 numbers) raise an error. Other columns are kept; those with names of result columns give way.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import materialize, table, trimmed

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Labels whose sums may be broadcast.
MOST_BROADCAST = 200_000
#: Entries on each side of the part's own norm that are evaluated before the second search.
NEXT = 2
MADE = ["code", "error", "label_error", "codebooks_sha256"]


class Codebook:
    """Entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(1)
        self.index = np.argsort(squares, kind="stable")
        self.entries, self.norms = entries[self.index], np.sqrt(squares[self.index].astype(np.float64))
        self.evaluated = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each part the index of its nearest entry and the squared distance."""
        norms = np.sqrt((parts * parts).sum(1).astype(np.float64))
        at = np.searchsorted(self.norms, norms)
        at -= (at == len(self.norms)) | ((at > 0) & (norms - self.norms[at - 1] < self.norms[np.minimum(at, len(self.norms) - 1)] - norms))
        best = self._least(parts, at, at + 1)
        low, high = self._annulus(norms, best)
        best = np.minimum(best, self._least(parts, np.maximum(low, at - NEXT), np.minimum(high, at + NEXT + 1)))
        low, high = self._annulus(norms, best)
        best = self._least(parts, low, high)
        return best % len(self.norms), best // len(self.norms)

    def _annulus(self, norms: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of entries whose norm differs from the part's by no more than the distance so far."""
        far = np.sqrt((best // len(self.norms)).astype(np.float64))
        slack = 1e-9 * (1 + norms + far)
        return np.searchsorted(self.norms, norms - far - slack), np.searchsorted(self.norms, norms + far + slack, "right")

    def _least(self, parts: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of the entries [low, high) of each part, none empty, the least of squared distance x number of entries + index."""
        sizes = high - low
        starts = np.cumsum(sizes) - sizes
        entry = np.arange(int(sizes.sum())) + np.repeat(low - starts, sizes)
        self.evaluated += len(entry)
        apart = np.repeat(parts, sizes, axis=0) - self.entries[entry]
        return np.minimum.reduceat((apart * apart).sum(1) * len(self.norms) + self.index[entry], starts)


class Quantizer:
    """Codebooks of all part positions: an array of position x entry x place."""

    def __init__(self, codebooks: np.ndarray):
        self.books = [Codebook(entries) for entries in codebooks]
        parts, entries, width = codebooks.shape
        self.dimensions, self.rows = parts * width, max(1, (1 << 20) // max(1, entries * width))
        self.most = math.isqrt(((1 << 62) // max(1, entries * width)) // 4)
        if codebooks.size and np.abs(codebooks).max() > self.most:
            raise OverflowError(f"components of entries beyond {self.most} have distances beyond 64 bits")

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (vectors x positions) and errors of vectors, some rows at a time."""
        if vectors.size and max(vectors.max(), -vectors.min()) > self.most:
            raise OverflowError(f"components of vectors beyond {self.most} have distances beyond 64 bits")
        codes, errors = np.empty((len(vectors), len(self.books)), np.int64), np.zeros(len(vectors), np.int64)
        for start in range(0, len(vectors), self.rows):
            some = vectors[start : start + self.rows].reshape(-1, len(self.books), self.dimensions // len(self.books))
            for p, book in enumerate(self.books):
                codes[start : start + self.rows, p], distances = book.nearest(some[:, p])
                errors[start : start + self.rows] += distances
        return codes, errors


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """The valid rows, all of one length."""
    return column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions) if column.null_count < len(column) else np.empty((0, dimensions), np.int64)


def _sums(codebooks: np.ndarray):
    """What a task's parts add to each entry: rows of (part, entry, place, n, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantizer, (parts, entries, width) = Quantizer(codebooks), codebooks.shape
        n, totals = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column("numbers"), parts * width)
            codes, _ = quantizer.assign(vectors)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(totals[p], codes[:, p], vectors[:, p * width : (p + 1) * width])
        used = np.repeat(n.reshape(-1) > 0, width)
        columns = [x.reshape(-1)[used] for x in (*np.indices((parts, entries, width)), np.repeat(n.reshape(-1), width), totals)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["part", "entry", "place", "n", "total"])

    return run


def _codes(codebooks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantizer, (parts, _, width) = Quantizer(codebooks), codebooks.shape
        for batch in batches:
            numbers = batch.column("numbers")
            codes, errors = quantizer.assign(_matrix(numbers, parts * width))
            valid = iter(zip([bytes(row).hex() for row in codes.astype(np.uint8)], errors.tolist(), strict=True))
            both = [next(valid) if ok else (None, None) for ok in numbers.is_valid().to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([x[0] for x in both], pa.string()), pa.array([x[1] for x in both], pa.int64())], ["row", "code", "error"])

    return run


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or a component isn't finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def codebooks_of(numbers: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after so many rounds over the column `numbers`, whose null rows have no parts."""
    codebooks = first.copy()
    for _ in range(rounds):
        found = numbers.select("numbers").mapInArrow(trimmed(_sums(codebooks)), "part long, entry long, place long, n long, total long")
        for r in found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # at most entries x dimensions
            codebooks[r.part, r.entry, r.place] = r.total // r.n
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def quantize(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """vectors, without the vector column, with MADE."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part")
    rest = [F.col(f"`{c}`") for c in vectors.columns if c != vector_col and c not in MADE]
    rows = vectors.select(whole_numbers(F.col(f"`{vector_col}`"), scale).alias("numbers"), F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.struct(*rest).alias("rest")).alias("row")).filter("numbers is not null")
    ids = rows.orderBy(F.asc_nulls_last("row.id"), "numbers")
    smallest = ids.select("numbers").limit(1).collect()
    dimensions = len(smallest[0].numbers) if smallest else 0
    if dimensions % parts:
        raise ValueError(f"vectors of {dimensions} components can't be cut into {parts} equal parts")
    rows = rows.withColumn("numbers", F.when(F.size("numbers") == dimensions, F.col("numbers")))
    start = [r.numbers for r in rows.filter("numbers is not null").orderBy(F.asc_nulls_last("row.id"), "numbers").select("numbers").limit(entries).collect()]
    first = np.array(start, np.int64).reshape(len(start), parts, dimensions // parts).transpose(1, 0, 2)
    codebooks = codebooks_of(rows, first, rounds)
    schema = T.StructType([rows.schema["row"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = materialize(rows.mapInArrow(trimmed(_codes(codebooks)), schema), "codes")
    sums = materialize(coded.groupBy(F.col("row.label").alias("by")).agg(F.sum("error").alias("label_error")), "label-errors")
    small = sums.count() <= most_broadcast
    found = coded.join(F.broadcast(sums) if small else sums, F.col("row.label").eqNullSafe(F.col("by")))
    kept = [F.col(f"row.rest.`{c}`").alias(c) for c in vectors.columns if c != vector_col and c not in MADE]
    return found.select(*kept, "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def op13_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select("vec_id", *MADE)


def _round_sql(at: int) -> str:
    return f"""
a{at} as (select rid, p.part, min({{'d': list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c[k]) * (x[k] - c[k]))), 'e': entry}}) as m from parts p join c{at} using (part) group by all)"""


OP13_SQL = (
    """
with kept as (select vec_id, label, row_number() over (order by vec_id) as rid, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select rid, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] as x from kept, range(16) t(part)),
c0 as (select part, rid - 1 as entry, x as c from parts where rid <= 64),"""
    + "".join(
        _round_sql(at)
        + f""",
m{at} as (select part, entry, list(cast(floor(total / n) as bigint) order by k) as c from (
    select part, entry, k, sum(x[k]) as total, count(*) as n from (select p.part, m.e as entry, x, unnest(range(1, len(x) + 1)) as k from parts p join a{at} using (rid, part)) group by all) group by all),
c{at + 1} as (select part, entry, coalesce(m{at}.c, c{at}.c) as c from c{at} left join m{at} using (part, entry)),"""
        for at in range(ROUNDS)
    )
    + _round_sql(ROUNDS)
    + f""",
coded as (select vec_id, label, string_agg(format('{{:02x}}', m.e), '' order by part) as code, cast(sum(m.d) as bigint) as error from kept join a{ROUNDS} using (rid) group by rid, vec_id, label),
books as (select sha256(string_agg(x, ',' order by part, entry, k)) as codebooks_sha256 from (select part, entry, unnest(range(1, len(c) + 1)) as k, cast(unnest(c) as varchar) as x from c{ROUNDS}))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded, books
"""
)
