"""M2: texts as means of token vectors, cut to a number of tokens, and the similarity of two texts that the cascade's last layer asks for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.operators.dedup import bottom_k
from loomtext.operators.gated import BatchPort

# Tokens of a code and of a summary that an encoder sees.
MOST_CODE, MOST_SUMMARY = 512, 128
#: Vectors that may be broadcast.
MOST_BROADCAST = 100_000
#: Texts and the most tokens of each to the token vectors of each text (tokens x dimensions, at most that many tokens).
Encode = Callable[[list[str], int], list[np.ndarray]]


def mean_vector(vectors: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """The mean of the vectors, of those alone whose mask is 1 if there is one; NaN without any."""
    own = vectors if mask is None else vectors[np.asarray(mask, bool)]
    return own.mean(0) if len(own) else np.full(vectors.shape[1] if vectors.ndim == 2 else 1, np.nan)


def cosine(a: np.ndarray, b: np.ndarray) -> float | None:
    with np.errstate(invalid="ignore", divide="ignore"):
        found = float(a @ b / np.sqrt((a @ a) * (b @ b)))
    return None if np.isnan(found) else found


def similarity_port(factory: Callable[[], Encode], most_code: int = MOST_CODE, most_summary: int = MOST_SUMMARY, batch: int = 64) -> BatchPort:
    """The cascade's similarity from an encoder: cosine of the mean vectors of code and summary; null where the encoder raises or a text has no tokens."""

    def model():
        encode = factory()

        def similarity(codes: list[str], summaries: list[str]) -> list[float | None]:
            both = zip(encode(codes, most_code), encode(summaries, most_summary), strict=True)
            return [cosine(mean_vector(a[:most_code]), mean_vector(b[:most_summary])) if len(a) and len(b) else None for a, b in both]

        return similarity

    return BatchPort(model, ("code", "summary"), "double", batch, null_on_error=True)


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for at in range(batch.num_rows):
            own = batch.column("vectors")[at].values
            out.append(own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1).mean(0).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.float64()))], ["key", "mean"])


def mean_vectors(tokens: DataFrame, key: str, pos: str, vector: str, most: int) -> DataFrame:
    """(key, mean) of the first `most` token rows of each key by pos (unique there): no more rows than that meet, however long a text is."""
    rows = tokens.select(F.col(key).alias("key"), F.col(pos).alias("pos"), F.col(vector).cast("array<float>").alias("vector"))
    first = bottom_k(rows, ["key"], most, ["pos"]).groupBy("key").agg(F.collect_list("vector").alias("vectors"))
    return first.mapInArrow(_means, T.StructType([first.schema["key"], T.StructField("mean", T.ArrayType(T.DoubleType()))])).withColumnRenamed("key", key)


def mean_vectors_by_id(rows: DataFrame, key: str, ids: str, vectors: DataFrame, vector_id: str, vector: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(key, mean) of rows (key, unique; an array of ids, of which one may repeat): vectors meet ids where these are, and only sums leave a task.

    The vectors that occur are broadcast if there are at most most_broadcast of them; beyond that they are joined by shuffle. Keys without a vector have no row. rows are read twice.
    """
    each = rows.select(key, F.explode(ids).alias("_id"))
    have = vectors.select(F.col(vector_id).alias("_id"), F.col(vector).cast("array<double>").alias("_v")).join(each.select("_id").distinct(), "_id", "left_semi")
    told = have.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("width")).first()
    found = each.join(F.broadcast(have) if told["n"] <= most_broadcast else have, "_id")
    means = found.groupBy(key).agg(*(F.avg(F.get("_v", F.lit(d))).alias(f"_{d}") for d in range(told["width"] or 0)), F.count(F.lit(1)).alias("_n"))
    return means.select(key, F.array(*(F.col(f"_{d}") for d in range(told["width"] or 0))).cast("array<double>").alias("mean"))
