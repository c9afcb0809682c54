"""Connected components of links held in a DataFrame, by alternating large-star and small-star steps.

Each step is a handful of shuffles, so links that are proved few, by a count, are joined by one task at once; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import materialize

#: Links, of 16 bytes each, that one task may join.
MOST_IN_ONE_TASK = 1_000_000


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many links as join the same nodes, each from a node to the smallest of its component."""
    if not len(x):
        return x, y
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if held:
        node, root = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        roots = np.unique(root)
        yield pa.RecordBatch.from_pydict({"node": pa.array(np.concatenate([node, roots])), "root": pa.array(np.concatenate([root, roots]))})


def components(edges: DataFrame, most_in_one_task: int = MOST_IN_ONE_TASK) -> DataFrame:
    """(node, root): for each node of the links (a, b), the smallest node of its component. Loops and repeats are allowed."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = materialize(edges, "links")
    stamp = _stamp(edges)
    if stamp[0] <= most_in_one_task:
        return edges.coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    while stamp[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(small, "small-star")
        before, stamp = stamp, _stamp(edges)
        if before == stamp:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
