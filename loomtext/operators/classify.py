"""M4: statements of nested code records labelled by a classifier, in padded batches, the labels put back where the statements stand.

A record holds the main code's statements and, in an array of structs, those of candidates. All of a record's examples stay in its row: they are padded,
labelled and put back without flattening and joining.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators import nested

#: ids, word masks (batch x statements x words) and statement masks (batch x statements) to labels 0 or 1 (batch x statements).
Classify = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def tensors(examples: list[list[str]], encode: Callable[[str], list[int]], pad: int, most: int, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and masks of examples: the first `most` statements, of each the first `each` ids; line ends count as spaces."""
    ids = np.full((len(examples), most, each), pad, np.int64)
    words, statements = np.zeros(ids.shape, np.int64), np.zeros(ids.shape[:2], np.int64)
    for i, example in enumerate(examples):
        for j, statement in enumerate(example[:most]):
            own = encode(statement.replace("\n", " "))[:each]
            ids[i, j, : len(own)] = own
            words[i, j, : len(own)] = statements[i, j] = 1
            statements[i, j] = 1
    return ids, words, statements


def label_port(factory: Callable[[], tuple[Callable[[str], list[int]], Classify]], pad: int = 0, most: int = 32, each: int = 32, batch: int = 64):
    """A column function from an array of examples (arrays of statements) to labels of the first `most` statements of each. factory gives, once a task, the encoder and the classifier."""

    @F.pandas_udf("array<array<int>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, classify = factory()
        for part in parts:
            rows = [[[s or "" for s in example] for example in row] for row in part]
            examples = [example for row in rows for example in row]
            labels: list[list[int]] = []
            for start in range(0, len(examples), batch):
                some = examples[start : start + batch]
                found = np.asarray(classify(*tensors(some, encode, pad, most, each)))
                labels += [own[: len(example)].tolist() for own, example in zip(found, some, strict=True)]
            ends = np.cumsum([len(row) for row in rows])
            yield pd.Series([labels[end - len(row) : end] for row, end in zip(rows, ends, strict=True)], dtype=object)

    return run.asNondeterministic()  # worked out once


def classified(df: DataFrame, port, statements: str = "cleaned_seqs", candidates: str = "retrieved_candidates") -> DataFrame:
    """df with pred_labels and <statements>_pred, the statements labelled 1, for the main code and as fields of every candidate. Null statements or candidates count as none."""
    none = F.array().cast("array<string>")
    others = F.coalesce(candidates, F.array().cast(df.schema[candidates].dataType))
    main, of = F.coalesce(statements, none), lambda c: F.coalesce(c[statements], none)
    rows = df.withColumn("_labels", port(F.concat(F.array(main), F.transform(others, of))))
    picked = lambda seqs, labels: nested.masked_select(seqs, labels)
    with_labels: Callable[[Column, Column], Column] = lambda c, i: c.withField("pred_labels", F.get("_labels", i + 1)).withField(f"{statements}_pred", picked(of(c), F.get("_labels", i + 1)))
    first = F.get("_labels", F.lit(0))
    return rows.withColumn("pred_labels", first).withColumn(f"{statements}_pred", picked(main, first)).withColumn(candidates, F.transform(others, with_labels)).drop("_labels")
