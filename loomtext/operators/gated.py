"""Models inside a cascade: an Arrow batch function that works on the rows still open and leaves the others as they are.

The rows aren't split before a model, so a plan with several models reads its input once and stays one chain. The column that a model
adds is marked as not to be worked out twice: Spark then neither moves filters below it nor copies it into several expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BatchPort:
    """A model over columns. factory makes, at the first open row of a task, a function of as many lists as there are inputs to a list of results.

    It gets at most `batch` rows at once, the longest first among the rows of an Arrow batch, so those that go together are of like length.
    Where null_on_error is set, a batch that raises is asked again row by row, and rows that raise get null; else the error ends the job.
    """

    factory: Callable[[], Callable[..., list]]
    inputs: tuple[str, ...]
    returns: str
    batch: int = 64
    null_on_error: bool = False

    def column(self, is_open: Column) -> Column:
        """The model's results where is_open holds, else null; inputs of other rows aren't sent to Python."""

        @F.pandas_udf(self.returns)
        def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            model = None
            for marks, *inputs in parts:
                out = np.full(len(marks), None, object)
                at = np.flatnonzero(marks.fillna(False).to_numpy(bool))
                if len(at):
                    model = model or self.factory()
                    sizes = np.array([sum(len(x.iloc[i]) if isinstance(x.iloc[i], str) else 0 for x in inputs) for i in at])
                    at = at[np.argsort(-sizes, kind="stable")]
                for start in range(0, len(at), self.batch):
                    some = at[start : start + self.batch]
                    for i, result in zip(some, self._asked(model, [[x.iloc[i] for i in some] for x in inputs]), strict=True):
                        out[i] = result
                yield pd.Series(out, dtype=object)

        sent = [F.when(is_open, F.col(c)) for c in self.inputs]
        return run.asNondeterministic()(is_open, *sent)

    def _asked(self, model: Callable[..., list], inputs: list[list]) -> list:
        try:
            return model(*inputs)
        except Exception:
            if not self.null_on_error:
                raise
            if len(inputs[0]) == 1:
                return [None]
            return [y for row in zip(*inputs, strict=True) for y in self._asked(model, [[x] for x in row])]
