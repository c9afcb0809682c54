"""The stateless stages on streams: text functions and the cascade without ports are row-wise, so they run on a streaming DataFrame as
they do on a table; what needs the whole input (duplicates, sampling, BM25) runs on micro-batches' results or in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomtext.operators.cascade import reject_cascade


def judged_stream(stream: DataFrame, content: str = "content", lang: str = "code_lang") -> DataFrame:
    """reject_reason for each arriving row."""
    return reject_cascade(stream, None, content, lang)
