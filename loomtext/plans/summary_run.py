"""From selected code to summaries: retrieval of shots, prompts, generation and cleaned answers, as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as t
from loomtext.operators import nested, retrieval
from loomtext.plans import ports, prompts


def with_shots(queries: DataFrame, corpus: DataFrame, query_key: str, query: str, key: str, code: str, fields: list[str], k: int = 3, pruned: bool = False) -> DataFrame:
    """queries with retrieved_candidates, the corpus' k best for each by rank (fields of the corpus and bm25_score); none for a query without any."""
    top = retrieval.bm25_top_k(queries.select(query_key, query), corpus.select(key, code), query_key, query, key, code, k, pruned)
    found = retrieval.candidate_structs(top.select(query_key, key, "score", "rank"), corpus, query_key, key, fields)
    none = F.array().cast(found.schema["retrieved_candidates"].dataType)
    return queries.join(found, query_key, "left").withColumn("retrieved_candidates", F.coalesce("retrieved_candidates", none))


def prompted(rows: DataFrame, code: str, trace: str, shot_code: str, shot_trace: str | None, shot_summary: str, layout: prompts.Layout, use_trace: bool = True, use_shots: bool = True) -> DataFrame:
    """rows with `prompt` for a completion model. A code without a trace takes its own first line; the switches leave out the trace or the shots."""
    first_line = F.substring_index(F.col(code), "\n", 1)
    lines = nested.snippet_fallback(F.col(trace), first_line)
    of = lambda c: c[shot_trace] if shot_trace else F.array(F.substring_index(c[shot_code], "\n", 1))
    shots = F.transform("retrieved_candidates", lambda c: F.struct(c[shot_code].alias("code"), of(c).alias("trace"), c[shot_summary].alias("summary")))
    return rows.withColumn("prompt", prompts.completion_prompt(F.col(code), lines, shots, layout, use_trace, use_shots))


def summarised(rows: DataFrame, key: str, factory: Callable[[], ports.Generate], temperature: float = 0.0) -> DataFrame:
    """(key, raw_output, summary): one generated text for each prompt, cleaned."""
    asked = rows.select(key, "prompt", F.lit(temperature).alias("temperature"), F.lit(1).alias("n"))
    return ports.generate(asked, "prompt", factory).select(key, "raw_output", t.summary_tail(F.col("raw_output")).alias("summary"))
