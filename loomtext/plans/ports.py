"""Model ports and the plans around them. A port is a factory of a batch function, called once per Python worker; no model is shipped.

Doubles in `Doubles` exist for tests and say so in their names; they stand for no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as t
from loomtext.operators import selection
from loomtext.operators.blocks import syntax_check

#: prompts, temperature, n -> n texts for each prompt.
Generate = Callable[[list[str], float, int], list[list[str]]]
# Fixed values: (temperature, number of candidates).
SCHEDULE = ((0.0, 1), (0.7, 3), (0.9, 3), (1.1, 3))
CANDIDATE = "struct<code string, temperature double, raw_output string, status string, error string, repaired boolean, attempt int, back_translation string, hybrid_score double>"


def scalar_port(factory: Callable[[], Callable[[list], list]], returns: str):
    """M2, M3, M5, M6, M7, M9: a column function from one column (texts, or structs) to another; the model is made once a worker."""

    @F.pandas_udf(returns)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for part in parts:
            yield pd.Series(model(part.tolist()))

    return run


def distinct_port(df: DataFrame, column: str, name: str, port) -> DataFrame:
    """Df with name = port(column), called once for each distinct value, longest first within a task."""
    once = df.select(column).distinct().filter(F.col(column).isNotNull()).sortWithinPartitions(F.desc(F.length(column)))
    return df.join(once.withColumn(name, port(F.col(column))), column, "left")


def generate(df: DataFrame, prompt: str, factory: Callable[[], Generate]) -> DataFrame:
    """M1: df (prompt, temperature, n, ...) to one row for each text: pos from 0 and raw_output."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("pos", T.IntegerType()), T.StructField("raw_output", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in parts:
            for (temperature, n), rows in part.groupby(["temperature", "n"], sort=False):
                texts = model(rows[prompt].tolist(), float(temperature), int(n))
                yield rows.assign(raw_output=texts, pos=[list(range(len(x))) for x in texts]).explode(["raw_output", "pos"]).dropna(subset=["pos"])

    return df.mapInPandas(run, schema)


def fan_out(df: DataFrame, schedule: tuple = SCHEDULE) -> DataFrame:
    """L1: one row for each temperature of the schedule, with n and the place of its first candidate."""
    firsts = [sum(n for _, n in schedule[:i]) for i in range(len(schedule))]
    steps = F.array(*(F.struct(F.lit(x).alias("temperature"), F.lit(n).alias("n"), F.lit(at).alias("first")) for (x, n), at in zip(schedule, firsts, strict=True)))
    return df.select("*", F.inline(steps))


def translate(df: DataFrame, key: str, prompt: Column, factory: Callable[[], Generate], schedule: tuple = SCHEDULE) -> DataFrame:
    """L1 and A4: df with translations (candidates in schedule order, judged by the parser), valid_count and status."""
    asked = fan_out(df.select(key, prompt.alias("prompt")), schedule)
    made = generate(asked, "prompt", factory).withColumn("code", t.extract_code(F.col("raw_output"))).withColumn("check", syntax_check(F.col("code")))
    fields = F.struct(
        (F.col("first") + F.col("pos")).alias("at"), "code", "temperature", "raw_output", F.when(F.col("check.valid"), "valid").otherwise("invalid").alias("status"),
        F.col("check.message").alias("error"), F.lit(False).alias("repaired"), F.lit(0).alias("attempt"),
        F.lit(None).cast("string").alias("back_translation"), F.lit(None).cast("double").alias("hybrid_score"),
    )
    nested = made.groupBy(key).agg(F.array_sort(F.collect_list(fields)).alias("_t"))
    bare = F.transform("_t", lambda c: c.dropFields("at").cast(CANDIDATE))
    rows = df.join(nested, key, "left").withColumn("translations", F.coalesce(bare, F.array().cast(f"array<{CANDIDATE}>"))).drop("_t")
    n, status = selection.candidate_status(F.col("translations"))
    return rows.withColumn("valid_count", n).withColumn("status", status)


def repair(df: DataFrame, key: str, prompt: Callable[[Column, Column], Column], factory: Callable[[], Generate], checkpoint: Callable[[DataFrame], DataFrame], rounds: int = 3, temperature: float = 0.2) -> DataFrame:
    """L2: up to `rounds` attempts on rows without a valid candidate, from the shortest invalid code; a success sets repaired_success, and valid_count stays.

    prompt(code, error) makes the prompt from a candidate's fields. checkpoint cuts the lineage so that no model runs twice.
    """
    df = checkpoint(df)
    done = df.filter("status <> 'all_failed'")
    left = df.filter("status = 'all_failed'")
    for attempt in range(1, rounds + 1):
        base = left.withColumn("_c", F.get(F.col("translations"), selection.shortest_invalid(F.col("translations"))))
        asked = base.filter("_c is not null").select(key, prompt(F.col("_c.code"), F.col("_c.error")).alias("prompt"), F.lit(temperature).alias("temperature"), F.lit(1).alias("n"))
        made = generate(asked, "prompt", factory).withColumn("code", t.extract_code(F.col("raw_output"))).withColumn("check", syntax_check(F.col("code")))
        new = F.struct(
            "code", "temperature", "raw_output", F.when(F.col("check.valid"), "valid").otherwise("invalid").alias("status"), F.col("check.message").alias("error"),
            F.lit(True).alias("repaired"), F.lit(attempt).alias("attempt"), F.lit(None).cast("string").alias("back_translation"), F.lit(None).cast("double").alias("hybrid_score"),
        ).cast(CANDIDATE)
        joined = left.join(made.select(key, new.alias("_n")), key, "left")
        joined = joined.withColumn("translations", F.when(F.col("_n").isNotNull(), F.array_append("translations", F.col("_n"))).otherwise(F.col("translations")))
        joined = checkpoint(joined.withColumn("status", F.when(F.col("_n.status") == "valid", "repaired_success").otherwise(F.col("status"))).drop("_n"))
        done = done.unionByName(joined.filter("status <> 'all_failed'"))
        left = joined.filter("status = 'all_failed'")
    return done.unionByName(left)


def _on_candidates(df: DataFrame, key: str, wanted: Callable[[Column], Column], prompt: Callable[[Column], Column], factory: Callable[[], Generate], extract: Callable[[Column], Column]) -> DataFrame:
    """back_translation of the wanted candidates from generated text, at its place; the others stay."""
    flat = df.select(key, F.posexplode("translations").alias("at", "c"))
    asked = flat.filter(wanted(F.col("c"))).select(key, "at", prompt(F.col("c.code")).alias("prompt"), F.lit(0.0).alias("temperature"), F.lit(1).alias("n"))
    made = generate(asked, "prompt", factory).select(key, "at", extract(F.col("raw_output")).alias("bt"))
    answers = made.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "bt"))).alias("_m"))
    filled = F.transform("translations", lambda c, i: c.withField("back_translation", F.coalesce(F.element_at("_m", i), c["back_translation"])))
    return df.join(answers, key, "left").withColumn("translations", F.when(F.col("_m").isNull(), F.col("translations")).otherwise(filled)).drop("_m")


def back_translate(df: DataFrame, key: str, prompt: Callable[[Column], Column], factory: Callable[[], Generate]) -> DataFrame:
    """L3."""
    return _on_candidates(df, key, selection.to_back_translate, prompt, factory, lambda x: t.extract_code(x, forward=False))


def refill(df: DataFrame, key: str, prompt: Callable[[Column], Column], factory: Callable[[], Generate]) -> DataFrame:
    """L4: holes alone; the raw text where no code is found."""
    return _on_candidates(df, key, selection.is_hole, prompt, factory, t.extract_code_permissive)


class Doubles:
    """Stand-ins for tests."""

    @staticmethod
    def echo_double() -> Generate:
        return lambda prompts, temperature, n: [[f"<PYTHON>x = {len(p)} + {i}</PYTHON>" for i in range(n)] for p in prompts]

    @staticmethod
    def broken_double() -> Generate:
        return lambda prompts, temperature, n: [["<PYTHON>def (</PYTHON>"] * n for _ in prompts]

    @staticmethod
    def length_vector_double() -> Callable[[list], list]:
        return lambda texts: [[float(len(x or "")), 1.0] for x in texts]
