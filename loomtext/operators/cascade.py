"""The quality cascade: the first failing check names the one reason for which a row goes.

Checks in the JVM are one CASE expression. Checks that need a model are ports. A batch port works on the rows still open and lets the others pass, so all
steps are one chain over one scan, in which each model sees a row once. A port can also be a callable from a DataFrame to that DataFrame with one more
column, such as a join; rows are split before it, and it sees only those left. What comes before such a port is read again for the rows that it
doesn't see, unless `checkpoint` cuts the lineage there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomtext.functions import text as t
from loomtext.operators.gated import BatchPort

# Reasons, and the layer in which each rejects; a layer is counted as passed after its last check.
LAYERS = {
    "empty_content": 1, "no_docstring": 1, "first_sentence_failed": 1, "clean_failed": 1, "verify_failed": 1, "code_empty_code": 2,
    "code_too_short": 2, "code_too_long": 2, "code_test_function": 2, "code_stub_function": 2, "processing_error": 2,
    "identifier_repetition": 2, "license_copyright": 2, "bad_overlap": 3, "info_no_verb": 3, "info_type_declaration": 3,
    "info_question_or_todo": 3, "info_insufficient_content": 3, "grammar_errors": 3, "code_extraction_failed": 4,
    "bad_similarity": 4, "similarity_error": 4,
}


@dataclass
class Ports:
    """Models, each adding a column: has_verb boolean, grammar_issues int, similarity double (null: it failed)."""

    has_verb: BatchPort | Callable[[DataFrame], DataFrame] | None = None
    grammar_issues: BatchPort | Callable[[DataFrame], DataFrame] | None = None
    similarity: BatchPort | Callable[[DataFrame], DataFrame] | None = None


def _first(checks: list[tuple[Column, str]]) -> Column:
    cases = F.when(checks[0][0], checks[0][1])
    for failed, reason in checks[1:]:
        cases = cases.when(failed, reason)
    return cases


def licensed(summary: Column, fixed: bool = False) -> Column:
    """P10. `fixed` also looks for the names of licences, which lower-casing hides otherwise."""
    low = F.lower(summary)
    hit = low.contains("copyright") | low.contains("license") | low.contains("all rights reserved")
    return hit | summary.rlike("MIT License|GPL|Apache") if fixed else hit


def _code_shape(content: Column) -> Column:
    """struct: the number of lines with text, the first; the number of those that are no comment, the last."""
    lines = F.filter(F.split(content, "\n"), lambda x: t.trim(x) != "")
    plain = lambda ls: F.filter(ls, lambda x: ~t.trim(x).rlike(r"^(#|--|;;|\(\*)"))
    shape = lambda ls, ps: F.struct(F.size(ls).alias("n"), F.lower(F.get(ls, F.lit(0))).alias("first"), F.size(ps).alias("plain"), F.lower(F.get(ps, F.size(ps) - 1)).alias("last"))
    return t.bind(lines, lambda ls: t.bind(plain(ls), lambda ps: shape(ls, ps)))


def _code_checks(content: Column, shape: Column) -> list[tuple[Column, str]]:
    stub = (shape["plain"] <= 2) & (F.lower(content).contains("pass") | F.coalesce(shape["last"].contains("return"), F.lit(False)))
    return [
        (t.trim(content) == "", "code_empty_code"), (shape["n"] < 3, "code_too_short"), (shape["n"] > 150, "code_too_long"),
        (shape["first"].contains("test"), "code_test_function"), (stub, "code_stub_function"),
    ]


def information_checks(summary: Column) -> list[tuple[Column, str]]:
    """P13 to P15."""
    kept = F.filter(t.words(summary), lambda w: ~F.lower(w).isin(t.STOPWORDS))
    return [
        (summary.rlike(rf"(?Ud)^{t.WORD}+\s*->\s*{t.WORD}+$"), "info_type_declaration"),
        (summary.startswith("How to") | summary.startswith("TODO"), "info_question_or_todo"),
        (F.size(kept) < 2, "info_insufficient_content"),
    ]


def reject_cascade(df: DataFrame, ports: Ports | None = None, content: str = "content", lang: str = "code_lang", corrupt: str | None = None, checkpoint: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with summary, overlap, similarity (where ports give it), length in words and reject_reason (null: kept).

    P20: rows whose column `corrupt` isn't null, such as lines that didn't parse, go as processing errors.
    """
    ports = ports or Ports()
    c, lg = F.col(content), F.col(lang)
    df = df.withColumn("raw", t.raw_comment(c, lg)).withColumn("summary", t.clean_summary(F.col("raw"), lg)).withColumn("code", t.code_only(c, lg))
    s = F.col("summary")
    first = [
        *([(F.col(corrupt).isNotNull(), "processing_error")] if corrupt else []),
        (c.isNull() | (t.trim(c) == ""), "empty_content"),
        (F.coalesce("raw", F.lit("")) == "", "no_docstring"),
        (F.coalesce(t.first_sentence(F.col("raw")), F.lit("")) == "", "first_sentence_failed"),
        (s.isNull(), "clean_failed"),
        (~t.alnum(c).contains(t.alnum(s)), "verify_failed"),
        *_code_checks(c, F.col("_shape")),
        (t.has_blank_parameter(c), "processing_error"),
        (F.coalesce(t.identifier_ratio(s, c, lg) > 0.7, F.lit(True)), "identifier_repetition"),
        (licensed(s), "license_copyright"),
        (F.col("overlap") > 1, "bad_overlap"),
    ]
    after = [(F.coalesce("code", F.lit("")) == "", "code_extraction_failed")]
    near = [(F.col("similarity").isNull(), "similarity_error"), (~((F.col("similarity") > 0.4) & (F.col("similarity") < 0.9)), "bad_similarity")]
    steps: list[tuple[str | None, list]] = [(None, first)]
    steps += [("has_verb", [(~F.col("has_verb"), "info_no_verb")])] if ports.has_verb else []
    steps += [(None, information_checks(s))]
    steps += [("grammar_issues", [(F.col("grammar_issues") >= 1, "grammar_errors")])] if ports.grammar_issues else []
    steps += [(None, after)]
    steps += [("similarity", near)] if ports.similarity else []
    df = df.withColumn("overlap", t.token_overlap(s, c)).withColumn("length", F.size(t.words(s)))
    df = df.withColumn("similarity", F.lit(None).cast("double")).withColumn("_shape", _code_shape(c)).withColumn("reject_reason", F.lit(None).cast("string"))
    reason = F.col("reject_reason")
    out, checks = [], []
    for name, more in steps:
        if name is None:
            checks += more
            continue
        df, port = df.withColumn("reject_reason", F.coalesce(reason, _first(checks)) if checks else reason), getattr(ports, name)
        if isinstance(port, BatchPort):
            df = df.withColumn(name, port.column(reason.isNull()))
        else:
            df = checkpoint(df) if checkpoint else df
            out.append(df.filter(reason.isNotNull()))
            df = port(df.filter(reason.isNull()).drop("reject_reason")).withColumn("reject_reason", F.lit(None).cast("string"))
        checks = list(more)
    df = df.withColumn("reject_reason", F.coalesce(reason, _first(checks)))
    out = [x.drop("has_verb", "grammar_issues", "_shape") for x in [*out, df]]
    return reduce(lambda a, b: a.unionByName(b), out)


def survivors(judged: DataFrame, index: str = "index") -> DataFrame:
    """P21."""
    return judged.filter("reject_reason is null").select(index, "summary", "code", "overlap", "similarity", "length")


def layer_counts(judged: DataFrame) -> DataFrame:
    """A1: (layer, passed, percent): rows that passed each layer; percent is null without rows."""
    reached = F.lit(99)
    for reason, layer in LAYERS.items():
        reached = F.when(F.col("reject_reason") == reason, layer).otherwise(reached)
    counted = judged.select(reached.alias("fails"))
    one = counted.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("fails") > k).alias(f"l{k}") for k in range(1, 5)))
    rows = F.array(*(F.struct(F.lit(k).alias("layer"), F.col(f"l{k}").alias("passed")) for k in range(1, 5)))
    return one.select("total", F.inline(rows)).select("layer", "passed", F.try_divide(F.col("passed") * 100.0, F.col("total").cast("double")).alias("percent"))


def mean_length(kept: DataFrame) -> DataFrame:
    """A2: one row, the mean length of the summaries in words; null without rows."""
    return kept.agg(F.avg("length").alias("mean_length"))


def top_reasons(judged: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent reasons with their share of all rows."""
    counts = judged.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as there are reasons
    total = F.sum("n").over(W.partitionBy())
    shares = counts.withColumn("percent", F.try_divide(F.col("n") * 100.0, total.cast("double")))
    return shares.filter("reject_reason is not null").select("reject_reason", "n", "percent").orderBy(F.desc("n"), "reject_reason").limit(k)
