"""The corpus pipeline: language, quality, near copies, repeated passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages but the
last return the columns of docs. Columns of docs never clash with those that an operator makes: they travel in a struct.
What a stage writes to the shared folder is read by its result, so it stays until run() has written that, or the application ends.

Null, empty and blank texts, and those without letters, go in the first stage. Documents with equal or null ids are rows of their own up to
near_dedup, where texts of one group leave the smallest id (nulls last; of equal ids one row). Ties: languages by name, see the operators.
Very long texts are worked on whole; an empty table passes all stages empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import language, packing, quality, simhash, substring
from loomtext.llm.common import materialize, release, scratch, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: A document stays if so much of it is in its language.
LEAST_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of docs; drops documents without letters and those without a main language."""
    model = language.train(docs)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    found = language.identify(docs.select("text", F.struct(*rest).alias("rest")), model)
    found = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return found.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of documents that got here; drops what the rules reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    found = quality.quality_rules(docs.select("text", F.struct(*rest).alias("rest")), labels, labelled_docs=docs).filter("kept")
    return found.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of copies and near copies."""
    return simhash.drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 35 words and more that occur elsewhere too; a text that loses nothing stays as it is. n_chars follows the text."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    found = substring.remove_repeats(docs.select("text", F.struct(*rest).alias("rest")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    return found.select(*(out.get(c, F.col(f"rest.`{c}`") if c != "text" else None).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, lambda: packing.library_encoder(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring", substring_stage),
    ("packing", packing_stage),
]

#: Learned models and packing have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. The result of each but the last is written to the shared folder, and what the stage left there goes."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        with scratch() as made:
            docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
            release(spark, made)
    return docs
