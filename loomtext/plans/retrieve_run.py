"""The retrieval stage over files: for each record the best code of a corpus, without docstrings, with its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as t
from loomtext.operators import retrieval
from loomtext.sources import records

CORPUS = "code string, repo string, path string, func_name string, docstring string, docstring_tokens array<string>"
FIELDS = ["code", "repo", "path", "func_name", "language", "docstring", "summary", "idx"]


def corpus_rows(spark: SparkSession, path: str) -> DataFrame:
    """A JSON lines corpus with idx (lines from 0), code without docstrings, and summary: the docstring's tokens, or words, joined."""
    rows = records.dense_row_id(records.read_jsonl(spark, path, CORPUS), "idx")
    rows = rows.select("idx", "code", "docstring_tokens", *(F.coalesce(c, F.lit("")).alias(c) for c in ("repo", "path", "func_name", "docstring")), F.lit("python").alias("language"))
    return retrieval.clean_corpus(rows).withColumn("summary", t.join_tokens(F.col("docstring_tokens"), docstring=F.col("docstring")))


def retrieved(queries: DataFrame, corpus: DataFrame, k: int = 3) -> DataFrame:
    """queries, of which code becomes the query without docstrings, with retrieved_candidates."""
    asked = retrieval.query_text(records.dense_row_id(queries, "_q"))
    top = retrieval.bm25_top_k(asked.select("_q", "query"), corpus.select("idx", "code"), "_q", "query", "idx", "code", k)
    found = retrieval.candidate_structs(top, corpus, "_q", "idx", FIELDS).withColumn("retrieved_candidates", F.transform("retrieved_candidates", lambda c: c.dropFields("rank")))
    return asked.join(found, "_q", "left").withColumn("code", F.col("query")).drop("query", "_q")


def run(spark: SparkSession, corpus: str, queries: str, out: str, languages: list[str], k: int = 3) -> list[str]:
    """queries and out are paths with {lang}; languages without queries are skipped. Returns the paths written."""
    rows, written = corpus_rows(spark, corpus), []
    for lang in languages:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(queries.format(lang=lang))
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            retrieved(spark.read.json(queries.format(lang=lang)), rows, k).write.mode("overwrite").json(out.format(lang=lang))
            written.append(out.format(lang=lang))
    return written
