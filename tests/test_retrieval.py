"""Pruned search against scoring everything, and the rows that fill up a ranking."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext import catalog
from loomtext.functions import text as t
from loomtext.operators import retrieval

DIR = "/root/testdata/sf0.01"


def frames(spark, docs, queries):
    return spark.createDataFrame(queries, "q long, x string"), spark.createDataFrame(docs, "id long, y string")


def top(queries, docs, k, pruned):
    found = retrieval.bm25_top_k(queries, docs, "q", "x", "id", "y", k, pruned).select("q", "rank", "id", "score").collect()
    return sorted((r.q, r["rank"], r.id, round(r.score, 5)) for r in found)


@pytest.mark.parametrize("seed", range(2))
def test_pruned_search_equals_scoring_everything(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randint(0, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[i][1]) for i in range(20)]  # equal scores
    queries = [(i, " ".join(r.choices([*words, "none"], k=r.randint(0, 5)))) for i in range(25)]
    q, d = frames(spark, docs, queries)
    got = top(q, d, 5, True)
    assert got == top(q, d, 5, False) and len(got) == 125


def test_candidates_are_at_most_a_fifth_of_the_matches(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    short = spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", F.array_join(F.slice(t.words(F.col("text")), 1, 4), " ").alias("text"))
    words = retrieval.stored(retrieval.vocabulary(docs, "text"), "vocabulary")
    n, mean = retrieval._size(words)
    asked = retrieval.stored(retrieval.asked_tokens(short, words, n, "item_id", "text"), "asked").withColumnRenamed("item_id", "query")
    found, _ = retrieval.candidates(retrieval.build_index(docs, "doc_id", "text", mean, asked.select("token").distinct()), asked, 3)
    assert 5 * found.count() <= retrieval.bm25_scores(short, docs, "item_id", "text", "doc_id", "text").count()


def test_matches_do_not_move(spark):
    q, d = frames(spark, [(1, "a b"), (2, "b c"), (3, "d")], [(1, "a b")])
    plan = retrieval.bm25_scores(q, d, "q", "x", "id", "y")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "hashpartitioning(q" not in plan


@pytest.mark.parametrize("pruned", [False, True])
def test_rankings_are_filled_from_the_largest_keys_that_share_nothing(spark, pruned):
    q, d = frames(spark, [(i, "a" if i % 2 else "b c") for i in range(40)] + [(99, "z"), (98, "z y")], [(1, "z"), (2, "none"), (3, None)])
    assert [x[:3] for x in top(q, d, 5, pruned)] == [(1, 1, 99), (1, 2, 98), (1, 3, 39), (1, 4, 38), (1, 5, 37), *((k, i + 1, x) for k in (2, 3) for i, x in enumerate([99, 98, 39, 38, 37]))]
    q, d = frames(spark, [(1, "a"), (2, "b")], [(1, "a")])
    assert len(top(q, d, 5, pruned)) == 2


def test_empty_tables(spark):
    for docs, queries in (([], [(1, "a")]), ([(1, "a")], []), ([], [])):
        for pruned in (False, True):
            assert top(*frames(spark, docs, queries), 3, pruned) == []


def test_nothing_stays_cached(spark):
    q, d = frames(spark, [(1, "a b"), (2, "b c")], [(1, "a b")])
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    top(q, d, 2, False)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_the_weights_query_has_a_row_for_every_token(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    tokens = docs.select(F.explode(t.words(F.col("text"))).alias("token"), "doc_id").groupBy("token").agg(F.countDistinct("doc_id").alias("df"))
    found = catalog.QUERIES["bm25_idf"](spark, DIR)
    assert found.columns == ["token", "df", "idf"]
    assert {(r.token, r.df) for r in found.collect()} == {(r.token, r.df) for r in tokens.collect()} and found.filter("idf is null").count() == 0
