"""Ranked search against plain scoring, and its two ways against each other."""

import math
import random
import re
from collections import Counter

import pytest

from loomtext.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(items, docs, k=50):
    found = [(doc_id, Counter(t), len(t)) for doc_id, text in docs if (t := terms(text))]
    n, total = len(found), sum(size for *_, size in found)
    df = Counter(t for _, c, _ in found for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc_id, c, size in found:
            m = 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def frames(spark, items, docs):
    return spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("most", [lexical.MOST_BROADCAST, 0])
def test_both_ways_equal_plain_scoring(spark, most):
    r = random.Random(1)
    words = [*"abcdefgh", "The", "é", "ÀB", "x1", "nadir"]
    docs = [(i, r.choice([" ", "-", "\n"]).join(r.choices(words, k=r.randint(0, 30)))) for i in range(120)]
    docs += [(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "É the"), (900, None), (901, ""), (902, "--"), (903, "nadir " * 50_000)]
    items = [(1, "The a nadir"), (2, "é x1 zzz"), (2, "h h h"), (3, ""), (4, None), (None, "ÀB"), (None, "g"), (7, "THE the tHe")]
    found = lexical.search(*frames(spark, items, docs), k=20, most_broadcast=most)
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert rows(found) == plain(items, docs, 20)


def test_empty_tables(spark):
    items, docs = [(1, "a")], [(1, "a b")]
    assert rows(lexical.search(*frames(spark, items, []))) == []
    assert rows(lexical.search(*frames(spark, [], docs))) == []
    assert rows(lexical.search(*frames(spark, items, [(1, None), (2, "?")]))) == []


def test_equal_scores_fill_the_ranks_in_order_of_id(spark):
    docs = [(i, "same words here") for i in range(99, -1, -1)] + [(200, "other")]
    assert [r[1:3] for r in sorted(rows(lexical.search(*frames(spark, [(1, "words")], docs))))] == [(i + 1, i) for i in range(50)]


def test_columns_by_other_names_and_clashing_ones(spark):
    docs = spark.createDataFrame([("x", "a b", 1, "t"), ("y", "a", 2, "u")], "id string, body string, tf int, term string")
    items = spark.createDataFrame([("q", "A", 3)], "rid string, text string, bucket int")
    found = lexical.search(items, docs, id_col="id", text_col="body", item_col="rid")
    assert [(r.item_id, r.rank, r.doc_id) for r in found.orderBy("rank").collect()] == [("q", 1, "y"), ("q", 2, "x")]


def test_the_query_equals_plain_scoring_on_the_tables(spark):
    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").collect()]
    assert rows(lexical.op12_ranked_search(spark, "/root/testdata/sf0.001")) == plain(read("benchmark", "item_id"), read("documents", "doc_id"))


def test_matches_are_summed_where_they_are_made(spark):
    plan = lexical.op12_ranked_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.rindex("Initial Plan") :] if "Initial Plan" in plan else plan
    assert initial.count("hashpartitioning(item_id") == 1 and initial.count("hashpartitioning(rid") == 1 and "CartesianProduct" not in plan
    assert "WindowGroupLimit" in initial and "Partial" in initial
