"""Ports to outside scorers and classifiers, pooled embeddings, matrices of tokens, ranges and bottom-k: against plain versions."""

import math
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext import catalog
from loomtext.operators import cascade, classify, dedup, evaluation, matching, metrics, pooling, stats
from loomtext.plans import line_scorer

COMMAND = [sys.executable, "-u", "-c", line_scorer.DOUBLE]
#: Ends after each third answer.
FRAIL = "import itertools\n" + line_scorer.DOUBLE.replace("for line in sys.stdin:", "for n, line in zip(range(5), sys.stdin):")


# ---- the scorer's line protocol ----------------------------------------------------------------------------------------------
def test_a_scorer_is_asked_by_lines():
    scorer = line_scorer.LineScorer(tuple(COMMAND))
    assert scorer.score("a b c d", ["a x", "b"]) == 0.5
    assert scorer.score("a ||| b\nc", ["c ||| a"]) == pytest.approx(2 / 3)  # the separator and line ends don't get through
    assert scorer.score("", ["a"]) == 0.0  # its answer is no number
    assert scorer.starts == 1
    scorer.close()


def test_a_scorer_that_ends_is_started_anew():
    scorer = line_scorer.LineScorer((sys.executable, "-u", "-c", FRAIL))
    assert [scorer.score("a b", ["a"]) for _ in range(7)] == [0.5] * 7 and scorer.starts > 2
    scorer.close()
    dead = line_scorer.LineScorer((sys.executable, "-c", "pass"))
    assert dead.score("a", ["a"]) == 0.0 and dead.starts == 2
    mute = line_scorer.LineScorer((sys.executable, "-c", "import time; time.sleep(60)"), seconds=0.2)
    assert mute.score("a", ["a"]) == 0.0
    mute.close()


def test_a_report_with_three_metrics(spark):
    lines = lambda xs: spark.createDataFrame(list(enumerate(xs)), "row_id long, text string")
    pairs = evaluation.line_pairs(lines(["a b c d", "x y", "z"]), lines(["a b c q", "x y", ""]))
    got = {r.metric: r.score for r in evaluation.local_report(pairs, line_scorer.line_scorer_port(COMMAND)).collect()}
    assert set(got) == {"BLEU", "ROUGE-L", "METEOR"} and got["METEOR"] == 87.5
    many = pairs.withColumn("m", line_scorer.line_scorer_port(COMMAND)(F.array("reference", F.lit("q")), F.col("hypothesis")))
    assert sorted(r.m for r in many.collect()) == [1.0, 1.0]


# ---- the classifier --------------------------------------------------------------------------------------------------------
def test_tensors_are_padded_and_cut():
    ids, words, statements = classify.tensors([["a\nbb", ""], ["c"] * 5, []], lambda s: [len(w) for w in s.split()], 9, 3, 2)
    assert ids.tolist() == [[[1, 2], [9, 9], [9, 9]], [[1, 9]] * 3, [[9, 9]] * 3]
    assert words.tolist() == [[[1, 1], [0, 0], [0, 0]], [[1, 0]] * 3, [[0, 0]] * 3]
    assert statements.tolist() == [[1, 1, 0], [1, 1, 1], [0, 0, 0]]


def test_labels_stand_where_their_statements_do(spark):
    r = random.Random(1)
    seqs = lambda: r.choice([None, [], [r.choice(["x", "call f", "a = b c", ""]) for _ in range(r.randrange(1, 7))]])
    rows = [(i, seqs(), r.choice([None, [(f"c{j}", seqs()) for j in range(r.randrange(4))]])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, cleaned_seqs array<string>, retrieved_candidates array<struct<code: string, cleaned_seqs: array<string>>>")
    calls = spark.sparkContext.accumulator(0)

    def stand_in():
        def model(ids, words, statements):
            calls.add(len(ids))
            assert ids.shape[1:] == (4, 3) and len(ids) <= 5
            return words.sum(2) % 2

        return lambda s: [1] * len(s.split()), model

    got = {x.id: x for x in classify.classified(df, classify.label_port(stand_in, most=4, each=3, batch=5)).collect()}
    label = lambda seq: [min(3, len(s.split())) % 2 for s in (seq or [])[:4]]
    pick = lambda seq: [s for s, x in zip(seq or [], label(seq)) if x]
    for i, main, others in rows:
        assert (got[i].pred_labels, got[i].cleaned_seqs_pred) == (label(main), pick(main))
        assert [(c.code, c.pred_labels, c.cleaned_seqs_pred) for c in got[i].retrieved_candidates] == [(code, label(s), pick(s)) for code, s in others or []]
    assert calls.value == sum(1 + len(others or []) for *_, others in rows)  # each example once


# ---- pooled embeddings -----------------------------------------------------------------------------------------------------
def test_means_take_the_first_tokens(spark):
    r = np.random.default_rng(0)
    data = [(k, p, r.normal(size=3).tolist()) for k, n in (("a", 10), ("b", 2), ("c", 4)) for p in range(n)]
    got = {x.k: x["mean"] for x in pooling.mean_vectors(spark.createDataFrame(data, "k string, p int, v array<float>").repartition(3), "k", "p", "v", 4).collect()}
    assert got == {k: pytest.approx(np.mean([np.float32(v) for kk, p, v in data if kk == k and p < 4], axis=0)) for k in "abc"}
    assert pooling.mean_vector(np.array([[1.0, 2.0], [3.0, 4.0]]), np.array([0, 1])).tolist() == [3.0, 4.0] and math.isnan(pooling.mean_vector(np.empty((0, 2)))[0])


def test_similarity_of_the_cascade_comes_from_cut_texts(spark):
    seen = spark.sparkContext.accumulator(0)

    def encoder():
        def encode(texts, most):
            seen.add(sum(len(x.split()) > most for x in texts))
            return [np.array([[len(w), 1.0] for w in x.split()[:most]]).reshape(-1, 2) for x in texts]

        return encode

    body = "\nlocal function f(a, b)\n  local x = a\n  local y = b\n  print(x + y)\nend"
    df = spark.createDataFrame([(1, "-- Adds two numbers together." + body, "lua"), (2, None, "lua")], "index long, content string, code_lang string")
    row = next(r for r in cascade.reject_cascade(df, cascade.Ports(similarity=pooling.similarity_port(encoder, 5, 2))).collect() if r["index"] == 1)
    vector = lambda words: np.mean([[len(w), 1.0] for w in words], axis=0)
    assert row.similarity == pytest.approx(pooling.cosine(vector("local function f(a, b) local".split()), vector(["Adds", "two"]))) and seen.value == 2


# ---- matrices of tokens ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [3, 512])
def test_best_cosines_and_cells_equal_plain_ones(spark, block):
    r = np.random.default_rng(2)
    side = lambda base: [(k, f"{base}{i}", r.normal(size=4).tolist(), float(i % 3)) for k, n in ((1, 9), (2, 1), (None, 2), (base, 3)) for i in range(n)]
    h, g = side(10), side(20)
    frame = lambda rows: spark.createDataFrame(rows, "pair int, token string, vector array<float>, weight double")
    unit = lambda v: (w := np.float32(v).astype(float)) / np.sqrt(w @ w)
    cells = {(p, i, j): float(unit(u) @ unit(v)) for p, i, u, _ in h for q, j, v, _ in g if p == q and p is not None}
    assert {(x.pair, x.i, x.j): x.similarity for x in matching.cosine_cells(frame(h), frame(g), block).collect()} == pytest.approx(cells)
    got = sorted((x.pair, x.side, round(x.s, 6), x.weight) for x in matching.best_cosines(frame(h), frame(g), block).collect())
    want = [(p, "hypothesis", round(max(s for (q, a, _), s in cells.items() if (q, a) == (p, i)), 6), w) for p, i, _, w in h if p in (1, 2)]
    want += [(p, "reference", round(max(s for (q, _, b), s in cells.items() if (q, b) == (p, j)), 6), w) for p, j, _, w in g if p in (1, 2)]
    assert got == sorted(want)


def test_cells_of_one_pair_are_the_work_of_several_tasks(spark):
    r = np.random.default_rng(3)
    side = lambda base, n: spark.createDataFrame([(1, base + i, r.normal(size=4).tolist(), 1.0) for i in range(n)], "pair int, token int, vector array<float>, weight double")
    found = matching.cosine_cells(side(0, 40), side(100, 30), 5)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((x.i, x.j) for x in rows) == [(i, 100 + j) for i in range(40) for j in range(30)]
    assert len({x.task for x in rows}) > 1


def test_what_moves_for_cells_grows_with_the_tokens_not_with_the_cells(spark):
    def exchanges(plan):
        inner = next((getattr(plan, m)() for kind, m in (("AdaptiveSparkPlanExec", "executedPlan"), ("QueryStageExec", "plan")) if kind in plan.getClass().getSimpleName()), None)
        below = [plan.children().apply(k) for k in range(plan.children().size())] if inner is None else [inner]
        return ([plan] if plan.getClass().getSimpleName() == "ShuffleExchangeExec" else []) + [x for y in below for x in exchanges(y)]

    def moved(n):
        side = lambda odd: spark.range(n).select(F.lit(1).alias("pair"), (2 * F.col("id") + odd).alias("token"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("vector"), F.lit(1.0).alias("weight"))
        found = matching.cosine_cells(side(0), side(1), 5)
        assert len({(x.i, x.j) for x in found.collect()}) == n * n
        return sum(x.metrics().apply("shuffleRecordsWritten").value() for x in exchanges(found._jdf.queryExecution().executedPlan()))

    few, many = moved(100), moved(400)
    assert 0 < many < 5 * few


def test_cells_do_not_become_rows_and_zero_vectors_score_nothing(spark):
    rows = spark.createDataFrame([(1, i, [float(i % 4 + 1), 1.0], 1.0) for i in range(40)], "pair int, token int, vector array<float>, weight double")
    best = matching.best_cosines(rows, rows)
    assert best.count() == 80 and "Generate" in best._jdf.queryExecution().executedPlan().toString()
    zero = spark.createDataFrame([(1, i, [0.0, 0.0], 1.0) for i in range(3)], rows.schema)
    assert metrics.greedy_match(zero, rows).first().f == 0.0


# ---- ranges and bottom-k ---------------------------------------------------------------------------------------------------
def test_ranks_come_from_ranges(spark):
    r = random.Random(3)
    data = [(r.choice([1.5, 2.0, r.random() * 9]), r.choice([1.0, 2.0, r.random() * 9])) for _ in range(500)]
    row = stats.signed_ranks(spark.createDataFrame(data, "a double, b double"), "a", "b").first()
    d = sorted((abs(a - b), a > b) for a, b in data if a != b)
    rank = {v: sum(x < v for x, _ in d) + (sum(x == v for x, _ in d) + 1) / 2 for v, _ in d}
    assert row.n == len(d) and row.w_plus == sum(rank[v] for v, up in d if up) and row.w_minus == sum(rank[v] for v, up in d if not up)
    groups = spark.createDataFrame([(float(i), i % 5) for i in range(100)], "v double, c long").repartition(3)
    below = stats.running_below(groups, "v", "c", "below", ranges=7)
    assert [x.below for x in below.orderBy("v").collect()] == [sum(i % 5 for i in range(k)) for k in range(100)]
    assert "SinglePartition" not in below._jdf.queryExecution().executedPlan().toString()
    assert tuple(stats.signed_ranks(spark.createDataFrame([], "a double, b double"), "a", "b").first()) == (0, 0.0, 0.0, 0)


def test_bottom_k_in_two_steps(spark):
    r = random.Random(4)
    rows = [(r.choice("aaab"), r.randrange(1000), i) for i in range(2000)] + [("c", 1, 9999), (None, 1, 9998)]
    got = sorted((x.g is None, x.g or "", x._r, x.i) for x in dedup.bottom_k(spark.createDataFrame(rows, "g string, x int, i int").repartition(9), ["g"], 25, ["x", "i"], slices=4).collect())
    want = []
    for g in {g for g, *_ in rows}:
        own = sorted((x, i) for h, x, i in rows if h == g)[:25]
        want += [(g is None, g or "", n, i) for n, (_, i) in enumerate(own, 1)]
    assert got == sorted(want)

@pytest.mark.parametrize("most_broadcast", [0, 100])
def test_means_by_id_move_sums_alone(spark, most_broadcast):
    r = np.random.default_rng(1)
    vectors = r.normal(size=(20, 5))
    ids = {k: [int(i) for i in r.integers(0, 25, size=n)] for k, n in enumerate([0, 1, 7, 500, 3])}
    rows = spark.createDataFrame([*ids.items(), (9, None)], "key long, ids array<long>")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<float>")
    want = {k: np.mean([vectors[i] for i in own if i < 20], 0) for k, own in ids.items() if any(i < 20 for i in own)}
    found = pooling.mean_vectors_by_id(rows, "key", "ids", table, "id", "v", most_broadcast)
    got = {row.key: row["mean"] for row in found.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    assert pooling.mean_vectors_by_id(rows, "key", "ids", table.limit(0), "id", "v").collect() == []


def test_pooled_query_shuffles_no_row_a_token(spark):
    """Partial means of a document leave a task, not its tokens' vectors."""
    plan = catalog.QUERIES["pooled_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_avg" in plan and "BroadcastHashJoin" in plan
