"""Models inside the cascade: each open row is seen once, closed rows never, in one plan over one scan."""

import pytest
from pyspark.sql import functions as F

from loomtext import catalog
from loomtext.operators import cascade
from loomtext.operators.gated import BatchPort

BODY = "\nlocal function f(a, b)\n  local x = a\n  local y = b\n  print(x + y)\nend"
SUMMARIES = ["Adds two numbers", "noverb two numbers", "Adds wrng numbers", "Adds far numbers", "Adds nosim numbers", "How to add it"]


def rows(spark):
    data = [(i, f"-- {s}" + BODY, "lua") for i, s in enumerate(SUMMARIES * 5)] + [(900, None, "lua"), (901, "x = 1", "lua")]
    return spark.createDataFrame(data, "index long, content string, code_lang string").repartition(3)


def counted(spark, result, returns, inputs=("summary",), **more):
    seen, made, largest = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), []

    def factory():
        made.add(1)

        def model(*texts):
            seen.add(len(texts[0]))
            return [result(*x) for x in zip(*texts, strict=True)]

        return model

    return BatchPort(factory, inputs, returns, **more), seen, made


def near(code, summary):
    if "nosim" in summary:
        raise ValueError(summary)
    return 0.95 if "far" in summary else 0.5


def test_each_row_is_seen_once_by_the_models_that_it_reaches(spark):
    verb, n_verb, _ = counted(spark, lambda s: "noverb" not in s, "boolean")
    grammar, n_grammar, _ = counted(spark, lambda s: s.count("wrng"), "int")
    similar, _, _ = counted(spark, near, "double", ("code", "summary"), null_on_error=True)
    judged = cascade.reject_cascade(rows(spark), cascade.Ports(verb, grammar, similar))
    want = dict(zip(range(6), [None, "info_no_verb", "grammar_errors", "bad_similarity", "similarity_error", "info_question_or_todo"], strict=True))
    got = {r["index"]: (r.reject_reason, r.similarity) for r in judged.collect()}
    assert {i: reason for i, (reason, _) in got.items()} == {i: want[i % 6] for i in range(30)} | {900: "empty_content", 901: "no_docstring"}
    assert got[0][1] == 0.5 and got[3][1] == 0.95 and got[4][1] is None and got[1][1] is None
    assert (n_verb.value, n_grammar.value) == (30, 20)
    n_verb.value = n_grammar.value = 0
    assert cascade.survivors(judged).filter("length > 1 and similarity > 0.1").count() == 5  # filters don't move below a model
    assert (n_verb.value, n_grammar.value) == (30, 20)
    n_verb.value = 0
    assert {r.reject_reason: r.n for r in cascade.top_reasons(judged).collect()}["info_no_verb"] == 5 and n_verb.value == 30


def test_three_models_are_three_steps_over_one_scan(spark):
    plan = catalog._gated(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 3 and "Union" not in plan and "Exchange" not in plan


def test_a_model_is_not_made_without_open_rows(spark):
    port, seen, made = counted(spark, lambda s: True, "boolean")
    cascade.reject_cascade(rows(spark).filter("index >= 900"), cascade.Ports(has_verb=port)).collect()
    assert (seen.value, made.value) == (0, 0)


def test_batches_are_bounded_and_longest_first(spark):
    calls = spark.createDataFrame([(i, "x" * (i % 7 + 1) if i % 3 else None) for i in range(100)], "i long, x string").coalesce(1)
    port = BatchPort(lambda: lambda xs: [f"{len(xs)}:{max(map(len, xs))}" for _ in xs], ("x",), "string", batch=10)
    got = calls.withColumn("y", port.column(F.col("x").isNotNull())).collect()
    assert all((r.x is None) == (r.y is None) for r in got)
    assert all(int(r.y.split(":")[0]) <= 10 for r in got if r.y) and max(int(r.y.split(":")[1]) - len(r.x) for r in got if r.y) <= 2


def test_an_error_ends_the_job_unless_told_otherwise(spark):
    port, _, _ = counted(spark, near, "double", ("code", "summary"))
    with pytest.raises(Exception, match="nosim"):
        cascade.reject_cascade(rows(spark), cascade.Ports(similarity=port)).collect()


def test_a_join_after_a_model_can_be_checkpointed(spark):
    verb, seen, _ = counted(spark, lambda s: "noverb" not in s, "boolean")
    join = lambda d: d.drop("similarity").withColumn("similarity", F.lit(0.5))
    judged = cascade.reject_cascade(rows(spark), cascade.Ports(has_verb=verb, similarity=join), checkpoint=lambda d: d.checkpoint())
    seen.value = 0
    assert judged.filter("reject_reason is null").count() == 20 and seen.value == 0


def test_reasons_of_the_query_are_all_that_can_fire(spark):
    assert {r.reject_reason for r in catalog.gated_reasons(spark, "/root/testdata/sf0.001").collect()} == set(cascade.LAYERS) - {"code_empty_code", "bad_overlap"}
