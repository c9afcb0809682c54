"""Evaluators, the filter run, block readers and the smaller operators."""

import math

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as t
from loomtext.operators import blocks, cascade, evaluation, joins, metrics, nested, selection
from loomtext.plans import filter_run


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")


def test_line_pairs_stop_with_the_shorter_file_and_skip_empty_lines_after_pairing(spark):
    pairs = evaluation.line_pairs(lines(spark, [" a ", "b", "c", "d"]), lines(spark, ["x", "", " y "]))
    assert sorted(pairs.collect()) == [(0, "a", "x"), (2, "c", "y")]


def test_local_report(spark):
    refs, hyps = ["the cat sat on the mat", "a dog ran far away", "gone"], ["the cat sat on the mat", "a cat ran", ""]
    pairs = evaluation.line_pairs(lines(spark, refs), lines(spark, hyps))
    out = {r.metric: r.score for r in evaluation.local_report(pairs, meteor=lambda r, h: F.lit(0.25)).collect()}
    assert set(out) == {"BLEU", "ROUGE-L", "METEOR"} and out["METEOR"] == 25.0
    p, r = 2 / 3, 2 / 5
    assert out["ROUGE-L"] == pytest.approx(50 * (1 + 2.44 * p * r / (r + 1.44 * p)), abs=0.006)
    assert all(r.score is None for r in evaluation.local_report(pairs.filter("false")).collect())


def test_comparison_report(spark):
    refs = spark.createDataFrame([(0, "The cat sat on the mat today."), (1, "A dog ran, far away from home."), (9, "no line")], "uid long, summary string")
    files = {"Full": lines(spark, ["The cat sat on the mat today.", "A dog ran, far away from home."]), "None": lines(spark, ["", "x", "y"])}
    rows = {r.metric: r for r in evaluation.comparison_report(refs, files, {"METEOR": lambda r, h: F.lit(0.5)}).collect()}
    assert rows["BLEU"].Full == 100.0 == rows["ROUGE-L"].Full and rows["BLEU"]["None"] == 0.0 == rows["ROUGE-L"]["None"] and rows["METEOR"].Full == 50.0
    none = evaluation.comparison_scores(refs.withColumn("v", F.lit("x")).filter("false"), ["v"])
    assert {(r.metric, r.score) for r in none.collect()} == {("BLEU", 0.0), ("ROUGE-L", 0.0)}


def test_cased_tokens_keep_the_case(spark):
    row = spark.createDataFrame([("He's 3.5 m, Not-4 &amp; so",)], "x string").select(metrics.cased_tokens(F.col("x")).alias("c"), t.nist_tokens(F.col("x")).alias("n")).first()
    assert [w.lower() for w in row.c] == row.n and "He's" in row.c and "3.5" in row.c


@pytest.mark.parametrize("idf", [False, True])
def test_match_scores(spark, idf):
    vectors = {"cat": [1.0, 0.0], "dog": [0.6, 0.8], "ran": [0.0, 1.0], "sat": [0.8, 0.6]}
    table = spark.createDataFrame(list(vectors.items()), "token string, vector array<double>")

    def encode(sentences):
        return sentences.select("text", F.posexplode(F.split("text", " ")).alias("pos", "token")).join(table, "token")

    data = [(1, "cat ran sat", ["dog ran sat", "cat sat ran"]), (2, "dog sat cat", ["cat cat sat"])]
    df = spark.createDataFrame(data, "id long, c string, rs array<string>")
    got = {r.id: r for r in evaluation.match_scores(df, "id", "c", "rs", encode, idf=idf).collect()}
    sentences = {x for _, _, rs in data for x in rs}
    weight = lambda w: 1.0 if not idf else math.log((len(sentences) + 1) / (sum(w in s.split() for s in sentences) + 1))
    cos = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b]))

    def score(c, r):
        side = lambda xs, ys: sum(weight(x) * max(cos(x, y) for y in ys) for x in xs) / sum(map(weight, xs)) if sum(map(weight, xs)) else None
        p, q = side(c.split(), r.split()), side(r.split(), c.split())
        return p, q, 2 * p * q / (p + q)

    if not idf:
        for i, c, rs in data:
            want = [max(x) for x in zip(*(score(c, r) for r in rs))]
            assert [got[i].p, got[i].r, got[i].f] == pytest.approx(want)
    base = spark.createDataFrame([(0.1, 0.2, 0.3)], "p double, r double, f double")
    scaled = {r.id: r for r in evaluation.match_scores(df, "id", "c", "rs", encode, idf=idf, baseline=base).collect()}
    assert scaled[1].f == pytest.approx((got[1].f - 0.3) / 0.7)
    with pytest.raises(FileNotFoundError):
        evaluation.match_scores(df, "id", "c", "rs", encode, strict=True)


def test_filter_run(spark, tmp_path):
    code = lambda i, s: f"-- {s}\nlocal function f{i}(a, b)\n  local c = a + b\n  print(c)\n  return c\nend"
    texts = [f"Adds number {w} to the running total of all values" for w in "one sixteen thousand".split()]
    good = [texts[0], texts[0], "Reverses every word within a sentence quickly", "Copyright of this belongs to nobody at all", texts[2]]
    rows = [code(i, s) for i, s in enumerate(good)] + ["no comment here\nx\ny"] * 15
    spark.createDataFrame([(x,) for x in rows], "content string").coalesce(1).write.parquet(f"{tmp_path}/src/lua")
    out = f"{tmp_path}/out"
    reports = filter_run.run(spark, f"{tmp_path}/src/{{lang}}", out, ratio=0.5)
    assert set(reports) == {"lua"}
    reasons = {r.reject_reason: r.n for r in reports["lua"]["reasons"].collect()}
    assert reasons == {"no_docstring": 5, "license_copyright": 1}
    final = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/final/lua")
    kept = [r[1] for r in final.collect()]
    assert good[0] in kept and good[2] in kept and len(kept) == len(set(kept)) <= 3
    assert reports["lua"]["mean_length"].first().mean_length > 3
    again = filter_run.run(spark, f"{tmp_path}/src/{{lang}}", out, steps=(3,), target=1)
    assert again["lua"]["mean_length"].first().mean_length and spark.read.option("sep", "\t").option("header", True).csv(f"{out}/final/lua").count() == 1


def test_lua_blocks():
    code = "-- doc\nlocal function add(a, b)\n  local x = a + b -- sum\n  if x > 3 then return x else y = 2 end\n  for i = 1, 10 do print(i) end\n  t.map(function(v) z = v; return v end)\nend\nM.x, M['y'] = 1, [[long\ntext]]\nrepeat k = k .. 'a' until #k > 5\nwhile true do break end\ngoto done\n::done::\ndo local q <const> = {f = function() end, [1] = 2; 3} end\nreturn f 'a' {1} (2):m(...)"
    out = blocks.lua_blocks(code)
    assert out["ok"]
    assert out["function_def"] == ["local function add(a, b)\n  {}\nend", "function(v) {} end"]
    assert out["loops"] == ["for i = 1, 10 do print(i) end", "repeat k = k .. 'a' until #k > 5", "while true do break end"]
    assert out["conditionals"] == ["if x > 3 then return x else y = 2 end"]
    assert out["assignments"] == ["local x = a + b", "z = v", "M.x, M['y'] = 1, [[long\ntext]]", "k = k .. 'a'", "local q <const> = {f = function() end, [1] = 2; 3}"]
    assert out["others"] == ["return x", "return v", "return f 'a' {1} (2):m(...)"]
    assert blocks.lua_blocks("if a then elseif b then x = 1 end")["assignments"] == ["x = 1"]
    for bad in ("x = = 1", "function f( end", "x = 1 end", "y = \x01", None, "a = 'open"):
        assert not blocks.lua_blocks(bad)["ok"]
    assert blocks.lua_blocks("")["ok"] and not blocks.lua_blocks("x = " + "(" * 100_000)["ok"]


def test_racket_blocks():
    code = "#lang racket\n; doc\n(define (f x) \"s)\" (let ([y 1]) (for/list ([i 3]) i) (if x 1 2)) 'q ,@z 12)\n(define z '(1 2)) (displayln z) #;(skipped) sym () #| (no) |# ((g) 1) #(1 2) #\\( -3.5"
    out = blocks.racket_blocks(code)
    assert out["ok"] and out["function_def"] == ["(define (f x) ...)"] and out["loops"] == ["(for/list ([i 3]) i)"] and out["conditionals"] == ["(if x 1 2)"]
    assert out["assignments"] == ["(let ([y 1]) (for/list ([i 3]) i) (if x 1 2))", "(define z '(1 2))"]
    assert out["others"] == ["#lang racket", '"s)"', "'q", ",@z", "12", "(displayln z)", "sym", "((g) 1)", "#(1 2)", "#\\(", "-3.5"]
    for bad in ("(a (b)", "(a])", ")", '"open', None):
        assert not blocks.racket_blocks(bad)["ok"]
    assert blocks.racket_blocks("(" * 50_000 + ")" * 50_000)["ok"]


def test_blocks_as_columns(spark):
    df = spark.createDataFrame([("def f():\n    def g():\n        x = 1\n    return g",), ("x = (",), (None,)], "code string")
    rows = df.select(blocks.split_blocks(F.col("code"), "python-outer").alias("o"), blocks.split_statements(F.col("code")).alias("s"), blocks.lex(F.col("code")).alias("l")).collect()
    assert rows[0].o.function_def == ["def f():"] and rows[0].s.ok and len(rows[0].s.statements) == 2 and rows[0].l[:3] == ["def", "f", "("]
    assert not rows[1].o.ok and rows[1].s == (["x = ("], False) and rows[1].l == ["x", "=", "("]
    assert not rows[2].o.ok and rows[2].l == []
    with pytest.raises(NotImplementedError):
        blocks.split_blocks(F.col("code"), "cobol")


def test_padded_tokens(spark):
    df = spark.createDataFrame([(["a b c d", "e"],), ([],)], "s array<string>")
    rows = df.select(F.struct(*(c.alias(n) for n, c in zip("xyz", nested.padded_tokens(F.col("s"), 3, 3, "-")))).alias("r")).collect()
    assert rows[0].r == ([["a", "b", "c"], ["e", "-", "-"], ["-"] * 3], [[1, 1, 1], [1, 0, 0], [0] * 3], [1, 1, 0])
    assert rows[1].r == ([["-"] * 3] * 3, [[0] * 3] * 3, [0, 0, 0])


def test_best_candidate_with_its_copies(spark):
    kind = "id long, translations array<struct<code string, status string, back_translation string, hybrid_score double>>"
    df = spark.createDataFrame([(1, [("a", "invalid", "x", 0.9), ("b", "valid", "y", 0.4)]), (2, [])], kind)
    rows = {r.id: r for r in selection.with_best(df).collect()}
    assert rows[1].best_candidate_info == (1, "valid", "b", "y", (None, None, 0.4)) and rows[1].best_python_code == "b" and rows[1].best_score_hybrid == 0.4
    assert rows[2].best_candidate_info.status == "failed" and rows[2].best_python_code is None


def test_small_ones(spark):
    a = spark.createDataFrame([(1,), (2,)], "idx long")
    b = spark.createDataFrame([(1, "x", None), (3, "x", None), (2, None, None), (None, None, "{bad")], "id long, raw_code string, _corrupt_record string")
    assert joins.merge_counts(a, b, corrupt="_corrupt_record").first() == (1, 1, 1, 1)
    df = spark.createDataFrame([(["a", "."], "d e"), ([], "d  e ."), (None, None)], "tokens array<string>, doc string")
    assert [r[0] for r in df.select(t.join_tokens(F.col("tokens"), True, F.col("doc"))).collect()] == ["a.", "d e.", ""]
    rows = spark.createDataFrame([(1, None, "lua", "{bad")], "index long, content string, code_lang string, _corrupt_record string")
    assert cascade.reject_cascade(rows, corrupt="_corrupt_record").first().reject_reason == "processing_error"
    assert cascade.mean_length(spark.createDataFrame([], "length int")).first().mean_length is None
