"""Operators on inline fixtures and against sequential definitions."""

import difflib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import blocks, cascade, dedup, joins, metrics, near_text, nested, retrieval, selection, stats
from loomtext.plans import ports, prompts
from loomtext.sources import records
from loomtext.streaming import stages


def checkpoint(df):
    return df.checkpoint()


# ---- cascade ----------------------------------------------------------------------------------------------------------------
BODY = "\nlocal function add(a, b)\n  local c = a + b\n  return c\nend"


def test_cascade_reasons_partition_the_rows(spark):
    rows = {
        None: "empty_content", " ": "empty_content", "local function f() end": "no_docstring", "-- Returns it all" + BODY: "clean_failed",
        "-- Adds two numbers together." + BODY: None, "-- Adds two numbers together.\nfunction f() end": "code_too_short",
        "-- Adds two numbers for test.\nfunction f(a)\n x()\n y()\nend": "code_test_function", "-- Adds two numbers together.\nlocal function g(a)\n return 1": "code_stub_function",
        "-- Adds two numbers together.\nlocal function f( )\n  x()\n  y()\nend": "processing_error", "-- add a b add" + BODY: "identifier_repetition",
        "-- All under the license of them" + BODY: "license_copyright", "-- TODOs: it is of a" + BODY: "clean_failed", "-- How to add things up" + BODY: None,
        "-- the of and in it" + BODY: "info_insufficient_content",
    }
    df = spark.createDataFrame([(i, c, "lua") for i, c in enumerate(rows)], "index long, content string, code_lang string")
    ask = lambda d: d.withColumn("has_verb", F.lit(True))
    want = dict(enumerate(rows.values()))
    want[12] = "info_question_or_todo"
    with_verb = {r["index"]: r.reject_reason for r in cascade.reject_cascade(df, cascade.Ports(has_verb=ask)).collect()}
    assert with_verb == want
    assert {r["index"]: r.reject_reason for r in cascade.reject_cascade(df).collect()} == want
    dull = cascade.Ports(has_verb=lambda d: d.withColumn("has_verb", F.lit(False)))
    assert {r.reject_reason for r in cascade.reject_cascade(df, dull).filter("index in (4, 12, 13)").collect()} == {"info_no_verb"}
    judged = cascade.reject_cascade(df, cascade.Ports(has_verb=ask))
    counts = {r.layer: r.passed for r in cascade.layer_counts(judged).collect()}
    assert counts[4] == 1 and counts[1] == 14 - 5 and cascade.survivors(judged).count() == 1
    assert sum(r.n for r in cascade.top_reasons(judged, 99).collect()) == 13
    assert [r.percent for r in cascade.layer_counts(judged.filter("false")).collect()] == [None] * 4


def test_cascade_ports_see_only_what_is_left(spark):
    df = spark.createDataFrame([(1, "-- Adds two numbers together." + BODY, "lua"), (2, None, "lua"), (3, "-- Adds many numbers together." + BODY, "lua")], "index long, content string, code_lang string")
    seen = spark.sparkContext.accumulator(0)

    def similarity(d):
        def run(parts):
            for p in parts:
                seen.add(len(p))
                yield p.assign(similarity=[0.5 if "two" in s else 0.95 for s in p.summary])

        return d.drop("similarity").mapInPandas(run, d.drop("similarity").withColumn("similarity", F.lit(0.0)).schema)

    made = cascade.Ports(grammar_issues=lambda d: d.withColumn("grammar_issues", F.lit(0)), similarity=similarity)
    out = {r["index"]: r.reject_reason for r in cascade.reject_cascade(df, made).collect()}
    assert out == {1: None, 2: "empty_content", 3: "bad_similarity"} and seen.value == 2


def test_cascade_on_a_stream(spark, tmp_path):
    schema = "index long, content string, code_lang string"
    spark.createDataFrame([(1, "-- Adds two numbers together." + BODY, "lua"), (2, None, "lua")], schema).write.json(str(tmp_path / "in"))
    query = stages.judged_stream(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("judged").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r["index"]: r.reject_reason for r in spark.table("judged").collect()} == {1: None, 2: "empty_content"}


# ---- duplicates -------------------------------------------------------------------------------------------------------------
def test_first_wins_equals_the_sequential_rule(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("abcd é") for _ in range(r.randrange(12, 24))) for _ in range(12)]
    texts += [t[:i] + r.choice("xyz") + t[i + 1 :] for t in texts for i in (2, 7)] + ["", "abc"]
    r.shuffle(texts)
    kept = []
    for i, x in enumerate(texts):
        if not any(difflib.SequenceMatcher(None, x, texts[j]).ratio() > 0.85 for j in kept):
            kept.append(i)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, x string")
    pairs = near_text.near_duplicate_pairs(df, "id", "x")
    assert sorted(row.id for row in near_text.first_wins(pairs, df, "id", checkpoint).collect()) == kept


def test_keep_first_samples_and_caps(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", "x"), (2, "b", "y")], "id long, k string, v string")
    assert sorted(map(tuple, dedup.keep_first(df, ["k"], ["id"]).collect())) == [(1, "a", "x"), (2, "b", "y")]
    assert sorted(map(tuple, dedup.keep_first(df, ["k"], ["id"], last=True).collect())) == [(2, "b", "y"), (3, "a", None)]
    assert dedup.row_cap(df, "id", None).count() == 3 and dedup.row_cap(df, "id", 0).count() == 0
    rows = spark.createDataFrame([(i, "g", 3 + i % 48) for i in range(200)], "id long, g string, n int")
    picked = dedup.stratified_sample(rows, "g", F.col("n"), "id", 50)
    found = {r.s: r["count"] for r in picked.groupBy(dedup.length_stratum(F.col("n")).alias("s")).count().collect()}
    assert picked.count() == 50 and found["short"] >= 20 and found["medium"] >= 20 and found["long"] == 10
    strata = {"short": list(range(10)), "medium": list(range(10, 30)), "long": list(range(30, 35))}
    drawn = dedup.cpython_sample(strata, 20)
    assert len(set(drawn)) == 20 and dedup.cpython_sample(strata, 20) == drawn and len(dedup.cpython_sample(strata, 99)) == 35


# ---- joins ------------------------------------------------------------------------------------------------------------------
def test_positional_joins(spark):
    code = spark.createDataFrame([(0, "a"), (1, None), (2, "c"), (3, "d")], "row_id long, code string")
    structure = spark.createDataFrame([(0, ["s"]), (1, ["s"]), (2, ["s"])], "row_id long, snippets array<string>")
    ranked = spark.createDataFrame([(0, ["r"]), (1, ["r"]), (2, None)], "row_id long, candidates array<string>")
    assert sorted((r.code, r.candidates, r.idx) for r in joins.zip_inputs(code, structure, ranked).collect()) == [("a", ["r"], 1), ("c", [], 3)]
    assert sorted((r.code, r.idx) for r in joins.zip_inputs(code, gapless=True).collect()) == [("a", 1), ("c", 2), ("d", 3)]
    a = spark.createDataFrame([(1, "old", 0), (1, "new", 1), (2, "x", 2)], "idx long, t string, o long")
    b = spark.createDataFrame([(1, "c1"), (1, "c2"), (9, "c"), (2, None)], "id long, raw_code string")
    assert sorted((r.t, r.raw_code) for r in joins.last_wins_merge(a, b, "o").collect() if r.raw_code) == [("new", "c1"), ("new", "c2")]
    assert tuple(joins.merge_counts(a, b).first()) == (2, 1, 1)


def test_pair_maps_and_alignment(spark):
    gold = spark.createDataFrame([(0, "1", "g"), (1, "1", "h"), (2, "7", "z")], "row_id long, id string, text string")
    made = spark.createDataFrame([(0, "1", "p"), (1, "1", "q")], "row_id long, id string, text string")
    assert [tuple(r) for r in joins.pair_maps(gold, made).collect()] == [("1", "q", ["g", "h"])]
    refs = spark.createDataFrame([(1, "r1"), (2, "r2"), (9, "r9")], "uid long, ref string")
    lines = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row_id long, text string")
    assert sorted(map(tuple, joins.align(refs, {"x": lines}).collect())) == [(1, "r1", "b"), (2, "r2", "c")]
    assert sorted(map(tuple, joins.align(refs, {"x": lines}, one_based=True).collect())) == [(1, "r1", "a"), (2, "r2", "b")]


# ---- nested, selection ------------------------------------------------------------------------------------------------------
CAND = "array<struct<status string, hybrid_score double, back_translation string, temperature double, code string>>"


def test_selection(spark):
    c = lambda status, score=None, bt=None, temp=0.7, code="x": (status, score, bt, temp, code)
    rows = [(1, [c("invalid"), c("valid"), c("valid", 0.4), c("valid", 0.4)]), (2, [c("invalid", code="abc"), c("invalid", code="a"), c("bad", code="")]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, f"id int, cs {CAND}")
    best = selection.best_candidate(F.col("cs"))
    got = {r.id: tuple(r.b) for r in df.select("id", best.alias("b")).collect()}
    assert got == {1: (2, "valid", 0.4), 2: (0, "invalid", 0.0), 3: (-1, "failed", 0.0), 4: (-1, "failed", 0.0)}
    assert df.filter("id = 2").select(selection.shortest_invalid(F.col("cs"))).first()[0] == 1
    one = spark.createDataFrame([([c("invalid", temp=0.0), c("success", bt=" "), c("valid", bt="z")],)], f"cs {CAND}")
    flags = one.select(*(F.transform("cs", f) for f in (selection.usable, selection.to_back_translate, selection.is_hole))).first()
    assert [list(x) for x in flags] == [[False, True, True], [True, True, True], [False, True, False]]
    assert one.select(selection.greedy_candidate(F.col("cs"))["status"], selection.greedy_candidate(F.slice("cs", 2, 2), 1e-6)["status"]).first()[:] == ("invalid", "success")


def test_nested_round_trip(spark):
    df = spark.createDataFrame([(1, "m", ["a", "b"]), (2, "n", []), (3, "o", None)], "k long, main string, cs array<string>")
    flat = nested.flatten_candidates(df, "k", "main", "cs")
    assert sorted(r.item_id for r in flat.collect()) == ["1_cand_0", "1_cand_1", "1_main", "2_main", "3_main"]
    back = {r.k: (r.item, r.candidate_item) for r in nested.renest(flat, "k", "item").collect()}
    assert back == {1: ("m", ["a", "b"]), 2: ("n", []), 3: ("o", [])}
    x = spark.createDataFrame([([1, 2, 3], [1, 0], ["f"], [" "])], "a array<int>, l array<int>, d array<string>, s array<string>")
    ids, mask = nested.padded(F.col("a"), 5, F.lit(0))
    row = x.select(nested.masked_select(F.col("a"), F.col("l")), ids, mask, nested.padded(F.col("a"), 2, F.lit(0))[1], nested.snippet_fallback(F.col("s"), F.col("d"), True)).first()
    assert list(map(list, row)) == [[1], [1, 2, 3, 0, 0], [1, 1, 1, 0, 0], [1, 1], ["f"]]


# ---- retrieval --------------------------------------------------------------------------------------------------------------
def test_bm25_against_the_formula(spark):
    docs = {1: "a b c d", 2: "a a x", 3: "a y z q", 4: "b b a", 5: "w v u", 6: "a"}
    asked = {1: "b c b", 2: "a", 3: "nothing", 4: ""}
    words = {k: v.split() for k, v in docs.items()}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    df = {w: sum(w in d for d in words.values()) for d in words.values() for w in d}
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    want = []
    for q, text in asked.items():
        score = {k: round(sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in text.split()), 6) for k, d in words.items()}
        want += [(q, k, score[k]) for k in sorted(score, key=lambda k: (-score[k], -k))[:3]]
    frame = lambda x: spark.createDataFrame(list(x.items()), "id long, x string")
    got = retrieval.bm25_top_k(frame(asked).withColumnRenamed("id", "q"), frame(docs), "q", "x", "id", "x").orderBy("q", "rank").collect()
    assert [(r.q, r.id, pytest.approx(r.score, abs=1e-6)) for r in got] == want


def test_query_text(spark):
    df = spark.createDataFrame([(None, "", "c"), ("b", "s", "c")], "best_python_code string, source_code string, code string")
    assert [r.query for r in retrieval.query_text(df).collect()] == ["c", "b"]


# ---- blocks -----------------------------------------------------------------------------------------------------------------
PY = "if x:\n  pass\ndef f(a,\n  b):\n  y=1\n  for i in y: pass\n  return y"


def test_python_blocks(spark):
    df = spark.createDataFrame([(1, PY), (2, "def ("), (3, ""), (4, None), (5, "x\x00")], "id long, code string")
    rows = {r.id: r for r in blocks.structural_rows(df, "code").collect()}
    assert rows[1].function_def == ["def f(a,"] and rows[1].assignments == ["y=1"] and rows[1].others == ["return y"] and len(rows[1].loops) == len(rows[1].conditionals) == 1
    assert rows[1].cleaned_seqs == ["def f(a,", "for i in y: pass", "if x: pass", "y=1", "return y"]
    assert rows[2].ast_ok is False and rows[2].cleaned_seqs == [] and rows[3].ast_ok is None and rows[4].cleaned_seqs is None and rows[5].ast_ok is False
    assert tuple(blocks.block_statistics(blocks.structural_rows(df, "code")).first())[:4] == (5, 2, 4, 0)
    assert blocks.parse_rate(df.filter("id < 3"), "code").first().apr == 50.0
    inner = "def f():\n  def g():\n    z = 2\n  return g"
    assert blocks.python_blocks(inner)["assignments"] == ["z = 2"] and blocks.python_blocks(inner, nested=False)["function_def"] == ["def f():"]
    assert blocks.python_statements("def f():\n  a = 1\n  return a") == (["a = 1", "return a"], True) and blocks.python_statements("x (\n y") == (["x (", "y"], False)
    assert blocks.python_tokens("a = 1 # c\n") == ["a", "=", "1"]
    with pytest.raises(NotImplementedError):
        blocks.split_blocks(F.col("code"), "ocaml")


def test_token_and_text_splitters():
    assert blocks.braced_statements("int f ( a ; b ) { x = 1 ; } y ;".split()) == ["int f ( a ; b ) { }", "x = 1 ;", "y ;"]
    py = blocks.token_statements("def f ( a ) : x = a + 1 return x if x : y ( 1 )".split(), "python")
    assert py == ["def f ( a ) :", "x = a + 1", "return x", "if x :", "y ( 1 )"]
    go = blocks.token_statements("func f ( a int ) { x := a + 1 return x }".split(), "go")
    assert go == ["func f ( a int ) { }", "x := a + 1", "return x"]
    ruby = blocks.token_statements("def f ( a ) x = a . b return x end".split(), "ruby")
    assert ruby == ["def f ( a )", "x = a . b", "return x"] and blocks.token_statements("def f x = 1 end".split(), "ruby") == ["def f x", "x = 1"]
    assert blocks.token_statements([], "go") == [] and blocks.token_statements("return".split(), "ruby") == ["return"]
    out = blocks.julia_blocks("x = 1; for i in y; z(i); end; q()")
    assert out["assignments"] == ["x = 1"] and out["others"] == ["q()"] and len(out["loops"]) == 1 and out["loops"][0].endswith("end")
    assert blocks.julia_blocks("if a; b")["conditionals"] and blocks.julia_blocks("end")["others"] == ["end"] and blocks.julia_blocks(None)["ok"] is False


# ---- ports, prompts ---------------------------------------------------------------------------------------------------------
def test_translation_repair_and_back_translation(spark):
    df = spark.createDataFrame([("1", "f()"), ("2", "g()")], "index string, source_code string")
    ask = F.concat(F.lit("to python: "), "source_code")
    good = ports.translate(df, "index", ask, ports.Doubles.echo_double)
    row = good.filter("index = '1'").first()
    assert row.valid_count == 10 and row.status == "success" and [c.temperature for c in row.translations] == [0.0] + [0.7] * 3 + [0.9] * 3 + [1.1] * 3
    bad = ports.translate(df, "index", ask, ports.Doubles.broken_double)
    assert {(r.valid_count, r.status) for r in bad.collect()} == {(0, "all_failed")}
    fixed = ports.repair(bad, "index", lambda code, error: code, ports.Doubles.echo_double, checkpoint)
    assert {(r.valid_count, r.status, len(r.translations), r.translations[-1].attempt) for r in fixed.collect()} == {(0, "repaired_success", 11, 1)}
    lost = ports.repair(bad, "index", lambda code, error: code, ports.Doubles.broken_double, checkpoint)
    assert {(r.status, len(r.translations)) for r in lost.collect()} == {("all_failed", 13)}
    back = ports.back_translate(good, "index", lambda code: code, lambda: lambda p, t, n: [["<CODE>ok</CODE>"] * n for _ in p])
    assert all(c.back_translation == "ok" for r in back.collect() for c in r.translations)
    holes = good.withColumn("translations", nested.update_each(F.col("translations"), "back_translation", lambda c: F.when(c["temperature"] > 0, "kept")))
    filled = ports.refill(holes, "index", lambda code: code, lambda: lambda p, t, n: [["just prose"] * n for _ in p]).first()
    assert [c.back_translation for c in filled.translations] == ["just prose"] + ["kept"] * 9


def test_distinct_port(spark):
    df = spark.createDataFrame([("a",), ("a",), ("bbb",), (None,)], "x string")
    vector = ports.scalar_port(ports.Doubles.length_vector_double, "array<double>")
    assert sorted((r.x or "", r.v) for r in ports.distinct_port(df, "x", "v", vector).collect()) == [("", None), ("a", [1.0, 1.0]), ("a", [1.0, 1.0]), ("bbb", [3.0, 1.0])]


def test_prompts(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(prompts.fill("{a} {{x}} {b}", a=F.lit("1"), b=F.lit(None).cast("string"))) == "1 {{x}} "
    assert get(prompts.with_shot("{shot}|{lang}", {"lua": "L"}, F.lit("lua"))) == "L|lua" and get(prompts.with_shot("{shot}|{lang}", {"lua": "L"}, F.lit("go"))) == "|go"
    layout = prompts.Layout()
    text = get(prompts.annotated(F.lit(" c "), F.array(F.lit("s"), F.lit(" ")), layout))
    assert text == layout.rule + layout.code_head + "c\n\n" + layout.trace_head + "# > s\n\n" + layout.ask
    assert layout.trace_head not in get(prompts.annotated(F.lit("c"), F.array(F.lit("s")), layout, use_trace=False))
    shots = F.array(*(F.struct(F.lit(f"c{i}").alias("code"), F.array(F.lit("t")).alias("trace"), F.lit(f"sum{i}").alias("summary")) for i in range(4)))
    full = get(prompts.completion_prompt(F.lit("x"), F.array(F.lit("t")), shots, layout))
    assert full.count("</SUMMARY>") == 3 and full.endswith("<SUMMARY>\n") and "3. " in full and "sum3" not in full
    assert "3. " not in get(prompts.completion_prompt(F.lit("x"), F.array(F.lit("t")), shots, layout, use_trace=False))
    chat = get(prompts.chat_messages(F.lit("S"), F.array(F.struct(F.lit("q").alias("question"), F.lit("a").alias("answer"))), F.lit("u")))
    assert [tuple(m) for m in chat] == [("system", "S"), ("user", "q"), ("assistant", "a"), ("user", "u")]


# ---- metrics, statistics ----------------------------------------------------------------------------------------------------
def test_bleu_and_rouge(spark):
    df = spark.createDataFrame([(1, "a b c d", ["a b c d"]), (2, "a b", ["a c", "x y z"]), (3, "", ["a"])], "id long, c string, rs array<string>")
    got = {r.id: r for r in metrics.sentence_bleu(df, "id", "c", "rs").collect()}
    assert got[1].bleu == pytest.approx(1.0) and got[1].p4 == pytest.approx(1.0) and got[2].p1 == pytest.approx(0.5) and got[3].p1 == 0.0
    score = metrics.rouge_l()
    rouge = {r.id: r.s for r in df.select("id", score("c", "rs").alias("s")).collect()}
    assert rouge == {1: pytest.approx(1.0), 2: pytest.approx(0.5), 3: 0.0}
    assert metrics.corpus_bleu(metrics.bleu_parts(df.filter("id = 1"), "id", "c", "rs")).first().bleu == pytest.approx(1.0)


def test_greedy_match(spark):
    rows = [(1, i, v, 1.0) for i, v in enumerate([[1.0, 0.0], [0.0, 2.0], [1.0, 1.0]])]
    df = spark.createDataFrame(rows, "pair long, token long, vector array<double>, weight double")
    assert tuple(metrics.greedy_match(df, df).first())[1:] == pytest.approx((1.0, 1.0, 1.0))
    two = df.filter("token < 2")
    assert tuple(metrics.greedy_match(two, df).first())[1:3] == (0.0, 0.0)
    with pytest.raises(FileNotFoundError):
        metrics.rescale(df, None, strict=True)
    assert metrics.parse_targets(["A:b:c"]) == [("A", "b:c")]
    with pytest.raises(ValueError):
        metrics.parse_targets(["A"])
    assert metrics.settings_hash("m", 9, True, "1") == "m_L9_idf_version=1"


def test_statistics(spark):
    assert stats.wilson_interval(17, 384) == pytest.approx((0.0278215749, 0.0697478261), abs=1e-9)
    for bad in ((1, 0), (5, 4), (-1, 4)):
        with pytest.raises(ValueError):
            stats.wilson_interval(*bad)
    assert stats.t_quantile(0.975, 9) == pytest.approx(2.2621571628, abs=1e-8) and stats.t_quantile(0.975, 1) == pytest.approx(12.7062047362, abs=1e-6)
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    assert tuple(stats.mean_interval(df, "v").first())[:2] == (4, 2.0)
    with pytest.raises(ValueError):
        stats.mean_interval(df.limit(1), "v")
    pairs = spark.createDataFrame([(float(d), 0.0) for d in (1, 2, -2, 3, 0)], "a double, b double")
    assert tuple(stats.signed_ranks(pairs, "a", "b").first()) == (4, 7.5, 2.5, 6)
    # published table: n = 10, one-sided 5 % critical value 10
    assert stats.signed_rank_p(10, 10, 0, "less") == pytest.approx(0.0420, abs=1e-4) and stats.signed_rank_p(10, 11, 0, "less") > 0.05
    assert stats.wilcoxon(pairs, "a", "b")["statistic"] == 2.5


def test_curves_and_tables(spark):
    rows = spark.createDataFrame([("m", 1, 0.7, 1.0), ("m", 1, 0.70001, 3.0), ("m", 2, 0.7, 5.0), ("m", 2, 0.9, 9.0)], "model string, item long, temperature double, score double")
    assert sorted(map(tuple, selection.temperature_curve(rows, [0.7]).collect())) == [("m", 0.7, 3.5, 4.0)]
    means = selection.base_vs_best(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0)], "lang string, x double"), ["x"])
    assert {r.lang: r.x for r in means.collect()} == {"a": 2.0, "b": 8.0, "AVERAGE": 5.0}
    table = metrics.comparison_table(spark.createDataFrame([("bleu", "full", 1.234), ("bleu", "woKey", 1.0)], "metric string, variant string, score double")).first()
    assert (table.full, table.woKey) == (1.23, 1.0)


# ---- records ----------------------------------------------------------------------------------------------------------------
def test_record_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"index": 1, "code": " x "}\n\nnot json\n{"index": 2, "code": "y"}\n')
    good, bad = records.good_and_bad(records.read_jsonl(spark, str(tmp_path / "a.jsonl"), "index long, code string", strict=False))
    assert sorted(r["index"] for r in good.collect()) == [1, 2] and bad.count() == 1
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(tmp_path / "a.jsonl"), "index long, code string").collect()
    (tmp_path / "i.txt").write_text("no colon here\n3:a:b\n4: c \n")
    assert [(r.row_id, r["index"], r.code) for r in records.read_indexed_lines(spark, str(tmp_path / "i.txt")).collect()] == [(1, "3", "a:b"), (2, "4", "c")]
    (tmp_path / "p.txt").write_text("7\tSummary of x\n\nplain\n")
    assert [(r.row_id, r.text) for r in records.read_predictions(spark, str(tmp_path / "p.txt")).collect()] == [(0, "of x"), (1, ""), (2, "plain")]
    (tmp_path / "f.txt").write_text("1.5\n\n 2\n")
    assert [r.value for r in records.read_floats(spark, str(tmp_path / "f.txt")).collect()] == [1.5, 2.0]
    df = spark.createDataFrame([(1, "b\nc"), (0, "ä"), (2, None)], "idx long, summary string")
    records.write_json_array(df, str(tmp_path / "arr"), "idx")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "arr").glob("part*")))[0] == {"idx": 0, "summary": "ä"}
    assert records.read_json_array(spark, str(tmp_path / "arr"), "idx long, summary string").count() == 3
    records.write_predictions(df, str(tmp_path / "pred"), str(tmp_path / "debug"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "pred").glob("part*"))) == "0\tä\n1\tb c\n2\t\n"
    records.write_indexed_lines(df, str(tmp_path / "lines"), "idx", "summary")
    assert "".join(p.read_text() for p in sorted((tmp_path / "lines").glob("part*"))) == "1:ä\n2:b c\n3:\n"
    records.write_tsv(df.filter("idx = 0"), str(tmp_path / "tsv"), bom=True)
    assert [tuple(r) for r in records.read_tsv(spark, str(tmp_path / "tsv"), "idx long, summary string").collect()] == [(0, "ä")]
    records.write_jsonl(df, str(tmp_path / "out"), ["idx"])
    assert records.read_jsonl(spark, str(tmp_path / "out"), "idx long, summary string").count() == 3
    order = spark.createDataFrame([("10",), ("9",), ("b",), ("a",)], "index string").orderBy(*records.index_order()).collect()
    assert [r["index"] for r in order] == ["9", "10", "a", "b"]
    for lang, model in (("lua", "m1"), ("r", "m2")):
        (tmp_path / "root" / lang / model).mkdir(parents=True)
        (tmp_path / "root" / lang / model / "x.jsonl").write_text('{"code": "z"}\n')
    assert sorted((r.lang, r.model) for r in records.read_template(spark, str(tmp_path / "root"), "*/*/x.jsonl", "code string").collect()) == [("lua", "m1"), ("r", "m2")]


def test_dense_row_id_over_partitions(spark):
    df = spark.range(0, 50, 1, 7).withColumnRenamed("id", "v")
    assert all(r.v == r.row_id for r in records.dense_row_id(df).collect())
