"""The select stage over files, and retrieval to summaries, with stand-ins for the models."""

import json

import pytest
from pyspark.sql import functions as F

from loomtext.plans import prompts, select_run, summary_run


def same_length():
    return lambda a, b: [1.0 if len(x) == len(y) else 0.5 for x, y in zip(a, b, strict=True)]


def candidate(code, status, bt, temperature=0.0):
    return {"code": code, "temperature": temperature, "raw_output": code, "status": status, "error": None, "repaired": False, "attempt": 0, "back_translation": bt, "hybrid_score": None}


RECORDS = [
    {"index": "1", "code": "a b c d e", "translations": [candidate("x", "valid", "a b c d f"), candidate("y", "repaired_success", "a b c d e"), candidate("z", "invalid", "a b c d e")], "valid_count": 2, "status": "success"},
    {"index": "2", "source_code": "p q", "translations": [candidate("only", "invalid", "p q")], "valid_count": 0, "status": "all_failed"},
    {"index": "3", "code": "none", "translations": [], "valid_count": 0, "status": "all_failed"},
    {"index": "4", "code": "q r s t", "translations": [candidate("hole", "valid", ""), candidate("late", "success", "q r s t")], "valid_count": 2, "status": "success"},
]


def test_the_select_stage_over_files(spark, tmp_path):
    folder = tmp_path / "lua" / "trans_qwen3th"
    folder.mkdir(parents=True)
    (folder / "in.jsonl").write_text("\n".join(map(json.dumps, RECORDS)))
    (tmp_path / "r" / "trans_qwen3th").mkdir(parents=True)
    (tmp_path / "r" / "trans_qwen3th" / "in.jsonl").write_text(json.dumps(RECORDS[1]))  # nothing to score
    out = f"{tmp_path}/{{lang}}/trans_{{model}}/best_B{{wb}}_S{{ws}}"
    n = select_run.run(spark, f"{tmp_path}/{{lang}}/trans_{{model}}/in.jsonl", out, same_length, ["/m/Qwen2.5", "/m/other"], ["lua", "r"], [(0.5, 0.5), (0.0, 1.0)])
    assert n == 2  # one source, two weights
    got = {r["index"]: r for r in spark.read.json(f"{folder}/best_B0.5_S0.5").collect()}
    assert {i: r.best_python_code for i, r in got.items()} == {"1": "y", "2": "only", "3": None, "4": "late"}
    assert {i: (r.best_candidate_info["index"], r.best_candidate_info.status) for i, r in got.items()} == {"1": (1, "repaired_success"), "2": (0, "invalid"), "3": (-1, "failed"), "4": (1, "success")}
    assert got["1"].best_score_hybrid == 1.0 and got["1"].translations[0].scores.bleu == pytest.approx((4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25)
    assert got["1"].translations[2].scores is None and [c.code for c in got["1"].translations] == ["x", "y", "z"]
    assert got["4"].translations[0].hybrid_score is None
    other = {r["index"]: r for r in spark.read.json(f"{folder}/best_B0.0_S1.0").collect()}
    assert other["1"].best_python_code == "x"  # equal scores: the first


def test_the_select_stage_needs_as_many_weights_of_either_kind(capsys):
    with pytest.raises(SystemExit):
        select_run.main(same_length, ["in", "out", "--models", "m", "--langs", "lua", "--bleu_weights", "0.1", "0.2"])
    assert "weights" in capsys.readouterr().err


def test_from_queries_to_summaries(spark):
    corpus = spark.createDataFrame([(i, f"w{i} common", f"does {i}") for i in range(6)], "id long, code string, docs string")
    queries = spark.createDataFrame([(1, "w3 w4", ["w3", " "]), (2, "nothing here", None)], "q long, text string, trace array<string>")
    rows = summary_run.with_shots(queries, corpus, "q", "text", "id", "code", ["id", "code", "docs"], k=2)
    found = {r.q: [c.id for c in r.retrieved_candidates] for r in rows.collect()}
    assert sorted(found[1]) == [3, 4] and found[2] == [5, 4]
    layout = prompts.Layout()
    whole = {r.q: r.prompt for r in summary_run.prompted(rows, "text", "trace", "code", None, "docs", layout).collect()}
    assert "# > w3\n" in whole[1] and "does 3" in whole[1] and "# > nothing here" in whole[2]
    bare = {r.q: r.prompt for r in summary_run.prompted(rows, "text", "trace", "code", None, "docs", layout, use_trace=False, use_shots=False).collect()}
    assert "# > " not in bare[1] and "does" not in bare[1]
    stand_in = lambda: lambda asked, temperature, n: [[f"x <SUMMARY># {len(p)} </SUMMARY>"] for p in asked]
    made = summary_run.summarised(summary_run.prompted(rows, "text", "trace", "code", None, "docs", layout), "q", stand_in)
    assert {r.q: r.summary.strip() for r in made.collect()} == {q: str(len(p)) for q, p in whole.items()}
    assert made.filter(F.col("raw_output").isNull()).count() == 0
