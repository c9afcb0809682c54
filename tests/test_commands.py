"""The command line of stages without models, over files."""

import json
import shlex
import sys

import pytest

from loomtext.plans import commands, line_scorer


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(str, rows)) + "\n")
    return str(path)


def run(spark, *arguments):
    return commands.main(list(map(str, arguments)), spark)


def test_statistics(spark, tmp_path, capsys):
    a, b = lines(tmp_path / "a", [1.0, 2.5, "", 3.0, 4.0, 9.5]), lines(tmp_path / "b", [2.0, 2.0, 5.0, 4.0, 1.0])
    found = run(spark, "wilcoxon", "--file_a", a, "--file_b", b)
    assert (found["n"], found["statistic"]) == (5, 5.0) and json.loads(capsys.readouterr().out) == found
    with pytest.raises(ValueError):
        run(spark, "wilcoxon", "--file_a", a, "--file_b", lines(tmp_path / "c", [1]))
    found = commands.main(["wilson", "--k", "17", "--N", "384"])
    assert found["lower_pct"] == "2.78%" and round(found["upper"], 4) == 0.0697
    found = run(spark, "mean_ci", "--file", b)
    assert found["mean"] == 2.8 and found["half_width"] == pytest.approx(2.0403, abs=1e-3)


def test_retrieval_over_files(spark, tmp_path):
    corpus = [{"code": f'def f{i}():\n    """says {w}"""\n    return {w}', "docstring": f"says {w}", "docstring_tokens": ["says", w, "."], "repo": "r", "path": "p", "func_name": f"f{i}"} for i, w in enumerate(["one", "two", "three"])]
    corpus[2]["docstring_tokens"] = []
    train = lines(tmp_path / "train.jsonl", map(json.dumps, corpus))
    lines(tmp_path / "lua" / "q.jsonl", [json.dumps({"index": "7", "best_python_code": "return three", "code": "old"}), json.dumps({"index": "8", "best_python_code": "", "code": "two two"})])
    out = f"{tmp_path}/{{lang}}/out"
    assert run(spark, "retrieve", "--train_file", train, "--test_template", f"{tmp_path}/{{lang}}/q.jsonl", "--output_template", out, "--langs", "lua", "r", "--top_k", 2) == {"written": [f"{tmp_path}/lua/out"]}
    got = {r["index"]: r for r in spark.read.json(f"{tmp_path}/lua/out").collect()}
    assert got["7"].code == "return three" and got["8"].code == "two two" and all(len(r.retrieved_candidates) == 2 for r in got.values())
    best = got["7"].retrieved_candidates[0]
    assert (best.idx, best.summary, best.docstring, best.func_name, best.language) == (2, "says three", "says three", "f2", "python") and '"""' not in best.code and best.bm25_score > 0
    assert got["8"].retrieved_candidates[0].summary == "says two."


def test_evaluation_over_files(spark, tmp_path):
    for lang in ("lua", "r"):
        lines(tmp_path / f"{lang}.ref", ["adds two numbers", "prints it all"])
        lines(tmp_path / f"{lang}.hyp", ["adds two numbers", "prints it none"])
    command = shlex.join([sys.executable, "-u", "-c", line_scorer.DOUBLE])
    found = run(spark, "evaluate", "--ref_template", f"{tmp_path}/{{lang}}.ref", "--hyp_template", f"{tmp_path}/{{lang}}.hyp", "--langs", "lua", "r", "--meteor_command", command)
    assert found["lua"] == found["r"] and set(found["lua"]) == {"BLEU", "ROUGE-L", "METEOR"} and found["lua"]["METEOR"] == 83.33


def test_comparison_over_files(spark, tmp_path):
    lines(tmp_path / "lua_final.tsv", ["index\tsummary", "0\tadds two numbers and more", "2\tprints it all once again", "9\tnever predicted"])
    lines(tmp_path / "res" / "m" / "lua" / "lua_full.txt", ["0\tadds two numbers and more", "1\tx", "2\tprints it all once again"])
    lines(tmp_path / "res" / "m" / "lua" / "lua_bare.txt", ["0\tno", "1\tx", "2\tprints it all once more"])
    found = run(spark, "compare", "--results_root", tmp_path / "res", "--ref_root", tmp_path, "--models", "m", "other", "--langs", "lua", "r", "--targets", "Full:{lang}_full.txt", "Bare:{lang}_bare.txt", "None:{lang}_none.txt")
    assert set(found) == {"m"} and set(found["m"]) == {"lua"} and found["m"]["lua"]["BLEU"]["Full"] == 100.0 and found["m"]["lua"]["ROUGE-L"]["Bare"] < 60 and set(found["m"]["lua"]["BLEU"]) == {"Full", "Bare"}
