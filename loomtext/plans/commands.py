"""Command line of the stages that need no model: `python -m loomtext.plans.commands NAME ...`; results are printed as JSON."""

from __future__ import annotations

import argparse
import json
import shlex

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomtext.operators import evaluation, metrics, stats
from loomtext.plans import line_scorer, retrieve_run
from loomtext.session import session
from loomtext.sources import records


def wilcoxon(spark: SparkSession, given: argparse.Namespace) -> dict:
    """Two files of numbers, paired by line."""
    a, b = (records.dense_row_id(records.read_floats(spark, path)).withColumnRenamed("value", name) for path, name in ((given.file_a, "a"), (given.file_b, "b")))
    sizes = (a.count(), b.count())
    if sizes[0] != sizes[1]:
        raise ValueError(f"samples of {sizes[0]} and {sizes[1]} numbers aren't pairs")
    found = stats.wilcoxon(a.join(b, "row_id"), "a", "b", given.alt)
    return {"n": sizes[0], "statistic": found["statistic"], "p_value": found["p"], "alternative": given.alt}


def wilson(spark: SparkSession | None, given: argparse.Namespace) -> dict:
    low, high = stats.wilson_interval(given.k, given.N, given.conf)
    return {"k": given.k, "N": given.N, "p_hat": given.k / given.N, "confidence": given.conf, "lower": low, "upper": high, "lower_pct": f"{low * 100:.2f}%", "upper_pct": f"{high * 100:.2f}%"}


def mean_ci(spark: SparkSession, given: argparse.Namespace) -> dict:
    row = stats.mean_interval(records.read_floats(spark, given.file), "value", given.conf).first()
    return {"n": row.n, "mean": row["mean"], "half_width": row.upper - row["mean"], "lower": row.lower, "upper": row.upper, "confidence": given.conf}


def retrieve(spark: SparkSession, given: argparse.Namespace) -> dict:
    return {"written": retrieve_run.run(spark, given.train_file, given.test_template, given.output_template, given.langs, given.top_k)}


def evaluate(spark: SparkSession, given: argparse.Namespace) -> dict:
    """By language the local report over files of lines."""
    meteor = line_scorer.line_scorer_port(shlex.split(given.meteor_command)) if given.meteor_command else None
    out = {}
    for lang in given.langs:
        lines = lambda path: records.dense_row_id(spark.read.text(path)).withColumnRenamed("value", "text")
        pairs = evaluation.line_pairs(lines(given.ref_template.format(lang=lang)), lines(given.hyp_template.format(lang=lang)))
        out[lang] = {r.metric: r.score for r in evaluation.local_report(pairs, meteor).collect()}
    return out


def compare(spark: SparkSession, given: argparse.Namespace) -> dict:
    """By model and language the scores of every variant whose predictions exist, over the references that all of them have."""
    hadoop, out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, {}
    exists = lambda path: hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(path))
    for model in given.models:
        for lang in given.langs:
            reference = f"{given.ref_root}/{lang}_final.tsv"
            files = {name: f"{given.results_root}/{model}/{lang}/{template.format(lang=lang)}" for name, template in metrics.parse_targets(given.targets)}
            files = {name: path for name, path in files.items() if exists(path)}
            if not files or not exists(reference):
                continue
            references = records.read_tsv(spark, reference, "index long, summary string").select(F.col("index").alias("uid"), "summary")
            report = evaluation.comparison_report(references, {name: records.read_predictions(spark, path) for name, path in files.items()})
            out.setdefault(model, {})[lang] = {r.metric: {name: r[name] for name in files} for r in report.collect()}
    return out


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(description=__doc__)
    commands = made.add_subparsers(dest="command", required=True)

    def command(run, **arguments: dict) -> None:
        sub = commands.add_parser(run.__name__, help=run.__doc__)
        sub.set_defaults(run=run)
        for name, options in arguments.items():
            sub.add_argument(f"--{name}", **options)

    path, several, share = {"required": True}, {"nargs": "+", "required": True}, {"type": float, "default": 0.95}
    command(wilcoxon, file_a=path, file_b=path, alt={"default": "two-sided", "choices": ["two-sided", "less", "greater"]})
    command(wilson, k={"type": int, "required": True}, N={"type": int, "required": True}, conf=share)
    command(mean_ci, file=path, conf=share)
    command(retrieve, train_file=path, test_template=path, output_template=path, langs=several, top_k={"type": int, "default": 3})
    command(evaluate, ref_template=path, hyp_template=path, langs=several, meteor_command={"default": ""})
    command(compare, results_root=path, ref_root=path, models=several, langs=several, targets=several)
    return made


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    given = parser().parse_args(arguments)
    found = given.run(spark or (None if given.run is wilson else session()), given)
    print(json.dumps(found, indent=2, ensure_ascii=False))
    return found


if __name__ == "__main__":
    main()
