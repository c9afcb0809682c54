"""M7: a scorer in a process of its own, spoken to by lines: one process for each Python worker, kept over tasks and started anew when it fails.

A pair is scored in two steps: `SCORE ||| reference ||| ... ||| hypothesis` is answered by a line of statistics, and `EVAL ||| statistics` by the
score of the pair and that of the whole, on a line each. The separator is taken out of texts, and line ends become spaces. An answer that is no number counts as 0.
"""

from __future__ import annotations

import atexit
import os
import select
import subprocess
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " ||| "
_RUNNING: dict[tuple[str, ...], LineScorer] = {}


class Gone(Exception):
    """The process ended, or didn't answer in time."""


class LineScorer:
    """command is started at the first question. A question is asked at most `tries` times, each time of a new process; then its score is 0."""

    def __init__(self, command: tuple[str, ...], seconds: float = 60.0, tries: int = 2):
        self.command, self.seconds, self.tries = command, seconds, tries
        self.process: subprocess.Popen | None = None
        self.waiting, self.starts = b"", 0

    def _ask(self, line: str, answers: int) -> list[str]:
        if self.process is None:
            self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
            self.waiting, self.starts = b"", self.starts + 1
        try:
            self.process.stdin.write(f"{line}\n".encode())
            self.process.stdin.flush()
        except OSError as error:
            raise Gone from error
        return [self._line() for _ in range(answers)]

    def _line(self) -> str:
        until = time.monotonic() + self.seconds
        while b"\n" not in self.waiting:
            ready, _, _ = select.select([self.process.stdout], [], [], max(0, until - time.monotonic()))
            more = os.read(self.process.stdout.fileno(), 1 << 16) if ready else b""
            if not more:
                raise Gone
            self.waiting += more
        line, _, self.waiting = self.waiting.partition(b"\n")
        return line.decode("utf-8", "replace").strip()

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.wait()
            self.process.stdin.close()
            self.process.stdout.close()
            self.process = None

    def score(self, hypothesis: str, references: list[str]) -> float:
        tidy = lambda x: " ".join(x.replace("|||", "").replace("  ", " ").splitlines())
        for _ in range(self.tries):
            try:
                (statistics,) = self._ask(SEPARATOR.join(["SCORE", *map(tidy, references), tidy(hypothesis)]), 1)
                _, whole = self._ask(SEPARATOR.join(["EVAL", statistics]), 2)
            except Gone:
                self.close()
                continue
            try:
                return float(whole)
            except ValueError:
                return 0.0
        return 0.0


def running(command: tuple[str, ...], seconds: float) -> LineScorer:
    """This worker's scorer for the command."""
    if command not in _RUNNING:
        _RUNNING[command] = LineScorer(command, seconds)
        atexit.register(_RUNNING[command].close)
    return _RUNNING[command]


def line_scorer_port(command: list[str], seconds: float = 60.0) -> Callable[[Column, Column], Column]:
    """A score of (reference or array of references, hypothesis), as evaluation.local_report() and comparison_scores() take it; null counts as ''."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = running(tuple(command), seconds)
        for references, hypotheses in parts:
            rows = zip(references, hypotheses, strict=True)
            yield pd.Series([scorer.score(h or "", [r or ""] if r is None or isinstance(r, str) else [x or "" for x in r]) for r, h in rows], dtype=float)

    return lambda reference, hypothesis: run(reference, hypothesis)


#: A stand-in for tests that speaks the protocol: the share of the hypothesis' distinct words that a reference has.
DOUBLE = r"""
import sys
for line in sys.stdin:
    kind, *parts = line.rstrip("\n").split(" ||| ")
    if kind == "SCORE":
        own, known = set(parts[-1].split()), set(" ".join(parts[:-1]).split())
        print(len(own & known), len(own), flush=True)
    else:
        a, b = parts[0].split()
        score = int(a) / int(b) if int(b) else "none"
        print(score, score, sep="\n", flush=True)
"""
