"""Text metrics: BLEU, ROUGE-L, token-matching (BERTScore-style) scores over given token vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as t
from loomtext.functions.porter import stem
from loomtext.operators import matching

#: Keeps logarithms of zero finite.
TINY = 2.2250738585072014e-308


def ngrams(tokens: Column, n: int) -> Column:
    joined = lambda i: F.array_join(F.slice(tokens, i, n), "\x01")
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), joined)).otherwise(F.array().cast("array<string>"))


def ngram_counts(df: DataFrame, key: str, tokens: str, most: int = 4) -> DataFrame:
    """A10: (key, n, gram, count)."""
    tagged = lambda n: F.transform(ngrams(F.col(tokens), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))
    grams = F.flatten(F.array(*(tagged(n) for n in range(1, most + 1))))
    rows = df.select(key, F.explode(grams).alias("g")).select(key, "g.n", "g.gram")
    return rows.groupBy(key, "n", "gram").agg(F.count(F.lit(1)).alias("count"))


def bleu_tokens(text: Column) -> Column:
    """Lower-cased punctuation split, then NIST normalisation."""
    return t.nist_tokens(t.punct_split(F.lower(F.trim(text))))


def cased_tokens(text: Column) -> Column:
    """E4's 13a tokens: NIST normalisation that keeps the case."""
    return t.nist_tokens(text, lower=False)


def _clipped(most: int):
    """Of (candidate tokens, tokens of each reference): for n of 1 to most how many n-grams of the candidate a reference has, each as often as in the one that has it most."""

    @F.pandas_udf("array<long>")
    def correct(candidates: pd.Series, references: pd.Series) -> pd.Series:
        grams = lambda tokens, n: Counter(zip(*(tokens[i:] for i in range(n)), strict=False))

        def of(mine: list[str], theirs: list[list[str]]) -> list[int]:
            out = []
            for n in range(1, most + 1):
                own, best = grams(mine, n), Counter()
                for tokens in theirs:
                    best |= Counter({g: k for g, k in grams(tokens, n).items() if g in own})
                out.append((own & best).total())
            return out

        return pd.Series([of(list(c), [list(r) for r in rs]) for c, rs in zip(candidates, references, strict=True)], dtype=object)

    return correct


def bleu_parts(df: DataFrame, key: str, candidate: str, references: str, most: int = 4, keep: list[str] | None = None, tokens: Callable[[Column], Column] = bleu_tokens) -> DataFrame:
    """Per row the key, the columns to keep and the additive parts: testlen, reflen (the shortest reference's), guess and correct for n of 1 to most. Texts are tokenized once; nothing is shuffled."""
    keep = keep or []
    rows = df.select(key, *keep, tokens(F.col(candidate)).alias("c"), F.transform(F.col(references), lambda r: tokens(r)).alias("rs"))
    sizes = [F.size("c").alias("testlen"), F.array_min(F.transform("rs", lambda r: F.size(r))).alias("reflen")]
    rows = rows.select(key, *keep, *sizes, _clipped(most)(F.col("c"), F.col("rs")).alias("correct"))
    orders = range(1, most + 1)
    return rows.select(key, *keep, "testlen", "reflen", *(F.greatest(F.col("testlen") - (n - 1), F.lit(0)).alias(f"guess{n}") for n in orders), *(F.col("correct")[n - 1].alias(f"correct{n}") for n in orders))


def bleu_from_parts(most: int = 4) -> list[Column]:
    """E1 over columns as bleu_parts() names them: BLEU (add-one for n above 1, brevity with one added to both lengths) and the plain precisions."""
    log = None
    out = []
    for n in range(1, most + 1):
        correct, guess, add = F.col(f"correct{n}"), F.col(f"guess{n}"), int(n > 1)
        term = F.log(correct + add + F.lit(TINY)) - F.log(guess + add + F.lit(TINY))
        log = term if log is None else log + term
        out.append(F.when(guess == 0, 0.0).otherwise(F.exp(F.log(correct + F.lit(TINY)) - F.log(guess.cast("double")))).alias(f"p{n}"))
    brevity = F.least(F.lit(0.0), 1 - (F.col("reflen") + 1.0) / (F.col("testlen") + 1))
    return [F.exp(log / most + brevity).alias("bleu"), *out]


def sentence_bleu(df: DataFrame, key: str, candidate: str, references: str) -> DataFrame:
    return bleu_parts(df, key, candidate, references).select(key, *bleu_from_parts())


def mean_bleu(df: DataFrame, key: str, candidate: str, references: str) -> DataFrame:
    """E2, in percent."""
    return sentence_bleu(df, key, candidate, references).agg((F.avg("bleu") * 100).alias("bleu"))


def part_sums(most: int = 4) -> list[Column]:
    """The parts summed, for a groupBy."""
    return [F.sum(c).cast("double").alias(c) for c in ("testlen", "reflen", *(f"{k}{n}" for n in range(1, most + 1) for k in ("guess", "correct")))]


def corpus_bleu_of_sums(most: int = 4) -> Column:
    """E4 over summed parts: unsmoothed; 0 if any order has no match."""
    precisions = [F.try_divide(F.col(f"correct{n}"), F.col(f"guess{n}")) for n in range(1, most + 1)]
    log = sum((F.log(p) for p in precisions[1:]), F.log(precisions[0])) / most
    brevity = F.when(F.col("testlen") > F.col("reflen"), 0.0).otherwise(1 - F.col("reflen") / F.col("testlen"))
    zero = F.least(*(F.coalesce(p, F.lit(0.0)) for p in precisions)) == 0
    return F.when(zero, 0.0).otherwise(F.exp(log + brevity))


def corpus_bleu(parts: DataFrame, most: int = 4) -> DataFrame:
    """E4's BLEU over all rows of parts."""
    return parts.agg(*part_sums(most)).select(corpus_bleu_of_sums(most).alias("bleu"))


def _lcs(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, one bit for each token of b: a zero marks where a row of the usual table rises."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        met = row & places.get(x, 0)
        row = (row + met | row - met) & full
    return len(b) - row.bit_count()


def rouge_l(beta: float = 1.2, stemmed: bool = True):
    """E3 as a pandas UDF (candidate, references): tokens by single spaces; precision and recall each the best over references."""

    @F.pandas_udf("double")
    def score(candidate: pd.Series, references: pd.Series) -> pd.Series:
        made: dict[str, str] = {}

        def tokens(text: str) -> list[str]:
            parts = text.split(" ")
            if not stemmed:
                return parts
            for w in parts:
                if w not in made:
                    made[w] = stem(w)
            return [made[w] for w in parts]

        out = []
        for c, refs in zip(candidate, references, strict=True):
            mine = tokens(c)
            precision = recall = 0.0
            for r in refs:
                theirs = tokens(r)
                n = _lcs(theirs, mine)
                precision, recall = max(precision, n / len(mine)), max(recall, n / len(theirs))
            out.append((1 + beta**2) * precision * recall / (recall + beta**2 * precision) if precision and recall else 0.0)
        return pd.Series(out, dtype=float)

    return score


def idf_weights(sentences: DataFrame, tokens: str) -> DataFrame:
    """(token, idf): ln((n + 1) / (df + 1)) over the distinct tokens of n sentences; one that none has weighs ln(n + 1)."""
    n = sentences.agg(F.count(F.lit(1)).alias("n"))
    df = sentences.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)).alias("idf"))  # one row


def greedy_match(hypothesis: DataFrame, reference: DataFrame) -> DataFrame:
    """E5: (pair, p, r, f) from token rows (pair, token, vector, weight): each token's best cosine on the other side, weighted.

    A sentence whose only tokens are the two special ones scores 0; a NaN F is 0. Cosines are worked out by matching.best_cosines(), whose rows are tokens.
    """
    best = matching.best_cosines(hypothesis, reference)

    def side(which: str, name: str) -> DataFrame:
        rows = best.filter(F.col("side") == which)
        return rows.groupBy("pair").agg(F.try_divide(F.sum(F.col("s") * F.col("weight")), F.sum("weight")).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))

    both = side("hypothesis", "p").join(side("reference", "r"), "pair")
    f = F.nanvl(F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)), F.lit(0.0))
    bare = (F.col("n_p") == 2) | (F.col("n_r") == 2)
    return both.select("pair", F.when(bare, 0.0).otherwise(F.col("p")).alias("p"), F.when(bare, 0.0).otherwise(F.col("r")).alias("r"), f.alias("f"))


def rescale(scores: DataFrame, baseline: DataFrame | None, strict: bool = False) -> DataFrame:
    """(x - b) / (1 - b) for p, r, f with a one-row baseline (p, r, f); without one, scores as they are, or an error if strict."""
    if baseline is None:
        if strict:
            raise FileNotFoundError("no baseline")
        return scores
    b = baseline.select(*(F.col(c).alias(f"b_{c}") for c in "prf")).limit(1)
    rows = scores.crossJoin(F.broadcast(b))
    return rows.withColumns({c: (F.col(c) - F.col(f"b_{c}")) / (1 - F.col(f"b_{c}")) for c in "prf"}).drop("b_p", "b_r", "b_f")


def settings_hash(model: str, layers: int, idf: bool, version: str, custom_baseline: bool = False, rescaled: bool = False, fast_tokenizer: bool = False) -> str:
    """A line that names the settings of a score."""
    tail = ("-custom-rescaled" if custom_baseline else "-rescaled") if rescaled else ""
    return f"{model}_L{layers}{'_idf' if idf else '_no-idf'}_version={version}{tail}{'_fast-tokenizer' if fast_tokenizer else ''}"


def similarity_cells(hypothesis: DataFrame, reference: DataFrame) -> DataFrame:
    """(pair, i, j, similarity), the cells of a heat map; null for a zero vector."""
    return matching.cosine_cells(hypothesis.withColumn("weight", F.lit(1.0)), reference.withColumn("weight", F.lit(1.0)))


def comparison_table(scores: DataFrame) -> DataFrame:
    """Scores (metric, variant, score) as one row a metric and one column a variant."""
    return scores.groupBy("metric").pivot("variant").agg(F.round(F.avg("score"), 2))


def alignment_sample(rows: DataFrame, key: str = "uid", wanted: int = 3, width: int = 60) -> DataFrame:
    """Reference and hypotheses, cut short, at the wanted id, or the first if there is no such id."""
    nearest = rows.agg(F.coalesce(F.min(F.when(F.col(key) == wanted, F.col(key))), F.min(key)).alias("_k"))
    kept = rows.join(F.broadcast(nearest), F.col(key) == F.col("_k")).drop("_k")
    return kept.select(key, *(F.left(F.col(c), F.lit(width)).alias(c) for c in rows.columns if c != key))


def parse_targets(specs: list[str]) -> list[tuple[str, str]]:
    """`Name:template`, split at the first colon."""
    out = []
    for spec in specs:
        name, colon, template = spec.partition(":")
        if not colon:
            raise ValueError(f"{spec!r} is not Name:template")
        out.append((name, template))
    return out
