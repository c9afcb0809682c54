"""BM25 retrieval through an inverted index: queries meet documents only on tokens that they share, and blocks of postings only where they can matter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomtext.functions import text as t
from loomtext.session import stored

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Folders of a table of postings, and blocks of a token by impact.
BUCKETS, LEVELS = 16, 64
#: More than sums in another order can differ by, and than scores are rounded by.
SLACK = 1e-5
#: Rows of (query, token) that may be broadcast.
MOST_BROADCAST = 500_000


def query_text(df: DataFrame, names: tuple = ("best_python_code", "source_code", "code")) -> DataFrame:
    """B2: df with `query`, the first of the columns that isn't null or empty, without docstrings."""
    have = [F.nullif(F.col(c), F.lit("")) for c in names if c in df.columns]
    return df.withColumn("query", t.strip_docstrings(F.coalesce(*have, F.lit("")), F.lit(None).cast("string")))


def clean_corpus(df: DataFrame, code: str = "code", docstring: str = "docstring") -> DataFrame:
    """B1."""
    return df.withColumn(code, t.strip_docstrings(F.coalesce(code, F.lit("")), F.col(docstring)))


def postings(corpus: DataFrame, key: str, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """(token, key, tf, dl), case-sensitive; of wanted tokens alone, if given, before anything is shuffled; those are dealt out by key."""
    tokens = corpus.select(key, t.words(F.col(text)).alias("w"))
    rows = tokens.select(key, F.size("w").alias("dl"), F.explode("w").alias("token"))
    if wanted is not None:
        rows = rows.join(wanted, "token", "left_semi").repartition(key)
    return rows.groupBy("token", key).agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def vocabulary(corpus: DataFrame, text: str) -> DataFrame:
    """(token, df, total) in one pass without postings: how many documents have a token; the null token counts all documents and, in total, all their words."""
    tokens = corpus.select(t.words(F.col(text)).alias("w"))
    one = lambda token, total: F.struct(token.alias("token"), total.cast("long").alias("total"))
    rows = tokens.select(F.explode(F.array_append(F.transform(F.array_distinct("w"), lambda x: one(x, F.lit(0))), one(F.lit(None).cast("string"), F.size("w")))).alias("r"))
    return rows.groupBy("r.token").agg(F.count(F.lit(1)).alias("df"), F.sum("r.total").alias("total"))


def idf(words: DataFrame, n: int) -> DataFrame:
    """(token, df, idf) of a vocabulary() of n documents: ln(n - df + 0.5) - ln(df + 0.5); where negative, EPSILON times the mean over the vocabulary."""
    raw = words.filter("token is not null").select("token", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))  # one row


def _bounded(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= MOST_BROADCAST else rows


def asked_tokens(queries: DataFrame, words: DataFrame, n: int, query_key: str, query: str) -> DataFrame:
    """(query_key, token, w): for each distinct token of a query that the corpus has, its idf times its count in the query."""
    asked = queries.select(query_key, F.explode(t.words(F.col(query))).alias("token")).groupBy(query_key, "token").agg(F.count(F.lit(1)).alias("qf"))
    return asked.join(idf(words, n), "token").select(query_key, "token", (F.col("qf") * F.col("idf")).alias("w"))


def _impact(mean: float) -> Column:
    """What a posting's document scores for a token of weight 1; below K1 + 1."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))


def bm25_scores(queries: DataFrame, corpus: DataFrame, query_key: str, query: str, key: str, text: str) -> DataFrame:
    """(query_key, key, score) of all documents that share a token with a query; a repeated query token counts repeatedly.

    The corpus is read twice: for its vocabulary, and for the queries' tokens alone, which are dealt out by document. Postings, matches and sums are then
    made where they are, so matches, which are many for each posting, never move. What is looked up per query token is broadcast if it is at most MOST_BROADCAST rows;
    beyond that matches come from a join by token, in which a token that a large share of the documents has is split by Spark's skew handling.
    """
    words = stored(vocabulary(corpus, text), "vocabulary")
    n, mean = _size(words)
    asked = stored(asked_tokens(queries, words, n, query_key, query), "asked")
    return _scores(corpus, asked, asked.count(), mean, query_key, key, text)


def _scores(corpus: DataFrame, asked: DataFrame, rows: int, mean: float, query_key: str, key: str, text: str) -> DataFrame:
    found = postings(corpus, key, text, _bounded(asked.select("token").distinct(), rows)).join(_bounded(asked, rows), "token")
    return found.groupBy(query_key, key).agg(F.sum(F.col("w") * _impact(mean)).alias("score"))


def _size(words: DataFrame) -> tuple[int, float]:
    """Documents of a vocabulary, and their mean number of words."""
    size = words.filter("token is null").first()
    return (size["df"], size["total"] / size["df"]) if size else (0, 0.0)


@dataclass
class Index:
    """Postings (bucket, token, level, key, impact) in folders by bucket; a level of a token is a block of postings of like impact. blocks: (bucket, token, level, n, most), most being the greatest impact."""

    postings: DataFrame
    blocks: DataFrame


def build_index(corpus: DataFrame, key: str, text: str, mean: float, wanted: DataFrame | None = None) -> Index:
    rows = postings(corpus, key, text, wanted).select(F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("bucket"), "token", F.col(key).alias("key"), _impact(mean).alias("impact"))
    rows = rows.select("bucket", "token", F.floor(F.col("impact") * LEVELS / (K1 + 1)).cast("int").alias("level"), "key", "impact")
    found = stored(rows.hint("rebalance", "bucket"), "postings", ["bucket"])
    blocks = found.groupBy("bucket", "token", "level").agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("most"))
    return Index(found, stored(blocks, "blocks"))


def _whole(index: Index, asked: DataFrame, small: bool, pairs: DataFrame) -> DataFrame:
    """(query, key, score): whole scores of pairs (query, key), by looking up the documents' postings."""
    wanted = F.broadcast(pairs) if pairs.count() <= MOST_BROADCAST else pairs
    found = index.postings.join(wanted, "key").join(F.broadcast(asked) if small else asked, ["query", "token"])
    return found.groupBy("query", "key").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))


def candidates(index: Index, asked: DataFrame, k: int) -> tuple[DataFrame, bool]:
    """(query, key) of all documents that may be among the k best of a query, for asked (query, token, w) with weights above 0; and whether there are few blocks.

    The documents in the blocks of greatest impact of each token are scored; the k-th best of them is a threshold that the k-th best score reaches. Of a query's tokens,
    those whose greatest scores together stay below it cannot lift a document over it alone, so blocks of the others are enough to find candidates; and of
    these, blocks that stay below it even with the greatest score of every other token are left out. What a document may still get from blocks that were not
    read is known by token, so only those that could reach the threshold are candidates.
    """
    block = stored(asked.join(index.blocks, "token").withColumn("best", F.col("w") * F.col("most")), "asked-blocks")
    small = block.count() <= MOST_BROADCAST
    bounded = F.broadcast if small else lambda rows: rows
    at = ["bucket", "token", "level"]
    above = F.sum("n").over(W.partitionBy("query", "token").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    seeds = block.withColumn("above", above).filter(F.col("above") < k).select("query", *at)
    seeds = stored(index.postings.join(bounded(seeds), at).select("query", "key").distinct(), "seeds")
    kth = _whole(index, asked, small, seeds).withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("r") <= k)
    kth = kth.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found"))
    least = stored(kth.select("query", F.when(F.col("found") == k, F.col("least") - SLACK).otherwise(0.0).alias("least")), "thresholds")

    token = block.groupBy("query", "token").agg(F.max("best").alias("top")).join(bounded(least), "query")
    token = token.withColumn("below", F.sum("top").over(W.partitionBy("query").orderBy("top", "token").rowsBetween(W.unboundedPreceding, W.currentRow)))
    token = token.withColumn("all", F.sum("top").over(W.partitionBy("query")))
    block = block.join(bounded(token), ["query", "token"])
    block = block.withColumn("read", (F.col("below") >= F.col("least")) & (F.col("best") + F.col("all") - F.col("top") >= F.col("least")))
    rest = F.coalesce(F.max(F.when(~F.col("read"), F.col("best"))).over(W.partitionBy("query", "token")), F.lit(0.0))
    block = stored(block.withColumn("rest", rest).select("query", *at, "w", "read", "rest", "least"), "planned-blocks")
    unread = block.select("query", "token", "rest").distinct().groupBy("query").agg(F.sum("rest").alias("unread"))
    part = index.postings.join(bounded(block.filter("read").drop("read")), at)
    part = part.groupBy("query", "key").agg(F.sum(F.col("w") * F.col("impact")).alias("s"), F.sum("rest").alias("known"), F.first("least").alias("least"))
    found = part.join(bounded(unread), "query").filter(F.col("s") + F.col("unread") - F.col("known") >= F.col("least"))
    return stored(found.select("query", "key"), "candidates"), small


def pruned_scores(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query, key, score) of the candidates."""
    found, small = candidates(index, asked, k)
    return _whole(index, asked, small, found)


def bm25_top_k(queries: DataFrame, corpus: DataFrame, query_key: str, query: str, key: str, text: str, k: int = 3, pruned: bool = False) -> DataFrame:
    """Always k rows a query (as long as there are k documents), by score, then the larger key; documents without a shared token score 0.

    `pruned` looks for candidates in blocks of postings first, which pays for queries of a few tokens: for those of dozens the greatest scores of common tokens add up to more than
    any threshold. Where a weight isn't above 0 (small corpora whose tokens are in most documents), all are scored.
    """
    words = stored(vocabulary(corpus, text), "vocabulary")
    n, mean = _size(words)
    asked = stored(asked_tokens(queries, words, n, query_key, query), "asked")
    told = asked.agg(F.count(F.lit(1)).alias("rows"), F.min("w").alias("least")).first()
    if pruned and told["rows"] and told["least"] > 0:
        index = build_index(corpus, key, text, mean, _bounded(asked.select("token").distinct(), told["rows"]))
        scores = pruned_scores(index, asked.withColumnRenamed(query_key, "query"), k).select(F.col("query").alias(query_key), F.col("key").alias(key), "score")
    else:
        scores = _scores(corpus, asked, told["rows"], mean, query_key, key, text)
    scores = scores.withColumn("score", F.round("score", 6))
    window = W.partitionBy(query_key).orderBy(F.desc("score"), F.desc(key))
    best = lambda rows: rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    top = stored(best(scores), "top")
    hits = top.filter("score > 0").groupBy(query_key).agg(F.count(F.lit(1)).alias("hits"))
    short = stored(queries.select(query_key).join(hits, query_key, "left").filter(F.coalesce("hits", F.lit(0)) < k).select(query_key), "short")
    if not short.limit(1).count():
        return top
    return best(top.drop("rank").unionByName(_zeros(short, scores, corpus, query_key, key, k)))


def _zeros(short: DataFrame, scores: DataFrame, corpus: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """For each query of short the k largest keys without a score, with score 0.

    A query here has fewer than k documents above 0, so all that share a token with it were scored, and they are few. They are taken out of the corpus' largest keys, of which
    more are asked for until every query has k left, or there are no more.
    """
    matched = stored(scores.join(short, query_key, "left_semi").select(query_key, key), "matched")
    asked, wanted, there = short.count(), 2 * k, corpus.count()
    while True:
        largest = stored(corpus.select(key).orderBy(F.desc(key)).limit(wanted), "largest")
        pairs = short.crossJoin(F.broadcast(largest)).join(matched, [query_key, key], "left_anti")  # with `wanted` keys, a few times k
        free = pairs.withColumn("r", F.row_number().over(W.partitionBy(query_key).orderBy(F.desc(key)))).filter(F.col("r") <= k).drop("r")
        free = stored(free.withColumn("score", F.lit(0.0)), "zeros")
        if wanted >= there or free.count() >= asked * k:
            return free
        wanted *= 4


def candidate_structs(top: DataFrame, corpus: DataFrame, query_key: str, key: str, fields: list[str]) -> DataFrame:
    """Per query the ranked candidates as an array of structs of the corpus fields with bm25_score."""
    rows = top.join(corpus.select(key, *[f for f in fields if f != key]), key)
    item = F.struct("rank", *fields, F.col("score").alias("bm25_score"))
    ordered = F.array_sort(F.collect_list(item))
    return rows.groupBy(query_key).agg(ordered.alias("retrieved_candidates"))


def cosine(a, b):
    """Cosine of two arrays of numbers; null for a zero vector."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
