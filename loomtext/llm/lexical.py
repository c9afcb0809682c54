"""Ranked lexical search: postings as a term-bucketed table, joined with the terms of items and summed by item and document.

A posting is (bucket, term, doc_id, rid, tf, n_terms); the bucket follows from the term, and the table is partitioned by it, so a search reads the
buckets of its terms alone. Every document with a term also has one posting of the empty term, which counts its terms; they give N and L.

Scores are integers: the weight of a term times the saturated frequency of it in the document. Scored postings are dealt out by document, then meet the
items that hold their term, so all matches of an item and a document are added up where they are made: a posting is moved, its matches are not. The window that ranks keeps
k rows of an item in each task before it moves any. Postings of terms that no item holds are left out as they are made, while the items' terms are
few enough to be broadcast (their number is checked); beyond that all postings are kept, and terms and matches are joined by shuffles, whose hot keys AQE splits.

Terms: A-Z lower-cased, then maximal runs of digits, a-z and characters beyond ASCII, of the whole text. A null or empty text has none, is no document of N
and is never found; an item without terms finds nothing. Rows of equal doc_id are documents of their own; rows of equal item_id (null too) are one item with the
terms of all. Equal scores are in order of doc_id, nulls last. No documents or no items give an empty result. Columns other than the named ones play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomtext.llm.common import materialize, table, trimmed
from loomtext.llm.licenses import words_of

#: Item terms, and the bytes of all of them, that may be broadcast.
MOST_BROADCAST = 200_000
MOST_BYTES = 16 << 20
#: Folders of the table of postings.
BUCKETS = 16
TOP = 50


def _postings(kept: frozenset[bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms, tfs, sizes = [], [], [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                counts = Counter(words if kept is None else filter(kept.__contains__, words))
                rows += [at] * (len(counts) + 1)
                terms.append(b"")
                terms += counts
                tfs.append(len(words))
                tfs += counts.values()
                sizes += [len(words)] * (len(counts) + 1)
            at = pa.array(rows, pa.int64())
            columns = [pa.array(terms, pa.binary()).cast(pa.string()), batch.column("doc_id").take(at), batch.column("rid").take(at), pa.array(tfs, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "rid", "tf", "n_terms"])

    return run


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, kept: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The table of postings, of all terms or of `kept`, written to the shared folder in buckets of even files."""
    rows = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"), F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("rid"))
    schema = T.StructType([T.StructField("term", T.StringType()), rows.schema["doc_id"], T.StructField("rid", T.LongType()), T.StructField("tf", T.LongType()), T.StructField("n_terms", T.LongType())])
    found = rows.mapInArrow(trimmed(_postings(kept)), schema).withColumn("bucket", bucket_of(F.col("term"), buckets))
    return materialize(found.hint("rebalance", "bucket"), "postings", ["bucket"])


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, item_id, term): each term of an item once."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    words = F.split(F.translate(F.col(f"`{text_col}`"), upper, lower), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    found = items.select(F.col(f"`{id_col}`").alias("item_id"), F.explode(words).alias("term")).filter("term <> ''").distinct()
    return found.select(bucket_of(F.col("term"), buckets).alias("bucket"), "item_id", "term")


def weighted(index: DataFrame) -> tuple[DataFrame, int, int]:
    """(bucket, term, w) of the terms that documents hold; N, the documents with a term; L, their terms."""
    counts = materialize(index.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")), "terms")
    whole = counts.filter("term = ''").first()
    n = whole["df"] if whole else 0
    w = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    return counts.filter("term <> ''").select("bucket", "term", w.alias("w")), n, whole["total"] if whole else 0


def search(items: DataFrame, docs: DataFrame, k: int = TOP, most_broadcast: int = MOST_BROADCAST, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of each item with the highest scores above 0."""
    asked = materialize(item_terms(items, item_col, item_text_col), "item-terms")
    size = asked.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    small = size["rows"] <= most_broadcast and size["bytes"] <= most_bytes
    kept = frozenset(r.term.encode() for r in asked.select("term").distinct().collect()) if small else None
    bounded = F.broadcast if small else lambda rows: rows
    index = postings(docs, kept, id_col, text_col)
    weights, n, total = weighted(index)
    scored = index.join(bounded(weights), ["bucket", "term"]).withColumn("m", F.expr(f"50 + (50 * n_terms * {n}L) div {max(total, 1)}L"))
    scored = scored.select("bucket", "term", "doc_id", "rid", F.expr("w * ((1000000000 * tf) div (1000 * tf + 20 * m))").alias("part")).filter("part > 0")
    if small:
        scored = scored.repartition("rid")
    matches = scored.join(bounded(asked), ["bucket", "term"])
    scores = matches.groupBy("item_id", "doc_id", "rid").agg(F.sum("part").alias("score"))
    by_score = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.select("item_id", F.row_number().over(by_score).alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = r"""
with d as (select doc_id, row_number() over () as rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents where text is not null),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
size as (select count(*) as docs, sum(len(terms)) as total from d where len(terms) > 0),
tokens as (select doc_id, rid, len(terms) as n, unnest(terms) as term from d),
p as (select doc_id, rid, n, term, count(*) as tf from tokens where term in (select term from i) group by all),
w as (select term, cast(floor(1000 * ln((2.0::double * docs + 2) / (2 * count(*) + 1))) as bigint) as w from p, size group by term, docs),
s as (select item_id, doc_id, rid, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + cast((50 * n::hugeint * docs) // total as bigint))))) as bigint) as score
  from i join p using (term) join w using (term), size group by all)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 50
"""
