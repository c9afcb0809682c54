"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame and SQL functions alone.

A text's paragraphs, cut on at the ends of sentences, are hashed to digests. A sketch has blocks of cells in three parts; the first bits of
a digest name its block, its hash a cell of each part, and a cell holds the number, the XOR of the digests and the XOR of their check
values. Sketches are sized by the number of digests, about 16 a block, so work is in proportion to the text. The fingerprint is the
sketch, written out: <digests>:<level>:<cells>, with 2**level blocks, cells joined by commas, each n/digests/checks in hexadecimal, or empty.

Two fingerprints are brought to the smaller one's level by adding blocks, subtracted cell by cell, which cancels what they share, and peeled:
cells with one digest give it up, and it is taken out of its other cells, round by round, until all are empty. What is recovered are
the digests of either side alone; their number gives the likeness, 1 - differing / (digests of both). Where peeling
stops early, the block's digests are sketched anew in more blocks (one side's put in, the other's taken out, which is both sketches subtracted), then with twice the cells and other hashes each time until it succeeds
(64 times at most; a block of equal size fails once in 10,000 times at the eighth, so the null that would follow has not been seen).

Null and blank texts have no digests; two of them have likeness 1. Repeats within a text count once, and order doesn't. Equal
texts have equal fingerprints. Rows with equal ids follow each other in the order of their texts; null ids come last; the row after
the last is the first, for a single row itself. A very long text is sketched whole. An empty table gives an empty result. Other columns are dropped, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomtext.llm.common import table

#: Cells in each of a block's three parts, digests a block, and digests of both sides a block where a block is sketched anew.
THIRD = 8
DIGESTS = 16
AGAIN = 8
RETRIES = 64
#: Parts grow to THIRD << MOST_DOUBLED cells.
MOST_DOUBLED = 6
BUCKET_BYTES = 4 << 20
MOST_BUCKETS = 20_000
#: The look ahead changes nothing but the time: what isn't white space is passed over at once.
UNITS = r"(?=\\s)(?:(?<=[.!?])\\s+|\\n+)"
_ZERO = "named_struct('n', 0, 'k', 0L, 'h', 0L)"


def _let(value: str, name: str, body: str) -> str:
    # an aggregate's last step hands its result on as it is; transform would copy it, and all that it holds, at every level
    return f"aggregate(array(), {value}, (a0, x0) -> a0, {name} -> {body})"


def units_sql(text: str) -> str:
    """The distinct digests of a text's paragraphs and sentences."""
    return f"array_distinct(transform(filter(split(coalesce({text}, ''), '{UNITS}'), p -> p rlike '[^\\\\s]'), p -> xxhash64(p)))"


def _level(n: str, each: int) -> str:
    """The bits that deal n digests to blocks of about `each`."""
    return f"cast(ceil(log2(greatest({n}, {each}) / {each}D)) as int)"


def _first_bits(key: str, level: str) -> str:
    return f"cast(shiftrightunsigned(shiftrightunsigned({key}, 1), 63 - {level}) as int)"


def _dealt(digests: str, level: str, block: str) -> str:
    """An array of 2**level arrays of the digests u by their block (of u and w.l, the level); dealt in two steps, for the sake of long texts."""
    inner = f"transform(sequence(shiftleft(i, w.l2), shiftleft(i + 1, w.l2) - 1), j -> filter(f, u -> {block} = j))"
    outer = f"flatten(transform(sequence(0, shiftleft(1, w.l - w.l2) - 1), i -> {_let(f'filter(w.d, u -> shiftright({block}, w.l2) = i)', 'f', inner)}))"
    return _let(f"named_struct('d', {digests}, 'l', {level}, 'l2', {level} - {level} div 2)", "w", f"if(w.l = 0, array(w.d), {outer})")


def _places(u: str, third: str, seed: str, body: str) -> str:
    """body with a.p, the hash of a digest, bound, and its cell in each part as {0}, {1}, {2}."""
    cells = [f"cast(shiftrightunsigned(p, {20 * part}) & ({third} - 1) as int)" for part in range(3)]
    return _let(f"xxhash64({u}, {seed})", "p", body.format(*cells))


def _placed(digests: str, third: str, seed: str, digest: str = "u", sign: str = "1", block: str = "0") -> str:
    """Digests u with their sign s, block q, check value h and cell in each part."""
    return f"transform({digests}, u -> {_places(digest, third, seed, f"named_struct('s', {sign}, 'q', {block}, 'u', {digest}, 'h', xxhash64({digest}, 99), 'a', {{0}}, 'b', {{1}}, 'c', {{2}})")})"


def cells_sql(digests: str, third: str, seed: str) -> str:
    """The cells (n, k, h) of one block with an array of digests."""
    cell = f"aggregate(z, {_ZERO}, (s, x) -> if(x.{{0}} = i, named_struct('n', s.n + 1, 'k', s.k ^ x.u, 'h', s.h ^ x.h), s))"
    parts = ", ".join(f"transform(sequence(0, {third} - 1), i -> {cell.format(part)})" for part in "abc")
    return _let(_placed(digests, third, seed), "z", f"concat({parts})")


def difference_sql(placed: str) -> str:
    """The cells (p, i, n, k, h), place i of part p, of a block that placed digests are put in or, by their sign, taken out of: both sides' sketches, subtracted. Cells without a digest are left out."""
    held = "named_struct('p', {0}, 'i', i, 'n', aggregate(q, 0, (s, x) -> s + x.s), 'k', aggregate(q, 0L, (s, x) -> s ^ x.u), 'h', aggregate(q, 0L, (s, x) -> s ^ x.h))"
    parts = ", ".join(f"transform(array_distinct(transform(z, x -> x.{part})), i -> {_let(f'filter(z, x -> x.{part} = i)', 'q', held.format(at))})" for at, part in enumerate("abc"))
    return _let(placed, "z", f"flatten(array({parts}))")


def subtract_sql(one: str, other: str) -> str:
    """The difference of two blocks' cells as (p, i, n, k, h), place i of part p."""
    less = f"zip_with({one}, {other}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"
    return f"transform({less}, (y, j) -> named_struct('p', shiftright(j, {THIRD.bit_length() - 1}), 'i', j & {THIRD - 1}, 'n', y.n, 'k', y.k, 'h', y.h))"


def peel_sql(difference: str, third: str, seed: str) -> str:
    """The digests recovered from a difference of cells as (side, k), side 1 or -1; null if it can't be emptied in as many rounds as a part has cells.

    A round takes the digests of cells with one digest, which are empty then, out of the others.
    """
    left = "y -> y.n != 0 or y.k != 0 or y.h != 0"
    one = "(x.n = 1 or x.n = -1) and xxhash64(x.k, 99) = x.h"
    side = lambda n: f"transform(array_distinct(transform(filter(g0, x -> x.n = {n}), x -> x.k)), x -> named_struct('side', {n}, 'k', x))"
    pure = _let(f"filter(s.c, x -> {one})", "g0", f"if(size(g0) = 0, null, concat({side(1)}, {side(-1)}))")
    placed = f"transform(g, v -> {_places('v.k', third, seed, "named_struct('n', v.side, 'k', v.k, 'h', xxhash64(v.k, 99), 'at', array({0}, {1}, {2}))")})"
    without = "aggregate(o, y, (r, v) -> if(v.at[y.p] = y.i, named_struct('p', y.p, 'i', y.i, 'n', r.n - v.n, 'k', r.k ^ v.k, 'h', r.h ^ v.h), r))"
    others = _let(f"filter(s.c, x -> not ({one}))", "w0", f"if(size(w0) = 0, w0, {_let(placed, 'o', f'filter(transform(w0, y -> {without}), {left})')})")
    taken = f"named_struct('c', {others}, 'd', concat(s.d, g), 'over', false)"
    step = f"if(s.over, s, {_let(pure, 'g', f"if(g is null, named_struct('c', s.c, 'd', s.d, 'over', true), {taken})")})"
    none = "cast(array() as array<struct<side: int, k: bigint>>)"
    start = f"named_struct('c', filter({difference}, {left}), 'd', {none}, 'over', false)"
    return f"aggregate(sequence(1, {third}), {start}, (s, t0) -> {step}, s -> if(size(s.c) = 0, s.d, null))"


def sketch_sql(digests: str) -> str:
    """A text's sketch: n, level l, the digests of each block g and its cells c."""
    blocks = f"transform(m.g, e -> {cells_sql('e', str(THIRD), '0')})"
    level = _let(f"named_struct('d', {digests}, 'l', {_level(f'size({digests})', DIGESTS)})", "k", f"named_struct('n', size(k.d), 'l', k.l, 'g', {_dealt('k.d', 'k.l', _first_bits('u', 'w.l'))})")
    return _let(level, "m", f"named_struct('n', m.n, 'l', m.l, 'g', m.g, 'c', {blocks})")


def fingerprint_sql(sketch: str) -> str:
    cell = "if(x.n = 0 and x.k = 0, '', concat(hex(x.n), '/', hex(x.k), '/', hex(x.h)))"
    return f"concat({sketch}.n, ':', {sketch}.l, ':', array_join(transform(flatten({sketch}.c), x -> {cell}), ','))"


def _again(one: str, other: str) -> str:
    """What differs of two arrays of digests, by sketches that grow until they peel."""
    none = "cast(null as array<struct<side: int, k: bigint>>)"
    first = peel_sql(difference_sql("b"), str(THIRD), "1")
    more = peel_sql(difference_sql(_placed("b", "y3.w", "y3.t", "u.u", "u.s")), "y3.w", "y3.t")
    grown = _let(f"named_struct('w', shiftleft({THIRD}, least(t, {MOST_DOUBLED})), 't', t + 1)", "y3", more)
    block = f"coalesce({first}, aggregate(sequence(1, {RETRIES - 1}), {none}, (got, t) -> coalesce(got, {grown})))"
    placed = ", ".join(_placed(f"r.{side}", str(THIRD), "1", "u", sign, _first_bits("xxhash64(u, 77)", "r.l")) for side, sign in (("a", "1"), ("b", "-1")))
    both = f"named_struct('a', {one}, 'b', {other}, 'l', {_level(f'size({one}) + size({other})', AGAIN)})"
    return _let(both, "r", f"flatten(transform({_dealt(f'concat({placed})', 'r.l', 'u.q')}, b -> {block}))")


def differing_sql(one: str, other: str) -> str:
    """The digests of one of two sketches but not both, as (side, k): 1 for those of the first alone, -1 for those of the second."""
    count = "shiftleft(1, {0}.l - h.l)"
    start = f"i * {count} + 1"
    added = "zip_with(s, y, (x, v) -> named_struct('n', x.n + v.n, 'k', x.k ^ v.k, 'h', x.h ^ v.h))"
    zeros = f"array_repeat({_ZERO}, {3 * THIRD})"

    def folded(side: str) -> tuple[str, str]:
        part = lambda what: f"slice({side}.{what}, {start.format(side)}, {count.format(side)})"
        return f"if({side}.l = h.l, {side}.g[i], flatten({part('g')}))", f"if({side}.l = h.l, {side}.c[i], aggregate({part('c')}, {zeros}, (s, y) -> {added}))"

    (ga, ca), (gb, cb) = folded(one), folded(other)
    block = f"coalesce({peel_sql(subtract_sql(ca, cb), str(THIRD), '0')}, {_again(ga, gb)})"
    return _let(f"named_struct('l', least({one}.l, {other}.l))", "h", f"flatten(transform(sequence(0, shiftleft(1, h.l) - 1), i -> {block}))")


def likeness_sql(one: str, other: str) -> str:
    total = f"({one}.n + {other}.n)"
    return f"if({total} = 0, 1D, 1D - size({differing_sql(one, other)}) / {total})"


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, sketch, next_sketch): each text with that of the next document by id, each sketched once.

    Ids are dealt to ranges of about BUCKET_BYTES, found from percentiles; each range also gets the first row of the next.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("doc_id").alias("n")).first()
    n = max(1, min(MOST_BUCKETS, -(-(sizes["bytes"] or 0) // BUCKET_BYTES)))
    bounds = []
    if n > 1 and sizes["n"]:
        at = [i / n for i in range(1, n)]
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", at, 20 * n).alias("p")).first()["p"]))
    if bounds:
        step = max(1, int(len(bounds) ** 0.5))
        coarse = bounds[::step]
        one = F.size(F.filter(F.lit(coarse), lambda b: b <= F.col("doc_id")))
        few = F.slice(F.lit(bounds), (F.greatest(one, F.lit(1)) - 1) * step + 1, step)
        found = (F.greatest(one, F.lit(1)) - 1) * step + F.size(F.filter(few, lambda b: b <= F.col("doc_id")))
        bucket = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(found)
    else:
        bucket = F.lit(0)
    dealt = docs.withColumn("bucket", bucket.cast("int"))
    # at most MOST_BUCKETS rows
    firsts = dealt.groupBy("bucket").agg(F.min("doc_id").alias("first"))
    order = W.orderBy("bucket")
    back = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    firsts = F.broadcast(firsts.select("first", "bucket", back.alias("before")).withColumnRenamed("bucket", "its"))
    copied = dealt.join(firsts, dealt["doc_id"].eqNullSafe(firsts["first"]) & (dealt["bucket"] == firsts["its"]), "left")
    targets = F.when(F.col("its").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("copy")))).otherwise(
        F.array(F.struct(F.col("bucket"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("copy")))
    )
    rows = copied.select("doc_id", "text", F.explode(targets).alias("to")).select("doc_id", "text", "to.bucket", "to.copy")
    order = W.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_last(), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    rows = rows.withColumn("sketch", F.expr(_let(units_sql("text"), "d1", sketch_sql("d1"))))
    return rows.withColumn("next_sketch", F.lead("sketch").over(order)).filter("not copy").select("doc_id", "text", "next_text", "sketch", "next_sketch")


def _versions(rows: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256 and the sketches of the text, of the edited (v[0], v[1]) and of the next text (v[2])."""
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", F.expr("cast(n_chars div 4 as int)"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, cast(n_chars as int) - cut), left(next_text, cut))"))
    edited = F.expr(_let(units_sql("edited"), "d1", sketch_sql("d1")))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.array("sketch", edited, "next_sketch").alias("v"))


def compare_versions(rows: DataFrame) -> DataFrame:
    """rows of with_next() with the edited text's digest, fingerprints and likenesses."""
    found = _versions(rows)
    near = F.expr(f"transform(slice(v, 2, 2), v2 -> {likeness_sql('v[0]', 'v2')})")
    prints = F.expr(f"transform(slice(v, 1, 2), v1 -> {fingerprint_sql('v1')})")
    found = found.select("doc_id", "n_chars", "edited_sha256", prints.alias("prints"), near.alias("near"))
    return found.select("doc_id", "n_chars", "edited_sha256", F.col("prints")[0].alias("fingerprint"), F.col("prints")[1].alias("edited_fingerprint"), F.col("near")[0].alias("near_edited"), F.col("near")[1].alias("near_next"))


def differing_digests(rows: DataFrame) -> DataFrame:
    """rows of with_next() to (doc_id, gone, new): the paragraph digests recovered of the text alone and of the edited text alone."""
    found = _versions(rows)
    found = found.select("doc_id", F.expr(_let("named_struct('a', v[0], 'b', v[1])", "v3", differing_sql("v3.a", "v3.b"))).alias("d"))
    side = lambda sign: F.expr(f"transform(filter(d, z1 -> z1.side = {sign}), z1 -> z1.k)")
    return found.select("doc_id", side(1).alias("gone"), side(-1).alias("new"))


def op9_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(with_next(table(spark, sf_dir, "documents")))
