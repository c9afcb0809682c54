"""Near-duplicates: SimHash fingerprints, found by Golay-code keys, and Jaccard similarity of shingle sets, found by rare shingles.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. With at most two differing bits one segment is equal
(pigeonhole) and the next one differs in at most two, so it shares a codeword index: a key is the exact segment with an index of
the next, at most 18 keys for each distinct fingerprint. Fingerprints that share a key are compared bit by bit within the
key's rows, which come sorted; of the links in a key only a spanning forest leaves the task. Components follow by star steps.

drop_near_duplicates(), the pipeline's form, links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
Candidates come from fingerprints of those sets by the same Golay keys first, and are verified. Fingerprints miss some of the similar texts,
so a prefix filter goes over what they left in different components, and its candidates are complete: all shingles have one order, the common
ones last, and of n shingles the first n - ceil(0.8 n) + 1 are the text's keys, of which two such texts share one. The texts of a key are compared
with a few of them; then all pairs of a key that are still not in one component, if their sizes and the number of keys they share allow the similarity.

Null, empty and blank texts have fingerprint zero and are linked like any other. Ties: a bit that is set in exactly half
the shingles is 0. Repeated rows share a component. A null id never names a component unless all its ids are null. An empty
table gives an empty result. Other columns are kept; those named like result columns give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm import golay
from loomtext.llm.common import Hashes, chunks, materialize, mixed, packed, release, rolling, scratch, table, trimmed, unpacked, word_hashes
from loomtext.llm.graph import components, forest

SEED = 42
#: (shift, bits) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Keys with more fingerprints are searched by flipping bits, not by comparing all.
COMPARE_ALL = 512


def fingerprints(texts: list[bytes | None], shingle: int = 3, seed: int = SEED) -> np.ndarray:
    """The unsigned fingerprints of whole texts: A-Z lowered, words by ASCII white space, majority over XXH64 of the shingles."""
    digest = xxhash.xxh64_digest
    out = np.zeros(len(texts), np.uint64)
    for first, last in chunks(texts, 1 << 20):
        hashes, counts = [], []
        for text in texts[first:last]:
            words = text.lower().split() if text else []
            n = max(1, len(words) - shingle + 1) if words else 0
            counts.append(n)
            if n == 1:
                hashes.append(digest(b" ".join(words), seed))
            elif n:
                joined, ends, at = b" ".join(words), [], -1
                for w in words:
                    at += len(w) + 1
                    ends.append(at)
                starts = [0, *(e + 1 for e in ends[: n - 1])]
                hashes += [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
        counts = np.array(counts)
        full = counts > 0
        if not full.any():
            continue
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        ones = np.packbits(2 * sums > counts[full][:, None], axis=1)
        out[first:last][full] = ones.view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprinted(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array(fingerprints(batch.column("text").to_pylist(), shingle, seed).view(np.int64))
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "fp": fp})

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each fingerprint: (exact segment, index of the next)."""
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        parts = [(fp.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1) for shift, bits in SEGMENTS]
        index = [golay.indices(p) for p in parts]
        for a in range(3):
            b = (a + 1) % 3
            for j in range(6):
                ok = index[b][:, j] >= 0
                key = (np.int64(a) << 34) | (parts[a][ok] << 12) | index[b][ok, j]
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "fp": pa.array(fp[ok])})


def _flips(most: int, fixed: int) -> np.ndarray:
    """The masks of one to `most` (1 or 2) bits among those not in `fixed`."""
    bits = [1 << b for b in range(64) if not fixed >> b & 1]
    pairs = [x | y for i, x in enumerate(bits) for y in bits[:i]] if most > 1 else []
    return np.array(bits + pairs, np.uint64)


def _links_exact(most: int):
    """Per key: the links of at most `most` differing bits, as a forest (more than two bits: among COMPARE_ALL fingerprints at most, else two)."""

    def of(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        xs, ys = [], []
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        small = np.repeat(sizes <= COMPARE_ALL, sizes)
        rank = np.arange(len(key)) - np.repeat(starts, sizes)
        left = np.repeat(sizes, sizes) - rank  # rows of the key from here on
        at = np.flatnonzero(small & (left > 1))
        d = 1
        while len(at):
            near = np.bitwise_count(fp[at] ^ fp[at + d]) <= most
            xs.append(fp[at[near]])
            ys.append(fp[at[near] + d])
            d += 1
            at = at[left[at] > d]
        for start, n in zip(starts[sizes > COMPARE_ALL], sizes[sizes > COMPARE_ALL], strict=True):
            own = np.unique(fp[start : start + n])
            shift, bits = SEGMENTS[int(key[start]) >> 34]
            for mask in _flips(min(most, 2), ((1 << bits) - 1) << shift):
                other = own ^ mask
                hit = np.minimum(np.searchsorted(own, other), len(own) - 1)
                ok = (own[hit] == other) & (other > own)
                xs.append(own[ok])
                ys.append(other[ok])
        return forest(np.concatenate(xs), np.concatenate(ys)) if xs else (fp[:0], fp[:0])

    return of


def _by_key(find):
    """Run find(key, fp) over whole keys of batches sorted by key; what is held is one batch and one key's fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(cut: int) -> pa.RecordBatch:
            a, b = find(key[:cut], fp[:cut]) if cut else (fp[:0], fp[:0])
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield out(cut)
                key, fp = key[cut:], fp[cut:]
        yield out(len(key))

    return run


def _candidates(distinct: DataFrame, find) -> DataFrame:
    keyed = distinct.select("fp").mapInArrow(_keys, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_by_key(find), "a long, b long")


def _with_components(rows: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (fp, ...) with component_id, the smallest id of all fingerprints under a root; distinct: (fp, id)."""
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, seed: int = SEED) -> DataFrame:
    """docs without the text, with fingerprint (16 hex digits) and component_id, the smallest id reachable over links of at most max_bits (1 or 2) bits."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2")
    source = packed(docs, text_col)
    schema = T.StructType([source.schema["row"], T.StructField("fp", T.LongType())])
    rows = materialize(source.mapInArrow(trimmed(_fingerprinted(shingle, seed)), schema), "simhash")
    distinct = rows.groupBy("fp").agg(F.min(F.col(f"row.`{id_col}`")).alias("id"))
    roots = components(_candidates(distinct, _links_exact(max_bits)))
    found = _with_components(rows, distinct, roots)
    out = found.select("row", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    rest = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in (text_col, "fingerprint", "component_id")]
    return out.select(*rest, "fingerprint", "component_id")


#: drop_near_duplicates(): texts of which the common shingles are learnt, and how many of those are kept. Neither decides what is found.
SAMPLE = 10_000
MOST_COMMON = 500_000
#: Row ids, of eight bytes, that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Candidate pairs in a batch.
PAIRS = 1 << 18
#: The first texts of a key, so many, are compared with all others before all pairs are.
CENTRES = 8
#: Cells of a text's bitmap.
BITMAP = 512
#: Differing bits of fingerprints whose texts are compared first. It doesn't decide what is found: the prefix filter follows.
FIRST_BITS = 8


def _shingles(text: bytes | None, shingle: int, cache: Hashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of lowered words (a shorter text is one shingle)."""
    hashes, _ = word_hashes([text.lower() if text else None], cache)
    return np.unique(rolling(hashes, min(shingle, max(1, len(hashes))), 0x9E3779B97F4A7C15))


def _shingle_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes(SEED)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_pydict({"key": pa.array(_shingles(text, shingle, cache).view(np.int64))})

    return run


def _common(source: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of a sample, sorted, and in how many of them they are (65,535 at most)."""
    n = source.count()
    some = source.select("text").sample(min(1.0, SAMPLE / n), SEED) if n else source.select("text")
    counted = some.mapInArrow(trimmed(_shingle_rows(shingle)), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = counted.orderBy(F.desc("n"), "key").limit(MOST_COMMON).select("key", F.least("n", F.lit(65535)).alias("n")).toArrow()
    keys, counts = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy().astype(np.uint16)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes: the bits that over half of them have."""
    if not len(hashes):
        return 0
    sums = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = mixed(hashes[at : at + (1 << 16)]).astype(">u8")
        sums += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(hashes)).view(">u8")[0])


def _bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each cell, of BITMAP, that a shingle has. A bit that one text has and another one hasn't stands for a shingle of the first alone."""
    cells = np.zeros(BITMAP, bool)
    cells[(hashes % np.uint64(BITMAP)).astype(np.int64)] = True
    return np.packbits(cells).tobytes()


def _prefixed(shingle: int, least: float, common: np.ndarray, counts: np.ndarray):
    """(rid, digest of the set, its fingerprint, size and bitmap, keys): keys are the first shingles, the common ones last, of which similar texts share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes(SEED)
        for batch in batches:
            digests, prints, sizes, keys, bits = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                own = _shingles(text, shingle, cache)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                prints.append(_majority(own))
                bits.append(_bitmap(own))
                sizes.append(len(own))
                n = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1 if len(own) else 0
                if n and len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    own = own[np.argsort(np.where(common[at] == own, counts[at], 0).astype(np.uint16), kind="stable")]
                keys.append(own[:n])
            ends = np.cumsum([0, *map(len, keys)])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64)))
            columns = {"rid": batch.column("rid"), "digest": pa.array(digests, pa.binary()), "fp": pa.array(np.array(prints, np.uint64).view(np.int64)), "size": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary()), "keys": listed}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole keys, from batches sorted by key, and how many rows each key has."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[pa.Table, np.ndarray]:
        found = pa.Table.from_batches(held)
        key = found["key"].to_numpy()
        return found, np.diff(np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)))

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        if held and held[-1].column("key")[-1].as_py() != key[-1]:
            cut = int(np.searchsorted(key, key[-1]))
            held.append(batch.slice(0, cut))
            yield out()
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield out()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of keys that several texts have."""
    for found, sizes in _whole_keys(batches):
        yield from found.filter(pa.array(np.repeat(sizes > 1, sizes))).combine_chunks().to_batches()


def _pairs(least: float, star: bool):
    """Candidates (a, b, need) of each key, a > b: of its first rows with all others, or of all rows of different roots.

    Rows of a key come by its place in their texts' orders: an original has fewer rare shingles before it than its copies, so it is compared with all of them.
    A key at places p and q can't be common to similar texts if what lies before both and after both is too little; nor are texts similar
    if one has too many shingles that the other's bitmap denies. Both bounds are exact and go before anything is emitted.

    need is how many keys two similar texts of their sizes share: of the text whose keys end first in the order, a key that the other one lacks is a
    shingle that it lacks, so the texts share no more than their common keys and what is no key of that one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, sizes in _whole_keys(batches):
            nid, size, pos, root = (found[c].to_numpy() for c in ("nid", "size", "pos", "root"))
            size, pos = size.astype(np.int64), pos.astype(np.int64)
            others = np.ceil(least * size - 1e-9).astype(np.int64) - 1  # shingles that are no keys
            bits = np.frombuffer(b"".join(found["bits"].to_pylist()), np.uint64).reshape(len(nid), -1)

            def near(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
                shared = np.minimum(pos[i], pos[j]) + np.minimum(size[i] - pos[i], size[j] - pos[j])
                ok = (root[i] != root[j]) & (shared >= least / (1 + least) * (size[i] + size[j]) - 1e-6)
                i, j = i[ok], j[ok]
                own, other = bits[i], bits[j]
                denied = [np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64) for x, y in ((own, other), (other, own))]
                ok = np.minimum(size[i] - denied[0], size[j] - denied[1]) >= least / (1 + least) * (size[i] + size[j]) - 1e-6
                i, j = i[ok], j[ok]
                need = np.ceil(least / (1 + least) * (size[i] + size[j]) - 1e-6).astype(np.int64) - np.maximum(others[i], others[j])
                x, y = nid[i], nid[j]
                return pa.RecordBatch.from_pydict({"a": pa.array(np.maximum(x, y)), "b": pa.array(np.minimum(x, y)), "need": pa.array(need.astype(np.int32))})

            row = np.arange(len(nid))
            if star:
                place = row - np.repeat(np.cumsum(sizes) - sizes, sizes)
                for k in range(CENTRES):
                    at = row[place > k]
                    yield near(at - place[at] + k, at)
                continue
            left = np.repeat(np.cumsum(sizes), sizes) - row  # rows of the key from here on
            at, d, held, n = row[left > 1], 1, [], 0
            while len(at):
                held.append(near(at, at + d))
                n += held[-1].num_rows
                if n >= PAIRS:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, n = [], 0
                d += 1
                at = at[left[at] > d]
            if n:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _shingle_sets(shingle: int):
    """(nid, set): the shingles of a text, as _shingles() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes(SEED)
        for batch in batches:
            sets = [_shingles(x, shingle, cache).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"nid": batch.column("nid"), "set": pa.array(sets, pa.binary())})

    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if min(len(a), len(b)) < least * max(len(a), len(b)):
                    keep.append(False)
                    continue
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(shared >= least * (len(a) + len(b) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bounded(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are few enough."""
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def _verified(pairs: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    needed = materialize(pairs.select(F.col("a").alias("nid")).unionAll(pairs.select("b")).distinct(), "near-needed")
    texts = rows.select(F.col("rid").alias("nid"), "text").join(_bounded(needed), "nid", "left_semi")
    sets = materialize(texts.mapInArrow(trimmed(_shingle_sets(shingle)), "nid long, set binary"), "near-sets")
    compared = pairs.join(sets.select(F.col("nid").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("nid").alias("b"), F.col("set").alias("y")), "b")
    return materialize(compared.select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long, b long"), "near-links")


def _first_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) of nodes (nid, fp), a > b: of equal fingerprints the least with the others, and the least of fingerprints linked in a Golay key."""
    prints = materialize(nodes.groupBy("fp").agg(F.min("nid").alias("nid")), "near-prints")
    same = nodes.select("fp", F.col("nid").alias("a")).join(prints.withColumnRenamed("nid", "b"), "fp").filter("a > b").select("a", "b")
    met = _candidates(prints, _links_exact(FIRST_BITS)).distinct()
    met = met.join(prints.select(F.col("fp").alias("a"), F.col("nid").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("nid").alias("y")), "b")
    return same.unionAll(met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group: the smallest id (nulls last), of equal ids one row.

    A group is linked by Jaccard similarity of the sets of shingles, and no link is left out; texts of equal sets are one node
    throughout. Pairs of a key that are neither similar nor joined by others are all compared, so many texts just below the similarity take their square.
    """
    rows = materialize(packed(docs, text_col).withColumn("rid", F.monotonically_increasing_id()), "near-rows")
    with scratch() as made:
        gone = _redundant(rows, id_col, shingle, similarity)
    gone = materialize(gone, "near-gone")
    release(docs.sparkSession, made)  # the result reads rows and gone alone
    return unpacked(rows.join(_bounded(gone), "rid", "left_anti"), docs, text_col, [])


def _redundant(rows: DataFrame, id_col: str, shingle: int, similarity: float) -> DataFrame:
    """The rid of all rows (text, row, rid) but one of each group."""
    schema = "rid long, digest binary, fp long, size int, bits binary, keys array<long>"
    keyed = materialize(rows.select("rid", "text").mapInArrow(trimmed(_prefixed(shingle, similarity, *_common(rows, shingle))), schema), "near-keyed")
    order = F.struct(F.col(f"row.`{id_col}`").isNull().alias("none"), F.col(f"row.`{id_col}`").alias("id"), F.col("rid").alias("rid"))
    ranked = rows.select("rid", order.alias("best")).join(keyed.select("rid", "digest", "fp", "bits"), "rid")
    nodes = ranked.groupBy("digest").agg(F.min("best").alias("best"), F.first("fp").alias("fp"), F.first("bits").alias("bits")).select("best", "fp", "bits", F.col("best.rid").alias("nid"))
    nodes = materialize(nodes, "near-nodes")
    tried = materialize(_first_pairs(nodes), "near-tried")
    links = _verified(tried, rows, shingle, similarity)
    each = keyed.select(F.col("rid").alias("nid"), "size", "keys").join(_bounded(nodes.select("nid")), "nid", "left_semi").select("nid", "size", F.posexplode("keys").alias("pos", "key"))
    shared = materialize(each.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, each.schema), "near-shared")
    few = nodes.count() <= MOST_BROADCAST // 10  # they are ten times as long as ids
    for star in (True, False):
        roots = components(links)
        known = nodes.select("nid", "bits").join(_bounded(roots.withColumnRenamed("node", "nid")), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
        apart = shared.join(F.broadcast(known) if few else known, "nid")
        pairs = apart.repartition("key").sortWithinPartitions("key", "pos", "nid").mapInArrow(_pairs(similarity, star), "a long, b long, need int")
        pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n >= need").select("a", "b")
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        links = materialize(links.unionAll(_verified(pairs, rows, shingle, similarity)), "near-links")
        tried = tried.unionAll(pairs)
    roots = components(links)
    named = nodes.join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    kept = named.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.rid").alias("rid"))
    return rows.select("rid").join(kept, "rid", "left_anti")


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_components(docs).select("doc_id", "fingerprint", "component_id")
