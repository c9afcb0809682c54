"""Fingerprints decoded and peeled outside Spark, recovered digests, and sketches that have to grow."""

import random
import struct

import pytest
import xxhash

from loomtext.llm import iblt

from .test_operators import TEXTS, brute_units, prose


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(u, salt):
    """xxhash64(u, salt) of Spark for a long and an int."""
    return xxhash.xxh64_intdigest(struct.pack("<i", salt), xxhash.xxh64_intdigest(struct.pack("<q", u), 42))


def digests(text):
    return {signed(xxhash.xxh64_intdigest(p.encode(), 42)) for p in brute_units(text)}


def decoded(fingerprint):
    n, level, cells = fingerprint.split(":")
    values = [[int(x, 16) for x in c.split("/")] if c else [0, 0, 0] for c in cells.split(",")]
    return int(n), int(level), values


def peeled(one, other):
    """The differing digests of two fingerprints of one level, None where the sketches are too small."""
    cells = [[signed(a) - signed(b) if i == 0 else a ^ b for i, (a, b) in enumerate(zip(x, y))] for x, y in zip(one[2], other[2])]
    third, found = iblt.THIRD, {1: set(), -1: set()}
    while pure := next((c for c in cells if abs(c[0]) == 1 and hashed(signed(c[1]), 99) == c[2]), None):
        n, k, h = pure
        found[n].add(signed(k))
        block = k >> 64 - one[1] if one[1] else 0
        p = hashed(signed(k), 0)
        for part in range(3):
            c = cells[block * 3 * third + part * third + (p >> 20 * part & third - 1)]
            c[0], c[1], c[2] = c[0] - n, c[1] ^ k, c[2] ^ h
    return found if not any(map(any, cells)) else None


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    long = [prose(50, 2000) + ". " + ". ".join(prose(60 + i, 9) for i in range(400)) for _ in range(1)]
    texts = [x for x in TEXTS if x is not None] + [prose(i, 300) for i in range(12)] + long + ["short. text", ". ".join(f"u{r.random()}" for _ in range(3000))]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def edited(texts):
    for x, y in zip(texts, texts[1:] + texts[:1]):
        cut = len(x) // 4
        yield x, x[: len(x) - cut] + y[:cut], y


def test_fingerprints_are_the_sketches(rows):
    texts, docs = rows
    found = {r.doc_id: r for r in iblt.compare_versions(iblt.with_next(docs)).collect()}
    some = 0
    for i, (x, e, _) in enumerate(edited(texts)):
        one, other = decoded(found[i].fingerprint), decoded(found[i].edited_fingerprint)
        assert one[0] == len(digests(x)) and len(one[2]) == 3 * iblt.THIRD << one[1]
        if one[1] == other[1] and (got := peeled(one, other)):
            some += 1
            assert got == {1: digests(x) - digests(e), -1: digests(e) - digests(x)}
            assert found[i].near_edited == pytest.approx(1 - len(got[1] | got[-1]) / max(1, one[0] + other[0]))
    assert some > 10


@pytest.mark.parametrize("third", [8, 2, 1])
def test_recovered_digests_also_if_sketches_must_grow(rows, monkeypatch, third):
    monkeypatch.setattr(iblt, "THIRD", third)
    texts, docs = rows
    got = {r.doc_id: (sorted(r.gone), sorted(r.new)) for r in iblt.differing_digests(iblt.with_next(docs)).collect()}
    assert got == {i: (sorted(digests(x) - digests(e)), sorted(digests(e) - digests(x))) for i, (x, e, _) in enumerate(edited(texts))}


def test_likeness_needs_peeling(rows, monkeypatch):
    texts, docs = rows
    monkeypatch.setattr(iblt, "peel_sql", lambda *a: "cast(null as array<struct<side: int, k: bigint>>)")
    assert all(r.near_next is None for r in iblt.compare_versions(iblt.with_next(docs)).collect() if r.doc_id > 0 and texts[r.doc_id].strip())


def test_texts_of_unlike_sizes(spark):
    big = ". ".join(f"w{i}" for i in range(5000))
    docs = spark.createDataFrame([(1, "one. w3. two"), (2, big), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in iblt.compare_versions(iblt.with_next(docs)).collect()}
    assert got[1].near_next == pytest.approx(2 / 5003) and got[2].near_next == 0 and got[3].near_next == 0


def test_each_text_is_sketched_once(rows, spark):
    texts, docs = rows
    several = iblt.with_next(docs)
    found = sorted(several.collect(), key=lambda r: r.doc_id)
    assert [r.next_sketch for r in found] == [r.sketch for r in found[1:] + found[:1]]
    assert [r.sketch.n for r in found] == [len(digests(x)) for x in texts]
    plan = iblt.compare_versions(several)._jdf.queryExecution().optimizedPlan()
    assert sum(plan.apply(i).expressions().toString().count("split(") for i in range(40) if plan.apply(i) is not None) == 2  # the text's and the edited text's
