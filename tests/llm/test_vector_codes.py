"""Vector codes: annular search against all entries, the operator against plain quantization."""

import hashlib
import math

import numpy as np
import pytest

from loomtext.llm import vector_codes
from loomtext.llm.vector_codes import Codebook, Quantizer, quantize


@pytest.mark.parametrize("seed", range(25))
def test_annular_search_equals_all_entries(seed):
    r = np.random.default_rng(seed)
    width, reach = int(r.integers(1, 9)), int(r.choice([1, 3, 60, 10_000, 1_000_000]))
    entries = r.integers(-reach, reach + 1, (int(r.integers(1, 65)), width))
    parts = np.concatenate([r.integers(-reach, reach + 1, (200, width)), entries, -entries, np.zeros((3, width), np.int64)])
    all_of = ((parts[:, None] - entries[None]) ** 2).sum(2)
    index, distance = Codebook(entries).nearest(parts)
    assert (index == all_of.argmin(1)).all() and (distance == all_of.min(1)).all()  # argmin takes the lower index


def test_annuli_leave_most_entries_out_where_norms_differ():
    r = np.random.default_rng(0)
    entries = np.concatenate([r.integers(-5, 6, (32, 4)) + 1000 * k for k in range(2)])
    book, parts = Codebook(entries), np.repeat(entries, 20, axis=0) + r.integers(-2, 3, (1280, 4))
    book.nearest(parts)
    assert book.evaluated < 0.7 * parts.shape[0] * entries.shape[0]


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return []
    dim = len(kept[0][2])
    good = [r for r in kept if len(r[2]) == dim]
    w = dim // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(v)[p] for *_, v in good[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for *_, v in good:
                groups.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(x) // len(x) for x in zip(*groups[e])] if e in groups else c for e, c in enumerate(books[p])]
    out, by = [], {}
    for i, label, v in kept:
        found = [near(x, books[p]) for p, x in enumerate(cut(v))] if len(v) == dim else None
        error = sum(d for d, _ in found) if found else None
        out.append((i, label, "".join(f"{e:02x}" for _, e in found) if found else None, error))
        if found:
            by[label] = by.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, code, error, by.get(label), sha) for i, label, code, error in out), key=repr)


def rows(df):
    return sorted(map(tuple, df.select("vec_id", *vector_codes.MADE).collect()), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("most", [vector_codes.MOST_BROADCAST, 0])
def test_operator_equals_plain_quantization_on_odd_rows(spark, most):
    r = np.random.default_rng(1)
    data = [(int(i), [float(x) for x in r.normal(size=32)], [None, 1, 2][i % 3]) for i in r.permutation(150)]
    data += data[:5] + [(3, [0.5] * 32, 7), (None, [0.25] * 32, 7), (-9, None, 1), (-8, [None] + [0.0] * 31, 1), (-7, [math.nan] * 32, 1), (-6, [math.inf] * 32, 1), (-5, [-math.inf] * 32, 1)]
    data += [(400, [0.0] * 32, None), (401, [0.0] * 31, None), (402, [], 55)]
    assert rows(quantize(spark.createDataFrame(data, SCHEMA), most_broadcast=most)) == plain(data)


def test_few_rows_none_and_other_columns(spark):
    data = [(2, [1.0] * 16, 1), (1, [-1.0] * 16, 1)]
    assert rows(quantize(spark.createDataFrame(data, SCHEMA))) == plain(data)
    assert rows(quantize(spark.createDataFrame([], SCHEMA))) == [] == rows(quantize(spark.createDataFrame([(1, None, 1)], SCHEMA)))
    wide = spark.createDataFrame([(1, [1.0] * 16, 1, "a", 2, "b")], SCHEMA + ", code string, part int, row string")
    assert quantize(wide).columns == ["vec_id", "label", "part", "row", *vector_codes.MADE] and quantize(wide).first().row == "b"


def test_what_cannot_be_computed_is_an_error(spark):
    with pytest.raises(ValueError):
        quantize(spark.createDataFrame([(1, [1.0] * 15, 1)], SCHEMA))
    with pytest.raises(OverflowError):
        Quantizer(np.full((1, 2, 1), 1 << 40))
    with pytest.raises(OverflowError):
        Quantizer(np.zeros((1, 2, 1), np.int64)).assign(np.array([[-1 << 40]]))


def test_the_query_equals_plain_quantization(spark):
    table = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert rows(vector_codes.op13_annular_codes(spark, "/root/testdata/sf0.001")) == plain(table)
