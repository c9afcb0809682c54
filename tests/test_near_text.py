"""Near duplicates by sequence ratio: the same pairs and the same kept rows as comparing all, with few comparisons."""

import difflib
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.operators import near_blocks, near_text


def checkpoint(df):
    df.sparkSession.sparkContext.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def edited(r, text, n, letters):
    out = list(text)
    for _ in range(n):
        at, what = r.randrange(len(out) + 1), r.random()
        if what < 0.4:
            out[at:at] = r.choice(letters)
        elif what < 0.7:
            del out[at : at + 1]
        elif out:
            out[min(at, len(out) - 1)] = r.choice(letters)
    return "".join(out)


def some_texts(seed, n):
    r, letters = random.Random(seed), "abcde  é𝄞"
    base = ["".join(r.choices(letters, k=r.choice([1, 2, 3, 5, 9, 20, 40, 70]))) for _ in range(n)]
    return [edited(r, r.choice(base), r.choice([0, 1, 2, 5, 9]), letters) for _ in range(3 * n)] + ["", "a", "ab", "ba", "aab"]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.7, 0.85, 0.95])
def test_texts_that_are_near_share_an_element_of_their_prefixes(threshold):
    for seed in range(6):
        texts = sorted({x for x in some_texts(seed, 30) if x})
        counts = {}
        for x in texts:
            for w in near_text.widths_of(len(x), threshold):
                for e in near_text.elements(x, w):
                    counts[e] = counts.get(e, 0) + 1
        rank = {e: i for i, e in enumerate(sorted(counts, key=counts.get)) if i % 3}  # some have no rank
        keys = {x: set(near_text.prefix(x, threshold, rank)) for x in texts}
        for a, b in itertools.permutations(texts, 2):
            if ratio(a, b) > threshold:
                assert keys[a] & keys[b], (a, b)


@pytest.mark.parametrize("threshold", [0.5, 0.85])
def test_pairs_equal_brute_force(spark, threshold):
    rows = [(i, x, i % 2) for i, x in enumerate(some_texts(9, 30))] + [(1000, None, 0)]
    df = spark.createDataFrame(rows, "id long, x string, p int")
    want = {(b, a): round(ratio(y, x), 9) for (a, x, p), (b, y, q) in itertools.combinations(rows[:-1], 2) if p == q and x and y and ratio(y, x) > threshold}
    assert {(r.later, r.earlier): round(r.ratio, 9) for r in near_text.near_duplicate_pairs(df, "id", "x", threshold, "p").collect()} == want and len(want) > 20


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_kept_rows_equal_the_sequential_rule(spark, rounds):
    texts = some_texts(4, 25)
    kept = []
    for i, x in enumerate(texts):
        if not x or not any(texts[j] and ratio(x, texts[j]) > 0.85 for j in kept):
            kept.append(i)
    df = spark.createDataFrame([*enumerate(texts), (9999, None)], "id long, x string")
    assert sorted(r.id for r in near_text.near_first_wins(df, "id", "x", checkpoint, rounds=rounds).collect()) == [*kept, 9999]


def test_comparisons_follow_the_rows_in_a_skewed_band(spark):
    r = random.Random(2)
    base = "a summary that many rows have with one other word at its end "
    df = spark.createDataFrame([(i, base + "".join(r.choices("abcdefgh", k=4))) for i in range(400)], "id long, x string")
    index = checkpoint(near_text.index(near_text._texts(df, "id", "x", None), 0.85))
    kept, asked = near_text._round(index, 0.85, checkpoint)
    assert kept.count() >= 1 and asked.count() <= 2 * 400
    assert [row.id for row in near_text.near_first_wins(df, "id", "x", checkpoint).collect()] == [0]


def test_unlike_texts_of_one_length_are_hardly_compared(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12))) for i in range(400)], "id long, x string")
    pairs = near_text._candidates(near_text.index(near_text._texts(df, "id", "x", None), 0.85), 0.85)
    assert pairs.count() < 0.1 * 400 * 399 / 2


def test_bags_bound_what_is_matched():
    r = random.Random(5)
    for x, y in zip(some_texts(5, 60), some_texts(6, 60), strict=True):
        counts = lambda text: [b for n in near_text.bag(text) for b in n.to_bytes(8, "little", signed=True)]
        shared = sum(map(min, counts(x), counts(y)))
        assert round(ratio(x, y) * (len(x) + len(y)) / 2) <= shared <= min(len(x), len(y))
    assert near_text.bag("a" * 256) is None and r


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, x string")
    assert near_text.near_first_wins(df, "id", "x", checkpoint).collect() == [] == near_text.near_duplicate_pairs(df, "id", "x").filter(F.lit(True)).collect()


def long_texts(seed):
    r, letters = random.Random(seed), "abcdefgh "
    base = ["".join(r.choices(letters, k=k)) for k in (63, 64, 65, 128, 129, 200, 260, 300, 1030)]
    return [edited(r, x, n, letters) for x in base for n in (0, 2, 8, 30)]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85, 0.95])
def test_cells_hold_all_near_pairs(threshold):
    texts = [x for x in some_texts(1, 30) if x] + long_texts(1)
    rows = pd.DataFrame({"id": range(len(texts)), "x": texts, "k": 0, "l": 0, "s": 0, "t": 0, "side": 0, "old": [i % 3 == 0 for i in range(len(texts))]})
    want = {(j, i) for i, j in itertools.combinations(range(len(texts)), 2) if ratio(texts[j], texts[i]) > threshold}
    found = lambda rows, cross=False, once=False: {(a, b) for a, b, _ in near_blocks.near_in_cell(rows, threshold, cross, once).itertuples(index=False)}
    assert found(rows) == want
    mixed = {(a, b) for a, b in want if rows["old"][a] != rows["old"][b]}
    assert found(rows, cross=True) == mixed
    two = rows.assign(t=1, side=[i % 2 for i in range(len(texts))])
    assert found(two) == {(a, b) for a, b in want if (a - b) % 2}
    assert found(two, cross=True) == {(a, b) for a, b in mixed if (a - b) % 2}
    assert found(two[two["side"] == 0]) == set()
    first = rows.assign(old=rows["id"] < len(texts) // 2)
    mixed = found(first, cross=True)
    assert found(first, cross=True, once=True) <= mixed and {a for a, _ in found(first, cross=True, once=True)} == {a for a, _ in mixed}


def test_unlike_texts_of_few_syllables_hardly_need_a_ratio():
    """An index of rare pairs of characters finds nearly all pairs of such texts."""
    r = random.Random(4)
    syllables = "the ing tion an re on er st and le ".split(" ")
    texts = ["".join(r.choices(syllables + [" "] * 4, k=60)) for _ in range(300)]
    rows = near_blocks.Texts(sorted(texts, key=len), near_blocks._codes(texts))
    i, j = (near_blocks.np.concatenate(x) for x in zip(*near_blocks.by_bags(rows, rows, 0.85), strict=True))
    assert near_blocks.by_subsequence(rows, rows, i, j, 0.85).sum() < 10


@pytest.mark.parametrize("by_index", [False, True])
def test_waves_and_index_keep_the_same_rows(spark, by_index):
    texts = some_texts(7, 25) + long_texts(2)
    kept = []
    for i, x in enumerate(texts):
        if not x or not any(texts[j] and ratio(x, texts[j]) > 0.85 for j in kept):
            kept.append(i)
    df = spark.createDataFrame([*enumerate(texts)], "id long, x string")
    assert sorted(r.id for r in near_text.near_first_wins(df, "id", "x", checkpoint, by_index=by_index, at_once=0).collect()) == kept
    if by_index:
        both = [{(r.later, r.earlier) for r in near_text.near_duplicate_pairs(df, "id", "x", by_index=b).collect()} for b in (False, True)]
        assert both[0] == both[1]


def test_slots_and_buckets_miss_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_blocks, "LEAST_BLOCK", 7)
    texts = [x for x in some_texts(8, 30) if x]
    df = spark.createDataFrame([*enumerate(texts)], "id long, x string")
    want = {(j, i) for i, j in itertools.combinations(range(len(texts)), 2) if ratio(texts[j], texts[i]) > 0.7}
    found = [(r.later, r.earlier) for r in near_text.near_duplicate_pairs(df, "id", "x", 0.7).collect()]
    assert len(found) == len(set(found)) and set(found) == want
