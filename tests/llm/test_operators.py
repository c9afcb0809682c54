"""Each operator against a brute-force version, on rows with nulls, empty, long and repeated texts and clashing names."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.llm import bpe_automaton, golay, graph, html_extract, iblt, language, packing, quality, simhash, substring, url_lists, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, words="the of and tion er an re in on at which there would about other their first people water called".split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) + ("" if r.random() < 0.6 else str(r.randrange(400))) + ("." if r.random() < 0.1 else "") for _ in range(n))


BASE = prose(1, 120)
TEXTS = [
    None, "", " \n\t ", "One.", "one.", "İstanbul ÄÖ x\x1cy", BASE, BASE, BASE + " tail", prose(2, 80) + " " + prose(9, 40), prose(3, 60) + " " + prose(9, 40),
    "a b " * 60, "x" * 5000, prose(4, 3000), "line one\nline one\n\nline two", BASE.replace("the", "teh", 1), "<|endoftext|> mid <|endoftext|>",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, x, f"s{i % 2}", "clash", 1) for i, x in enumerate(TEXTS)] + [(6, BASE, "s0", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row string, n_words int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def words(x):
    return WORD.findall(x or "")


# ---- 7 ------------------------------------------------------------------------------------------------------------------
def test_automaton_equals_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    automaton, encoder, added = bpe_automaton.compiled(PATH)
    r = random.Random(5)
    odd = ["".join(r.choice("aab bA1２é \n\t\x1c\x85　'slt中🙂*&") for _ in range(r.randint(0, 50))) for _ in range(400)]
    for text in [*(x or "" for x in TEXTS), *odd, "a" * 300]:
        ids = memoryview(encoder(text)).cast("I").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids
        assert automaton.decode(ids, added).decode("utf-8", "replace") == tokenizer.decode(ids, skip_special_tokens=False)
    some = [r.randrange(50257) for _ in range(50)]
    assert automaton.decode(some, added).decode("utf-8", "replace") == tokenizer.decode(some, skip_special_tokens=False)


def test_encode_documents(docs, none):
    tokenizer = Tokenizer.from_file(PATH)
    out = bpe_automaton.encode_documents(docs, PATH, keep_ids=True)
    assert out.columns == ["doc_id", "text", "source", "row", "n_words", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    for row in bpe_automaton.decode_documents(out, PATH).collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == ids and row.n_tokens == len(ids) and row.row == "clash"
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded == (row.text or "") and row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert bpe_automaton.encode_documents(none, PATH).count() == 0


# ---- 4 ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("merge", [1, 1 << 13])
def test_packing(docs, none, merge):
    encode = packing.library_encoder(PATH)
    size = 64
    rows = packing.pack_documents(docs, lambda: packing.library_encoder(PATH), size=size, open_windows=3, windows_a_merge=merge).collect()
    given = collections.Counter()
    for row in docs.collect():
        given[row.doc_id, encode(row.text or "") + bytes(4)] += 1
    by_doc = collections.defaultdict(list)
    for row in rows:
        by_doc[row.doc_id].append(row)
    for doc, pieces in by_doc.items():
        full = [(ids, n) for (d, ids), n in given.items() if d == doc]
        want = collections.Counter()
        for ids, n in full:
            want[len(ids) // 4] += n * len(ids) // 4
        got = collections.Counter()
        for p in pieces:
            got[p.doc_tokens] += p.length
            assert any(len(ids) // 4 == p.doc_tokens and zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for ids, _ in full)
        assert got == want
    sequences = collections.defaultdict(list)
    for row in rows:
        sequences[row.sequence_id].append(row)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    assert packing.pack_documents(none, lambda: packing.library_encoder(PATH), size=size).count() == 0


# ---- 3 ------------------------------------------------------------------------------------------------------------------
def test_golay_words_within_two_bits_share_an_index():
    parity, near = golay.tables()
    syndrome = lambda e: (e & 2047) ^ int(parity[e >> 11])
    sets = [{int(e) for e in row if e >= 0} for row in near]
    assert {len(s) for s in sets} == {1, 6}
    for weight in range(3):
        for bits in itertools.combinations(range(23), weight):
            d = sum(1 << b for b in bits)
            assert all(sets[s] & {e ^ d for e in sets[s ^ syndrome(d)]} for s in range(2048))


def brute_fingerprint(text):
    lowered = (text or "").translate({65 + i: 97 + i for i in range(26)})
    w = WORD.findall(lowered)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(items, near):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_simhash_components(docs, none):
    rows = simhash.simhash_components(docs).collect()
    given = docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in given]
    groups = linked(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {g: min((r.doc_id for r, x in zip(given, groups) if x == g and r.doc_id is not None), default=None) for g in groups}
    want = collections.Counter((r.doc_id, f"{p:016x}", least[g]) for r, p, g in zip(given, prints, groups))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want
    assert simhash.simhash_components(none).count() == 0


@pytest.mark.parametrize("most", [8, 512])
def test_large_keys_are_searched_exactly(most, monkeypatch):
    monkeypatch.setattr(simhash, "COMPARE_ALL", most)
    r = random.Random(1)
    base = r.getrandbits(64) & ~(((1 << 22) - 1) << 42)
    prints = np.unique(np.array([base ^ sum(1 << r.randrange(42) for _ in range(r.randrange(4))) for _ in range(200)], np.uint64))
    x, y = simhash._links_exact(2)(np.zeros(len(prints), np.int64), prints)
    want = linked(prints.tolist(), lambda a, b: (a ^ b).bit_count() <= 2)
    pairs = set(zip(x.tolist(), y.tolist()))
    assert linked(prints.tolist(), lambda a, b: (a, b) in pairs or (b, a) in pairs) == want


@pytest.mark.parametrize("most", [0, graph.MOST_IN_ONE_TASK])
def test_components_of_a_long_chain(spark, most):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (-5, -9)], "a long, b long")
    found = {r.node: r.root for r in graph.components(edges, most).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100 and found[-5] == found[-9] == -9 and len(found) == 45
    assert graph.components(edges.filter("false"), most).count() == 0


def test_drop_near_duplicates(spark):
    base = [prose(s, 150) for s in range(6)]
    rows = [(i, x) for i, x in enumerate(base)] + [(10, base[0]), (11, base[0].replace("the", "th3", 2)), (3, base[3]), (None, base[4]), (12, None), (13, ""), (14, "short one")]
    docs = spark.createDataFrame([(i, x, "k") for i, x in rows], "doc_id long, text string, fp string")
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in out.collect())
    assert got == sorted([(i, x) for i, x in enumerate(base)] + [(12, None), (14, "short one")])
    assert simhash.drop_near_duplicates(docs.filter("false")).count() == 0


def edited(r, w, kind):
    """A near copy of the words w: a tail appended, the end cut off, a block replaced or words replaced here and there."""
    n, new = len(w), lambda k: [f"n{r.randrange(10**6)}" for _ in range(k)]
    k = r.randrange(n // 20, n // 4)
    at = r.randrange(n - k)
    return {"tail": w + new(k), "cut": w[: n - k], "block": w[:at] + new(k // 2) + w[at + k // 2 :], "words": [x if r.random() > 0.02 else new(1)[0] for x in w]}[kind]


def kept_by_all_pairs(texts):
    """The least row of each group, by the Jaccard similarity of all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(x.lower()) for x in texts)]
    return {min(j for j, y in enumerate(groups) if y == x) for groups in [linked(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))] for x in groups}


def kept(spark, texts):
    return {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}


def test_near_duplicates_are_those_of_all_pairs(spark):
    r = random.Random(11)
    texts = []
    for s in range(40):
        w = words(prose(600 + s, r.randrange(150, 500)))
        texts += [" ".join(w), *(" ".join(edited(r, w, kind)) for kind in ("tail", "cut", "block", "words"))]
    r.shuffle(texts)
    assert kept(spark, texts) == kept_by_all_pairs(texts)


def test_texts_with_a_long_tail_are_near_duplicates(spark):
    r = random.Random(12)
    base = [words(prose(700 + s, 300)) for s in range(60)]
    texts = [" ".join(x) for x in base] + [" ".join(x + [f"n{r.randrange(10**6)}" for _ in range(60)]) for x in base]
    assert kept(spark, texts) == set(range(60))


def test_copies_like_their_original_alone_are_one_group(spark):
    r = random.Random(13)
    base = words(prose(800, 300))
    texts = []
    for _ in range(300):
        at = set(r.sample(range(len(base)), 6))
        texts.append(" ".join(f"n{r.randrange(10**6)}" if i in at else w for i, w in enumerate(base)))
    texts.append(" ".join(base))
    assert kept(spark, texts) == kept_by_all_pairs(texts)


def test_near_duplicates_with_one_line_repeated(spark):
    r = random.Random(14)
    line = words(prose(900, 22)) * 250
    base = [words(prose(901 + s, 6600)) for s in range(16)]
    edit = lambda w, at: w[:at] + [f"n{r.randrange(10**6)}" for _ in range(260)] + w[at + 260 :]
    texts = [" ".join(w + line) for w in base] + [" ".join(edit(w, r.randrange(6000)) + line) for w in base]
    assert kept(spark, texts) == set(range(16))


def test_shingle_sets_of_long_texts_have_no_chance_hits():
    text = " ".join(f"w{i}" for i in range(300_000)).encode()
    batch = pa.RecordBatch.from_pydict({"nid": [1], "text": pa.array([text], pa.binary())})
    (out,) = simhash._shingle_sets(5)(iter([batch]))
    assert len(np.unique(np.frombuffer(out.column("set")[0].as_py(), np.uint64))) == 300_000 - 4


# ---- 10 -----------------------------------------------------------------------------------------------------------------
def brute_repeats(texts, width):
    all_words = [words(t) for t in texts]
    counts = collections.Counter(tuple(w[i : i + width]) for w in all_words for i in range(len(w) - width + 1))
    out = []
    for w in all_words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if counts[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("width,cells", [(35, 1 << 28), (5, 1 << 16), (12, 1 << 20)])
def test_remove_repeats(docs, none, width, cells):
    given = docs.select("text").collect()
    want = collections.Counter(brute_repeats([r.text for r in given], width))
    out = substring.remove_repeats(docs, window=width, most_cells=cells)
    assert out.columns == ["doc_id", "text", "source", "row", "n_words", "n_removed", "kept_text"]
    assert collections.Counter((r.n_words, r.n_removed, r.kept_text) for r in out.collect()) == want
    assert substring.remove_repeats(none, window=width).count() == 0


@pytest.mark.parametrize("width", [35, 5])
def test_a_sketch_that_is_not_broadcast(spark, docs, none, width):
    given = docs.select("text").collect()
    out = substring.remove_repeats(docs, window=width, most_cells=1)
    assert collections.Counter((r.n_words, r.n_removed, r.kept_text) for r in out.collect()) == collections.Counter(brute_repeats([r.text for r in given], width))
    assert substring.remove_repeats(none, window=width, most_cells=1).count() == 0
    more = spark.createDataFrame([(i, prose(i, 400) + " " + prose(77 + i % 3, 50)) for i in range(60)], "doc_id long, text string").repartition(5)
    got = collections.Counter((r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(more, window=width, most_cells=1).collect())
    assert got == collections.Counter(brute_repeats([r.text for r in more.collect()], width))


# ---- 6 ------------------------------------------------------------------------------------------------------------------
def brute_base(text):
    w, text = words(text), text or ""
    triples = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_statistics(docs, none, spark):
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.quality_rules(docs, nothing).collect()
    assert collections.Counter((*(r[c] for c in quality.BASE), r.kept) for r in rows) == collections.Counter((*brute_base(r.text), not brute_base(r.text)[-1]) for r in docs.collect())
    assert quality.quality_rules(none, nothing).count() == 0


def test_quality_learns_and_keeps_clean_rows(spark):
    junk = lambda s: " ".join(w + random.Random(s).choice(["***", "$$$", "###"]) for w in prose(s, 80).split())
    rows = [(i, prose(i, 80) if i % 3 else junk(i)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 240, 2)] + [(None, 1), (500, 0), (4, None)], "doc_id long, quality int")
    held = [r for r in quality.quality_rules(docs, labels).collect() if r.doc_id % 2]
    right = [r.kept == (r.doc_id % 3 > 0) for r in held if not r.base_failed]
    assert sum(right) >= 0.98 * len(right) and all(0 <= r.quality <= 1 for r in held)


def test_quality_with_very_few_labels(spark):
    docs = spark.createDataFrame([(1, prose(1, 80)), (2, "x *** " * 60)], "doc_id long, text string")
    for given in ([(1, 1)], [(1, 1), (2, 0)], [(1, None), (None, 0)]):
        rows = quality.quality_rules(docs, spark.createDataFrame(given, "doc_id long, quality int")).collect()
        assert len(rows) == 2 and all((r.quality is None) == (len(given) == 1 or given[0][1] is None) for r in rows)


# ---- 8 ------------------------------------------------------------------------------------------------------------------
def test_language_mixture(spark):
    kinds = {"xx": "kala moro tinka suva renok paluta".split(), "yy": "gruz wertz schlang knopf pflug zwirn".split()}
    text = lambda lang, s, n=40: prose(s, n, kinds[lang]).translate(str.maketrans("", "", "0123456789"))
    rows = [(i, text("xx" if i % 2 else "yy", i), "xx" if i % 2 else "yy") for i in range(80)]
    model = language.train(spark.createDataFrame([*rows, (900, "zzz", None), (901, None, "xx")], "doc_id long, text string, lang string"))
    assert model[0] == ["xx", "yy"]
    mixed = text("xx", 500, 60) + " " + text("yy", 501, 20)
    test = [(1, text("xx", 1000)), (2, text("yy", 1001)), (3, mixed), (4, None), (5, ""), (6, "12 !!"), (7, text("xx", 1000))]
    docs = spark.createDataFrame([(i, x, 0.5) for i, x in test], "doc_id long, text string, score double")
    out = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 7)] == ["xx", "yy", "xx", "und", "und", "und", "xx"]
    assert out[1].score == 1.0 and 0.65 < out[3].score < 0.85 and out[4].score == 0.0
    empty = language.train(docs.limit(0).select("text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}


# ---- 9 ------------------------------------------------------------------------------------------------------------------
def brute_units(text):
    return {p for p in re.split(r"(?<=[.!?])\s+|\n+", text or "") if re.search(r"\S", p)}


def test_iblt_fingerprints(spark, docs, none):
    given = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)] + [(100 + i, prose(i, 150) + "\n" + prose(900, 60)) for i in range(20)], "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r for r in iblt.compare_versions(iblt.with_next(given)).collect()}
    order = sorted((r.doc_id, r.text or "") for r in given.collect())
    like = lambda a, b: 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0
    for (i, x), (_, y) in zip(order, order[1:] + order[:1]):
        cut = len(x) // 4
        edited = x[: len(x) - cut] + y[:cut]
        r = rows[i]
        assert r.n_chars == len(x) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(brute_units(x), brute_units(edited))) and r.near_next == pytest.approx(like(brute_units(x), brute_units(y)))
    assert rows[6].fingerprint == rows[7].fingerprint != rows[13].fingerprint
    assert iblt.compare_versions(iblt.with_next(docs)).count() == docs.count()
    assert iblt.compare_versions(iblt.with_next(none)).count() == 0


def test_iblt_next_row_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(iblt, "BUCKET_BYTES", 300)
    docs = spark.createDataFrame([(i * i, f"text {i} " + "x" * (i % 50)) for i in range(100)] + [(None, "last")], "doc_id long, text string")
    got = {r.text: r.next_text for r in iblt.with_next(docs).collect()}
    order = [r.text for r in sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))]
    assert got == dict(zip(order, order[1:] + order[:1]))


# ---- 5 ------------------------------------------------------------------------------------------------------------------
def test_url_lists(spark):
    entries = spark.createDataFrame(
        [("bad.org", "add", "2024-01-10"), ("bad.org", "remove", "2024-02-01"), ("bad.org", "add", "2024-03-01"), ("ok.net/ads/", "add", "2024-01-01"), ("tie.com", "add", "2024-01-05"), ("tie.com", "remove", "2024-01-05"), (None, "add", "2024-01-01"), ("x.org", "what", "2024-01-01")],
        "pattern string, action string, day string",
    )
    urls = [
        ("http://a.bad.org/x", "2024-01-09", False), ("http://a.bad.org/x", "2024-01-10", True), ("https://u@BAD.org:80/", "2024-01-31", True), ("http://bad.org", "2024-02-01", False),
        ("http://bad.org/", "2024-03-05", True), ("http://notbad.org/", "2024-01-15", False), ("http://ok.net/ads/1?x", "2024-01-02", True), ("http://ok.net/adsense/1", "2024-01-02", False),
        ("http://tie.com/", "2024-01-06", False), (None, "2024-01-06", False), ("http://bad.org/", None, False), ("nothing", "2024-01-15", False), ("http://a.bad.org/x", "2024-01-10", True),
    ]
    captures = spark.createDataFrame([(i, u, d, "extra") for i, (u, d, _) in enumerate(urls)], "page_id long, url string, fetched_on string, host string")
    for bound in (url_lists.MOST_BROADCAST, 0):
        out = {r.page_id: r for r in url_lists.filter_captures(captures, entries, most_broadcast=bound).collect()}
        assert [out[i].blocked for i in range(len(urls))] == [b for *_, b in urls]
        assert out[6].matched_pattern == "ok.net/ads/" and str(out[4].listed_since) == "2024-03-01"
    assert not any(r.blocked for r in url_lists.filter_captures(captures, entries.filter("false")).collect())
    assert url_lists.filter_captures(captures.filter("false"), entries).count() == 0


# ---- 1 ------------------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 10 + "é</p>"
    rows = [(5, "http://a/5", big), (2, "http://a/2", big), (9, None, big), (1, "http://a/1", None), (3, "http://a/3", ""), (4, "u\r\nx: y", "short"), (7, "u", "short"), (None, "u", big), (2, "http://a/2", big)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, type string").repartition(3)
    warc.write_captures(pages, str(tmp_path / "w"), records_a_file=2)
    out = warc.captures(spark, str(tmp_path / "w")).collect()
    assert len(out) == len(rows) and all(len(r.requests) == 1 and len(r.metadata) == 1 for r in out)
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to_page) for r in out)
    want = collections.Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        response = len(data) < 100 or page == 2
        want[page, len(data), hashlib.sha256(data).hexdigest(), "response" if response else "revisit", None if response else 2] += 1
    assert got == want
    assert {r.block.decode() for r in out if r.type == "response"} == {"", "short", big}
    slim = warc.captures(spark, str(tmp_path / "w"), with_block=False).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to_page) for r in slim) == got
    empty = shared = str(tmp_path / "e")
    warc.write_captures(pages.filter("false"), empty)
    assert warc.captures(spark, shared).count() == 0


def test_assembly_from_either_side(spark):
    rows = [("<a>", "response", "<q>", None), ("<q>", "request", None, None), ("<b>", "response", None, None), ("<m1>", "metadata", "<b>", None), ("<m2>", "metadata", "<b>", None), ("<q2>", "request", "<b>", None), ("<lost>", "metadata", "<none>", None), ("<i>", "warcinfo", None, None)]
    records = spark.createDataFrame([(a, b, c, d, None, None, None, 0, None, None, True) for a, b, c, d in rows], warc.RECORD)
    out = {r.record_id: r for r in warc.assemble(records).collect()}
    assert set(out) == {"<a>", "<b>"} and [x.record_id for x in out["<a>"].requests] == ["<q>"]
    assert [x.record_id for x in out["<b>"].metadata] == ["<m1>", "<m2>"] and [x.record_id for x in out["<b>"].requests] == ["<q2>"]


# ---- 2 ------------------------------------------------------------------------------------------------------------------
ARTICLE = "<p>One sentence, with commas, and a &lt;tag&gt; &amp; more text to read in this paragraph.</p>" * 3


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain  &amp; text", "plain & text"), ("<p>a<p>b<br>c", "a\n\nb c"),
        ("<nav><ul><li><a href=x>Menu</a></li></ul></nav><article><h1>T</h1><p>x</p></article><footer>f</footer>", "T\n\nx"),
        ("<script>var a='<p>no</p>';</script><style>p{}</style><main><p>yes, it, is</p></main><!-- <p>no</p> -->", "yes, it, is"),
        ("<div class='ad'>buy</div><div id=content><p>Body, of, text.</p><form><input><p>mail</p></form></div><div class=comments><p>nice, one, there</p></div><aside><p>side, bar</p></aside>", "Body, of, text."),
        ("<article><p>kept, text</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "kept, text\n\none\n\ntwo\n\nc1\n\nc2"),
        ("<div id=main><p class=notice>read this<p>Kept, one, two.<p class=ad>x</div><p>tail", "Kept, one, two."),
        ("<div class='entry-header'><h1>Own</h1></div><div class=entry><p>Text, a, b, c.</p></div>", "Own\n\nText, a, b, c."),
        ("<article><p>seen</p><p hidden>gone</p><p class='hidden-xs'>still</p><div style='display: none'>no</div></article>", "seen\n\nstill"),
        ("<article><p>open <b>bold <p>next</article>", "open bold\n\nnext"), ("<article><p>a<!-- never closed", "a"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def test_link_lists_of_the_article_stay_and_menus_go():
    links = "<a href=/a>Smith 2001, On the measure of rivers</a>"
    kept = f"<ul><li>{links}</ul><table><tr><td>{links}</table><dl><dt>{links}</dl><div>See {links}</div>"
    gone = "".join(f"<{x}><ul><li><a href=/m>Menu</a></ul></{x.split()[0]}>" for x in ("nav", "div class=related", "section class=share", "div role=navigation"))
    page = f"<article><h1>Title</h1>{ARTICLE}{kept}{gone}</article>"
    text = html_extract.main_text(page)
    assert text.count("On the measure of rivers") == 4 and "Menu" not in text


def test_extraction_keeps_the_container_and_drops_the_rest(spark):
    page = f"<html><head><title>t</title></head><body><header><a href=/>Home</a></header><div class=sidebar>{ARTICLE}</div><div class=post><h1>Title</h1>{ARTICLE}</div><div id=cookie-notice><p>cookies, yes</p></div></body></html>"
    pages = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (1, "u", page, "x"), (None, "u", "<p>" * 3000 + "deep", "x")], "page_id long, url string, html string, text string")
    rows = html_extract.extract_main_text(pages).collect()
    want = "Title\n\n" + "\n\n".join(["One sentence, with commas, and a <tag> & more text to read in this paragraph."] * 3)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == sorted([(1, want, len(want)), (1, want, len(want)), (2, "", 0), (0, "deep", 4)])
    assert html_extract.extract_main_text(pages.filter("false")).count() == 0
