"""The license scan against plain counting, plain matching statistics and plain chains."""

import itertools
import random

import pytest
from pyspark.sql import Row

from loomtext.llm import licenses
from loomtext.llm.licenses import BASE, TEMPLATES, Match, Scanner, SuffixAutomaton, chained, scan_licenses, words_of


def plain_base(words):
    phrases = {tuple(p.encode().split()): label for p, label in BASE.items()}
    return sorted((i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p)


def has(sequences, part):
    return any(part == s[i : i + len(part)] for s in sequences for i in range(len(s) - len(part) + 1))


@pytest.mark.parametrize("seed", range(20))
def test_matching_statistics_and_places_equal_brute_force(seed):
    r = random.Random(seed)
    sequences = [[r.randint(1, 3) for _ in range(r.randint(1, 14))] for _ in range(4)]
    automaton, text = SuffixAutomaton(sequences), [r.randint(1, 4) for _ in range(60)]
    for end, (q, n) in enumerate(automaton.statistics(text), 1):
        assert n == max(k for k in range(end + 1) if k == 0 or has(sequences, text[end - k : end]))
        if n:
            part = text[end - n : end]
            assert automaton.ends[q] == sorted((t, i) for t, s in enumerate(sequences) for i in range(n, len(s) + 1) if s[i - n : i] == part)


@pytest.mark.parametrize("seed", range(20))
def test_the_best_chain_equals_all_chains_tried(seed):
    r, gap = random.Random(seed), 3
    ends = sorted(r.sample(range(4, 40), 8))
    starts = sorted(max(0, e - r.randint(2, 6)) for e in ends)
    matches = [Match(s, e, r.randint(0, 20)) for s, e in zip(starts, ends) if e - s > 1]

    def covered(chain):
        total = chain[0].end - chain[0].start
        for a, b in itertools.pairwise(chain):
            if not (a.start < b.start and a.at < b.at and b.start <= a.end + gap) or b.gain(a) <= 0:
                return 0
            total += b.gain(a)
        return total

    best = max(covered(c) for n in range(1, len(matches) + 1) for c in itertools.combinations(matches, n))
    found = chained(matches, gap)
    assert max(n for *_, n in found) == best
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(found))


def test_base_places_are_those_of_plain_counting():
    r, scanner = random.Random(3), Scanner()
    parts = ["CC BY", "general", "public license", "General Public License", "all rights", "reserved", "All Rights Reserved.", "x", "é", "license", "cc-by 4", "the GNU"]
    for _ in range(300):
        text = r.choice([" ", "\n", "--"]).join(r.choices(parts, k=r.randint(0, 12)))
        words, found = words_of(text.encode()), scanner.scan(text.encode())
        places = plain_base(words)
        assert (found["n_words"], found["n_base"]) == (len(words), len(places))
        assert (found["first_word"], found["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert found["base_labels"] == ",".join(sorted({p[1] for p in places}))
        assert set(filter(None, found["base_labels"].split(","))) <= set(found["labels"].split(","))


@pytest.mark.parametrize(("label", "at"), [(k, i) for k, v in TEMPLATES.items() for i in range(len(v))])
def test_a_template_in_other_text_is_one_whole_span(label, at):
    text = f"Some prose before that. {TEMPLATES[label][at].upper()} And prose after."
    found = Scanner().scan(text.encode())
    assert label in found["labels"].split(",") and found["score"] == 1.0
    sizes = len(words_of(TEMPLATES[label][at].encode()))
    assert any(s["label"] == label and s["covered"] == sizes and s["first_word"] == 4 for s in found["spans"])


def test_changed_words_and_line_comments_stay_one_span():
    words = TEMPLATES["mit"][2].split()
    words[20] = "program"
    del words[41:43]
    text = "\n".join("// " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    found = Scanner().scan(text.encode())
    mit = [s for s in found["spans"] if s["label"] == "mit" and s["template"] == 2]
    assert len(mit) == 1 and found["labels"] == "mit" and 0.9 < mit[0]["coverage"] < 1


def test_two_copies_are_two_spans_and_a_half_is_no_label():
    one = TEMPLATES["mit"][0]
    assert [s["first_word"] for s in Scanner().scan(f"{one}. {one}.".encode())["spans"] if s["template"] == 0] == [0, 5]
    half = " ".join(TEMPLATES["unlicense"][0].split()[:6])
    assert Scanner().scan(half.encode())["labels"] == "" and 0.4 < Scanner().scan(half.encode())["score"] < 0.7


def test_other_templates_and_none():
    scanner = Scanner(templates={"own": ["one two three"]}, base={})
    assert scanner.scan(b"zero one two three four")["labels"] == "own"
    assert Scanner(templates={}).scan(b"cc by")["labels"] == "cc-by"
    with pytest.raises(ValueError):
        Scanner(templates={"none": ["--"]})


def test_odd_rows_and_clashing_columns(spark):
    long = "word " * 200_000 + "all rights reserved"
    rows = [Row(doc_id=1, text=None, score="s", row=1), Row(doc_id=1, text="", score=None, row=None), Row(doc_id=None, text=long, score="x", row=2), Row(doc_id=None, text=long, score="x", row=2)]
    out = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, score string, row int"))
    assert out.columns == ["doc_id", "text", "row", *licenses.MADE]
    got = sorted(tuple(r) for r in out.select("row", "n_words", "n_base", "first_word", "base_labels", "score").fillna(-1, ["row", "first_word"]).collect())
    assert got == [(-1, 0, 0, -1, "", 0.0), (1, 0, 0, -1, "", 0.0), (2, 200_003, 1, 200_000, "reserved", 1.0), (2, 200_003, 1, 200_000, "reserved", 1.0)]
    assert scan_licenses(spark.createDataFrame([], "text string, doc_id long")).collect() == []


def test_the_query_equals_plain_counting_on_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = licenses.op11_license_automaton(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = words_of((docs[r.doc_id] or "").encode())
        places = plain_base(words)
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({p[1] for p in places})))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
