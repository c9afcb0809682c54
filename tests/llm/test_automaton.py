"""The compiled automaton against the gadget construction done by hand, state by state, and against merging by rank."""

import itertools
import random

import pytest

from loomtext.llm import bpe_automaton

ALPHABET = [b"a", b"b", b"c"]


def small(seed, n, alphabet=ALPHABET):
    """A vocabulary of n merges, each of a pair that a random text has."""
    r = random.Random(seed)
    tokens = [r.choice(alphabet) for _ in range(4000)]
    vocab, merges = {t: i for i, t in enumerate(alphabet)}, []
    while len(merges) < n:
        pair = r.choice(list(zip(tokens, tokens[1:])))
        if pair[0] + pair[1] in vocab:
            continue
        merges.append(pair)
        vocab[pair[0] + pair[1]] = len(vocab)
        tokens = merged(tokens, pair)
    return vocab, merges


def merged(tokens, pair):
    out, i = [], 0
    while i < len(tokens):
        if tuple(tokens[i : i + 2]) == pair:
            out.append(pair[0] + pair[1])
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def by_rank(word, merges):
    tokens = [bytes([b]) for b in word]
    for pair in merges:
        tokens = merged(tokens, pair)
    return tokens


def gadgets(vocab, merges):
    """Arcs {state: {label: state}}, one gadget after the other: every state that u leads to and v leaves is copied without v."""
    arcs = {0: {t: 0 for t in vocab if len(t) == 1}}
    for u, v in merges:
        copies = {}
        for old in {a[u] for a in arcs.values() if u in a and v in arcs[a[u]]}:
            copies[old] = len(arcs)
            arcs[copies[old]] = {t: q for t, q in arcs[old].items()}
        ends = {old: arcs[old][v] for old in copies}
        for q in copies.values():
            del arcs[q][v]
        for q, own in arcs.items():
            if u in own and own[u] in copies:
                old = own[u]
                own[u] = copies[old]
                own[u + v] = ends[old]
    return arcs


@pytest.mark.parametrize("seed", range(12))
def test_table_equals_the_gadgets_done_by_hand(seed):
    vocab, merges = small(seed, 12)
    automaton, arcs = bpe_automaton.Automaton(vocab, merges), gadgets(vocab, merges)

    def paths(word, state=0):
        if not word:
            yield []
        for t, q in arcs[state].items():
            if word.startswith(t):
                yield from ([t, *rest] for rest in paths(word[len(t) :], q))

    for n in range(1, 8):
        for letters in itertools.product(ALPHABET, repeat=n):
            word = b"".join(letters)
            got = [automaton.labels[i] for i in automaton.encode(word)]
            assert [got] == list(paths(word)) and got == by_rank(word, merges)
            state = 0
            for t in got:
                assert automaton.arc(state, vocab[t])
                state = automaton.state[vocab[t]]


def test_long_words_and_runs_of_one_letter():
    for seed in range(8):
        vocab, merges = small(100 + seed, 60, [b"a", b"b"])
        automaton, r = bpe_automaton.Automaton(vocab, merges), random.Random(seed)
        for _ in range(60):
            word = b"".join(r.choice([b"a", b"b", b"aaa"]) for _ in range(r.randint(0, 60)))
            assert [automaton.labels[i] for i in automaton.encode(word)] == by_rank(word, merges)


def test_a_merge_without_occurrences_and_a_label_made_twice_are_harmless():
    vocab = {t: i for i, t in enumerate([b"a", b"b", b"c", b"ab", b"abc", b"bc"])}
    automaton = bpe_automaton.Automaton(vocab, [(b"a", b"b"), (b"ab", b"c"), (b"b", b"c"), (b"a", b"bc")])
    for n in range(1, 6):
        for letters in itertools.product(ALPHABET, repeat=n):
            word = b"".join(letters)
            assert [automaton.labels[i] for i in automaton.encode(word)] == by_rank(word, [(b"a", b"b"), (b"ab", b"c"), (b"b", b"c")])


def test_bytes_without_a_token_are_an_error():
    automaton = bpe_automaton.Automaton({b"a": 0}, [])
    assert automaton.encode(b"") == [] and automaton.encode(b"aa") == [0, 0]
    with pytest.raises(ValueError):
        automaton.encode(b"az")
