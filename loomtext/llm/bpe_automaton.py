"""BPE encoding and decoding by a deterministic tokenization automaton.

Compilation starts from the automaton with one state that loops on every byte and adds one gadget per merge (u, v) -> w,
in order of priority: u is led to a copy of its state without the arc v, and an arc w is added beside every arc u, to where v led.
All arcs with one label lead to one state, so the automaton is a state for each label and a table, label by state, of the arcs
that gadgets took away. Rows of the table are bit strings: an arc w beside every arc u is a row for w equal to that of u. For a copied
state not to be a change of every row, copies exist from the start and are changed along with their original up to their own gadget.

The automaton accepts one token path for each byte string, the one that the merges give. Its labels are spelled by a byte trie. Encoding
goes over the places of a word once: from each, with the state that it was reached in, labels are followed through the trie, and where one ends
whose arc the table has, that place gets the label's state. Exactly one arc leads to each place, so there is nothing to choose or to take
back; the path is read off from the end. Decoding writes the labels of the ids.

Ties and repeats: equal texts have equal ids. A null text counts as empty: no ids. Very long texts are encoded whole; a
piece without spaces takes memory in proportion to its length. Added tokens in a text get their own id, as in the
tokenizers library. Other columns are kept; those with the names of result columns give way to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm import bpe
from loomtext.llm.common import packed, table, trimmed, unpacked

MADE = ["n_tokens", "ids_sha256", "decoded_sha256"]
#: The key of a label in a node of the trie, beside bytes.
LABEL = -1


class Automaton:
    """Compiled merges: the trie of labels, state[label], and gone[label], the bits of states without that arc."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.labels = {i: t for t, i in vocab.items()}
        self.vocab, self.longest = vocab, max(map(len, vocab))
        gadgets = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
        self.state, lost, self.states = self._copies(gadgets)
        self.gone = self._rows(gadgets, lost)
        self.trie: dict = {}
        for token, i in vocab.items():
            if i in self.state:
                node = self.trie
                for byte in token:
                    node = node.setdefault(byte, {})
                node[LABEL] = i

    def _copies(self, gadgets: list[tuple[int, int, int]]) -> tuple[dict[int, int], list[int], int]:
        """The state that each label leads to; for each gadget the bits of the states that lose its arc v; the number of states."""
        state = {i: 0 for t, i in self.vocab.items() if len(t) == 1}
        leading = [len(state) + 1]  # the start leads to state 0, too
        changed: list[tuple[int, int]] = []  # by each gadget: the state without v, and the one that it was copied from
        for u, v, w in gadgets:
            old = own = state[u]
            if leading[old] > 1 or u == v:
                own = len(leading)
                leading.append(1)
                leading[old] -= 1
                state[u] = own
            if w not in state:  # of merges with equal results the first makes the label
                state[w] = old if u == v else state[v]
                leading[state[w]] += 1
            changed.append((own, old))
        twins = [1 << q for q in range(len(leading))]  # a state and the copies that it will have
        lost = []
        for own, old in reversed(changed):
            lost.append(twins[own])
            if own != old:
                twins[old] |= twins[own]
        return state, lost[::-1], len(leading)

    def _rows(self, gadgets: list[tuple[int, int, int]], lost: list[int]) -> list[bytes]:
        gone = {i: 0 for t, i in self.vocab.items() if len(t) == 1}
        nowhere = (1 << self.states) - 1
        for (u, v, w), states in zip(gadgets, lost, strict=True):
            idle = states & ~gone[v] == 0  # u never leads to v, so nothing is merged
            gone[v] |= states
            if w not in gone:
                gone[w] = nowhere if idle else gone[u]
        rows = {bits: bits.to_bytes(self.states + 7 >> 3, "little") for bits in set(gone.values())}
        return [rows[gone[i]] if i in gone else rows.setdefault(nowhere, b"\xff" * (self.states + 7 >> 3)) for i in range(max(self.vocab.values()) + 1)]

    def arc(self, state: int, label: int) -> bool:
        return not self.gone[label][state >> 3] >> (state & 7) & 1

    def encode(self, word: bytes) -> list[int]:
        if not word:
            return []
        gone, state_of, n = self.gone, self.state, len(word)
        whole = self.vocab.get(word)
        if whole in state_of and not gone[whole][0] & 1:  # an arc from the start to the end
            return [whole]
        states, arcs, back = [0] + [-1] * n, [-1] * (n + 1), [0] * (n + 1)
        for at in range(n):
            state = states[at]
            if state < 0:
                continue
            cell, bit, node, end = state >> 3, 1 << (state & 7), self.trie, at
            for byte in word[at : at + self.longest]:
                node = node.get(byte)
                if node is None:
                    break
                end += 1
                label = node.get(LABEL)
                if label is not None and not gone[label][cell] & bit:
                    states[end], arcs[end], back[end] = state_of[label], label, at
        path, at = [], len(word)
        while at:
            if arcs[at] < 0:
                raise ValueError("a byte of the text is in no token")
            path.append(arcs[at])
            at = back[at]
        return path[::-1]

    def decode(self, ids: list[int], added: dict[int, bytes]) -> bytes:
        labels = self.labels
        return b"".join([labels[i] if i in labels else added[i] for i in ids])


def compiled(path: str) -> tuple[Automaton, bpe.TextEncoder, dict[int, bytes]]:
    data = bpe.load(path)
    automaton = Automaton(data["vocab"], data["merges"])

    def encode(piece: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in automaton.encode(piece.encode())])

    return automaton, bpe.TextEncoder(encode, data["added"]), {i: t.encode() for t, i in data["added"].items()}


def _digests(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, encoder, added = compiled(path)
        labels = automaton.labels | added
        decimal = {i: str(i).encode() for i in labels}
        for batch in batches:
            n, sha, back, all_ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = memoryview(encoder(text.decode() if text else "")).cast("I").tolist()
                n.append(len(ids))
                sha.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest())
                decoded = b"".join(map(labels.__getitem__, ids))
                back.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
                if keep:
                    all_ids.append(ids)
            columns = [batch.column("text"), batch.column("row"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["text", "row", *MADE]
            if keep:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, and the ids themselves if keep_ids."""
    rows = packed(docs, text_col)
    made = MADE + ["ids"] * keep_ids
    schema = T.StructType(rows.schema.fields + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return unpacked(rows.mapInArrow(trimmed(_digests(path, keep_ids)), schema), docs, text_col, made)


def decode_documents(docs: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """docs with `decoded`, the text of their ids (null ids: null)."""

    @F.pandas_udf(T.StringType())
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, _, added = compiled(path)
        for ids in parts:
            yield ids.map(lambda x: None if x is None else automaton.decode(list(x), added).decode("utf-8", "replace"))

    return docs.withColumn("decoded", decoded(F.col(ids_col)))


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", *MADE)
