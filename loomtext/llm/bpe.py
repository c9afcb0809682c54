"""Pre-splitting and cached word tokens for byte-level BPE vocabularies.

Merges never cross the pieces that the pre-split makes, so the tokens of a text are those of its pieces, and each
distinct piece has to be encoded once per worker.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable



def _ranges(kinds: str) -> list[str]:
    """For each kind the code points whose general category starts with it, as the inside of a character class."""
    first = "".join([c[0] for c in map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))])
    return ["".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(f"{kind}+", first)) for kind in kinds]


#: Unicode White_Space, which `\\s` of the tokenizer's pattern means (Python's own `\\s` also takes U+001C to U+001F).
SPACE = r"\t-\r \x85\xa0  -     　"


def presplit_pattern() -> re.Pattern:
    letter, number = _ranges("LN")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


#: The same pattern for texts of ASCII characters only, whose small classes match faster.
ASCII_PRESPLIT = re.compile(r" ?[A-Za-z]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and the byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """vocab: token bytes to id; merges: pairs of token bytes in order; added: special tokens by content."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    alphabet = byte_alphabet()
    plain = lambda token: bytes(alphabet[c] for c in token)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
    return {
        "vocab": {plain(t): i for t, i in data["model"]["vocab"].items()},
        "merges": [(plain(a), plain(b)) for a, b in pairs],
        "added": {t["content"]: t["id"] for t in data["added_tokens"]},
    }


class Pieces(dict):
    """Piece to its ids as little-endian unsigned 32-bit bytes; forgets everything at `most` pieces."""

    def __init__(self, encode: Callable[[str], bytes], most: int = 400_000):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[piece] = self.encode(piece)
        return ids


class TextEncoder:
    """Whole texts to ids (little-endian unsigned 32-bit bytes); added tokens in a text are split off first."""

    def __init__(self, encode: Callable[[str], bytes], added: dict[str, int]):
        self.find_any, self.find_ascii = presplit_pattern().findall, ASCII_PRESPLIT.findall
        self.pieces = Pieces(encode)
        self.added = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def find(self, text: str) -> list[str]:
        return self.find_ascii(text) if text.isascii() else self.find_any(text)

    def __call__(self, text: str) -> bytes:
        get = self.pieces.__getitem__
        if self.at_added is not None and any(t in text for t in self.added):
            return b"".join(self.added[part] if part in self.added else b"".join(map(get, self.find(part))) for part in self.at_added.split(text))
        return b"".join(map(get, self.find(text)))
