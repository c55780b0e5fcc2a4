"""Byte-level merge lists: reading the file, and the cuts of a text that merges never cross."""

from __future__ import annotations

import json
from functools import cache

import regex

# White_Space of Unicode, and how byte-level vocabularies split a text.
SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_space = "".join(rf"\u{c:04x}" for c in SPACE)
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_space}\p{{L}}\p{{N}}]+|[{_space}]+(?![^{_space}])|[{_space}]+"

LONG_TEXT = 1 << 20
_pieces = regex.compile(PIECES)
_wide_spaces = [chr(c) for c in SPACE if c > 0x7F]
_doubles = [" " + chr(c) for c in SPACE if c <= 0x7F]


def byte_letters() -> dict[str, int]:
    """The letter under which a vocabulary file writes each byte, as letter -> byte.

    Printable Latin-1 letters stand for themselves; the other bytes follow from code point 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda symbol: bytes(letters[c] for c in symbol)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        #: The id of each single byte.
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        #: (left id, right id) -> rank; a lower rank merges first. made[rank] is the id of the two together.
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = map(raw, merge if isinstance(merge, list) else merge.split(" "))
            self.ranks[self.ids[left], self.ids[right]] = rank
            self.made.append(self.ids[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        size = 1 + max([*self.ids.values(), *self.special.values()])
        #: The bytes of each id.
        self.bytes_of = [b""] * size
        for symbol, i in self.ids.items():
            self.bytes_of[i] = symbol
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()

    def symbols(self, piece: str) -> list[int]:
        """The ids of the single bytes of a piece."""
        return list(map(self.byte_ids.__getitem__, piece.encode("utf-8", "replace")))

    def segments(self, text: str):
        """(plain text, id of the special string after it or None), in order."""
        if not any(content in text for content in self.special):
            yield text, None
            return
        at = 0
        for found in self._cut_special.finditer(text):
            yield text[at : found.start()], self.special[found.group()]
            at = found.end()
        yield text[at:], None


@cache
def vocabulary(path: str) -> Vocabulary:
    """Read once in each process."""
    return Vocabulary(path)


def pieces(text: str):
    """The pieces that are merged apart from each other."""
    if len(text) < LONG_TEXT:
        return _pieces.findall(text)
    return (found.group() for found in _pieces.finditer(text))


def words(text: str):
    """(first word, words that follow a space each), or None where a single space isn't a safe cut.

    No piece reaches over a cut before a space, unless white space stands on both sides of it.
    """
    if len(text) >= LONG_TEXT or any(x in text for x in _doubles) or not text.isascii() and any(x in text for x in _wide_spaces):
        return None
    first, *rest = text.split(" ")
    return first, rest
