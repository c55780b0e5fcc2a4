"""Byte-level BPE by rank files: longest matches, backtracking, and a memo of which tokens may stand side by side.

The encoding of a piece is the one row of tokens in which every two neighbours are *compatible*: merging the bytes of
the two, alone, gives just these two again. (Merges of a piece never cross the ends of its final tokens, so what two
neighbours do doesn't depend on the rest.) So a piece needs no merging: an automaton finds the longest token that begins
at each byte, the longest compatible one is taken, and where no token fits, the last one taken makes way for a
shorter one. A place that led nowhere is marked and not entered again, so each is left at most once and the time
is linear in the piece. Bytes are written as Latin-1 letters, as the automaton works on text.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cyclewise.llm import texts

# Ids decoded at a time.
DECODE_STEP = 1 << 16
# Texts from this length on are cut into pieces one after the other.
LONG_TEXT = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank, which is its id as well."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def compiled(pattern: str) -> regex.Pattern:
    r"""The pattern of pieces, where ``\s`` stands for Unicode's White_Space (this library's own has four letters more)."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class RankTable:
    """Tokens by Latin-1 text, the automaton over them, and which of them may be neighbours."""

    def __init__(self, path: str):
        self.ids = {token.decode("latin-1"): rank for token, rank in read_ranks(path).items()}
        missing = [b for b in range(256) if chr(b) not in self.ids]
        if missing:
            raise ValueError(f"{path} lacks single bytes: {missing[:5]}")
        self.text_of = {rank: token for token, rank in self.ids.items()}
        # The automaton tells matches by where they end; over reversed tokens and text that is where they begin.
        self._automaton = ahocorasick.Automaton()
        for token in self.ids:
            self._automaton.add_word(token[::-1], token)
        self._automaton.make_automaton()
        self._shorter = {token: self._next_shorter(token) for token in self.ids}
        self.compatible = texts.Memo(self._compatible)

    def _next_shorter(self, token: str) -> str | None:
        """The longest other token that the token begins with."""
        return next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), None)

    def merged(self, text: str) -> list[str]:
        """Plain merging, lowest rank first and from the left; only for the bytes of two tokens."""
        parts, get, none = list(text), self.ids.get, len(self.ids)
        while len(parts) > 1:
            ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]
            if (lowest := min(ranks)) == none:
                break
            i = ranks.index(lowest)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _compatible(self, pair: tuple[str, str]) -> bool:
        return self.merged(pair[0] + pair[1]) == [*pair]

    def encode(self, data: str) -> list[int]:
        """Ids of one piece, written in Latin-1."""
        if (whole := self.ids.get(data)) is not None:
            return [whole]
        end, shorter, compatible = len(data), self._shorter, self.compatible
        # Matches at one place come longest first; of equal keys a dict keeps the last, so the list is turned round.
        longest = dict(reversed(list(self._automaton.iter(data[::-1]))))
        open_ends = bytearray(b"\1") * (end + 1)
        taken: list[str] = []
        at, token = 0, longest[end - 1]
        while True:
            before = taken[-1] if taken else None
            while token is not None and not (open_ends[at + len(token)] and (before is None or compatible[before, token])):
                token = shorter[token]
            if token is not None:
                taken.append(token)
                at += len(token)
                if at == end:
                    return list(map(self.ids.__getitem__, taken))
                token = longest[end - 1 - at]
            elif before is None:
                raise ValueError(f"no row of tokens for a piece of {end} bytes")
            else:
                open_ends[at] = 0
                taken.pop()
                at -= len(before)
                token = shorter[before]


@cache
def table(path: str) -> RankTable:
    """Read once in each process."""
    return RankTable(path)


class Encoder:
    """Whole texts to ids, each as four bytes, the lowest first. Pieces of up to 256 characters are remembered."""

    def __init__(self, path: str, pattern: str):
        self._table, self._pattern = table(path), compiled(pattern)
        self._pieces = texts.Memo(self._piece)

    def _piece(self, piece: str) -> bytes:
        return array("I", self._table.encode(piece.encode("utf-8", "replace").decode("latin-1"))).tobytes()

    def packed(self, text: str) -> bytes:
        if len(text) < LONG_TEXT:
            return b"".join(map(self._pieces.__getitem__, self._pattern.findall(text)))
        return b"".join(self._pieces[found.group()] for found in self._pattern.finditer(text))


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


class Decoder:
    """Ids to bytes, a bounded part at a time."""

    def __init__(self, path: str):
        known = table(path).text_of
        self._bytes_of = {rank: token.encode("latin-1") for rank, token in known.items()}

    def parts(self, ids: np.ndarray):
        for start in range(0, len(ids), DECODE_STEP):
            yield b"".join(map(self._bytes_of.__getitem__, ids[start : start + DECODE_STEP].tolist()))


@cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, path: str, pattern: str, *keep: str, text: str = "text") -> DataFrame:
    """``ids`` (array of int) and ``n_tokens`` of every text, beside the columns in ``keep``.

    Null and empty texts have no ids. There are no special tokens: their strings are ordinary text. Rows are independent of
    each other, repeated rows stay, and columns not named are not read.
    """

    def make():
        machine = encoder(path, pattern)

        def run(batch):
            packed = [machine.packed(t) for t in batch]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
            values = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
            return {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)), "n_tokens": np.diff(ends)}

        return run

    return texts.per_text(docs, make, "ids array<int>, n_tokens bigint", *keep, text=text)


def decode(rows: DataFrame, path: str, *keep: str, ids: str = "ids") -> DataFrame:
    """``text`` of every list of ids (bytes that aren't UTF-8 become U+FFFD); null lists give null, unknown ids an error."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(batches):
        machine = decoder(path)
        for batch in batches:
            lists = batch.column(len(keep))
            told = (b"".join(machine.parts(np.asarray(x.values, dtype=np.int64))) if x.is_valid else None for x in lists)
            out = [None if x is None else x.decode("utf-8", "replace") for x in told]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.string())], names=[*keep, "text"])

    return texts.whole_texts(rows, *keep, ids).mapInArrow(run, ", ".join(x for x in (kept, "text string") if x))


def round_trip(docs: DataFrame, path: str, pattern: str, *keep: str, text: str = "text") -> DataFrame:
    """n_tokens, ids_sha256 (of the ids as four bytes each, lowest first) and decoded_sha256 (of the decoded bytes).

    Nulls and repeated rows are treated as in ``encode``.
    """

    def make():
        machine, back = encoder(path, pattern), decoder(path)

        def run(batch):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in batch:
                packed = machine.packed(t)
                ids = np.frombuffer(packed, dtype="<u4")
                decoded = hashlib.sha256()
                for part in back.parts(ids):
                    decoded.update(part)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                out["decoded_sha256"].append(decoded.hexdigest())
            return out

        return run

    return texts.per_text(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", *keep, text=text)
