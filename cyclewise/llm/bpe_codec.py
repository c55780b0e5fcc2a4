"""Byte-pair encoding as a streaming transducer, and decoding as a byte-to-text state machine.

Merges only happen inside pieces (see ``vocab.pieces``). A piece is read byte by byte into a buffer. The merge list
gives a *sufficient lookahead*: a number of bytes L such that what follows more than L bytes behind a token's end cannot
change it. Tokens that far from the buffer's end are stable, are emitted and leave the buffer, so that memory stays
constant for pieces of any length.

Why L is sufficient: a merge of (u, v) that is possible at some place is prevented from the right only by a merge of lower
rank whose left part is that v. Whether that one happens depends on the bytes of its right part w, on what in turn
prevents the merges along the right edge of w, and on what prevents it itself, always with falling rank. So the reach
of every merge follows from those of lower rank, in one pass over the list.
"""

from __future__ import annotations

import codecs
import hashlib
from array import array
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cyclewise.llm import texts, vocab

# Bytes a buffer takes in beyond the lookahead before stable tokens are emitted.
STEP = 4096
DECODE_STEP = 4096
# Characters of a piece, or pieces of a text, that are taken in at a time.
PART = 1 << 14


def lookahead(vocabulary: vocab.Vocabulary) -> int:
    """Bytes behind the end of a token after which nothing can change it any more."""
    length = [len(b) for b in vocabulary.bytes_of]
    edge = [0] * len(length)  # by token: what its own right edge needs to see
    beats = [0] * len(length)  # by left part: the farthest sight of any merge so far that takes it away
    last = 0
    for (u, v), rank in sorted(vocabulary.ranks.items(), key=lambda m: m[1]):
        made = vocabulary.made[rank]
        sight = beats[v]  # this merge is prevented by earlier ones that take v
        edge[made] = max(edge[made], sight, edge[v])
        reach = length[v] + max(sight, edge[v])
        beats[u] = max(beats[u], reach)
        last = max(last, reach, edge[made])
    return last


def merged(symbols: list[int], vocabulary: vocab.Vocabulary) -> list[int]:
    """All merges of a list of symbols: again and again the pair of lowest rank, from the left."""
    if len(symbols) > 64:
        return merged_long(symbols, vocabulary)
    get, made, none = vocabulary.ranks.get, vocabulary.made, len(vocabulary.made)
    ranks = [get(pair, none) for pair in zip(symbols, symbols[1:])]
    while ranks and (rank := min(ranks)) < none:
        i = ranks.index(rank)
        symbols[i : i + 2] = (made[rank],)
        del ranks[i]
        if i:
            ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
        if i < len(ranks):
            ranks[i] = get((symbols[i], symbols[i + 1]), none)
    return symbols


def merged_long(symbols: list[int], vocabulary: vocab.Vocabulary) -> list[int]:
    """As ``merged``, for a buffer of some thousand symbols: one rank after the other over arrays."""
    row, none = np.array(symbols, dtype=np.int64), len(vocabulary.made)
    while len(row) > 1:
        kinds, kind_of = np.unique((row[:-1] << 32) | row[1:], return_inverse=True)
        ranks = [vocabulary.ranks.get((p >> 32, p & 0xFFFFFFFF), none) for p in kinds.tolist()]
        rank = min(ranks)
        if rank == none:
            break
        best = ranks.index(rank)
        at = np.flatnonzero(kind_of == best)
        if kinds[best] >> 32 == kinds[best] & 0xFFFFFFFF:  # in runs of one symbol every other pair merges, from the left
            begins = np.r_[True, np.diff(at) > 1]
            at = at[(at - at[begins][np.cumsum(begins) - 1]) % 2 == 0]
        row[at] = vocabulary.made[rank]
        row = np.delete(row, at + 1)
    return row.tolist()


class Transducer:
    """Bytes of one piece in, stable token ids out."""

    def __init__(self, vocabulary: vocab.Vocabulary, step: int = STEP, ahead: int | None = None):
        self._vocabulary, self._buffer = vocabulary, bytearray()
        self._ahead = lookahead(vocabulary) if ahead is None else ahead
        self._step = step

    def feed(self, data: bytes):
        """Token ids that have become stable."""
        for start in range(0, len(data), self._step):
            self._buffer += data[start : start + self._step]
            if len(self._buffer) >= self._ahead + self._step:
                yield from self._stable()

    def _tokens(self) -> list[int]:
        return merged(list(map(self._vocabulary.byte_ids.__getitem__, self._buffer)), self._vocabulary)

    def _stable(self):
        sizes, end, limit = self._vocabulary.bytes_of, 0, len(self._buffer) - self._ahead
        for token in self._tokens():
            size = len(sizes[token])
            if end + size > limit:
                break
            end += size
            yield token
        del self._buffer[:end]

    def finish(self):
        """The rest, at the end of the piece."""
        yield from self._tokens()
        self._buffer.clear()


class Encoder:
    """Whole texts to ids, each as four bytes, the lowest first.

    Every piece goes through the transducer; what it gave for a short one (and for a word, which is a piece or few) is
    remembered for the next time. A long text is cut into pieces as they are needed.
    """

    def __init__(self, path: str, step: int = STEP):
        self.vocabulary = vocab.vocabulary(path)
        self._ahead, self._step = lookahead(self.vocabulary), step
        self._pieces = texts.Memo(lambda piece: b"".join(self._stream(piece)))
        self._words = texts.Memo(lambda word: self._plain(" " + word))

    def _stream(self, piece: str):
        """The ids of one piece as they become stable."""
        machine = Transducer(self.vocabulary, self._step, self._ahead)
        for start in range(0, len(piece), PART):
            yield array("I", machine.feed(piece[start : start + PART].encode("utf-8", "replace"))).tobytes()
        yield array("I", machine.finish()).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, vocab.pieces(text)))

    def _long(self, text: str):
        """The ids of a text whose pieces aren't all known beforehand, some pieces at a time."""
        rest = iter(vocab.pieces(text))
        while some := list(islice(rest, PART)):
            short: list[bytes] = []
            for piece in some:
                if len(piece) <= texts.Memo.LONGEST:
                    short.append(self._pieces[piece])
                else:
                    yield b"".join(short)
                    short.clear()
                    yield from self._stream(piece)
            yield b"".join(short)

    def parts(self, text: str):
        """The ids of a text, a bounded number at a time."""
        for plain, special in self.vocabulary.segments(text):
            if (cut := vocab.words(plain)) is None:
                yield from self._long(plain)
            else:
                yield self._plain(cut[0]) + b"".join(map(self._words.__getitem__, cut[1]))
            if special is not None:
                yield special.to_bytes(4, "little")

    def packed(self, text: str) -> bytes:
        return b"".join(self.parts(text))


class Decoder:
    """Ids in, text out; bytes of a character that isn't complete wait for the next ids. Wrong bytes become U+FFFD."""

    def __init__(self, path: str):
        self._bytes_of = vocab.vocabulary(path).bytes_of
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        return self._state.decode(b"".join(map(self._bytes_of.__getitem__, ids.tolist())))

    def finish(self) -> str:
        """What is left of the text; the next ids begin a new one."""
        rest = self._state.decode(b"", True)
        self._state.reset()
        return rest

    def parts(self, ids: np.ndarray):
        """The text of ``ids``, a bounded part at a time."""
        for start in range(0, len(ids), DECODE_STEP):
            yield self.feed(ids[start : start + DECODE_STEP])
        yield self.finish()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, *keep: str, text: str = "text") -> DataFrame:
    """``ids`` (array of int) and ``n_tokens`` of every text, beside the columns in ``keep``.

    Null and empty texts have no ids. Special strings inside a text become their special id. Rows are independent of each
    other: repeated rows stay, other columns are neither read nor looked at.
    """

    def make():
        machine = encoder(path)

        def run(batch):
            packed = [machine.packed(t) for t in batch]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
            values = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
            return {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)), "n_tokens": np.diff(ends)}

        return run

    return texts.per_text(docs, make, "ids array<int>, n_tokens bigint", *keep, text=text)


def decode(rows: DataFrame, path: str, *keep: str, ids: str = "ids") -> DataFrame:
    """``text`` of every list of ids; null lists give null."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(batches):
        machine = Decoder(path)
        for batch in batches:
            lists = batch.column(len(keep))
            out = ["".join(machine.parts(np.asarray(x.values, dtype=np.int64))) if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.string())], names=[*keep, "text"])

    return texts.whole_texts(rows, *keep, ids).mapInArrow(run, ", ".join(x for x in (kept, "text string") if x))


def round_trip(docs: DataFrame, path: str, *keep: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """n_tokens, ids_sha256 (of the ids as four bytes each, lowest first) and decoded_sha256 of every text, and its ids on demand.

    Nulls and repeated rows are treated as in ``encode``.
    """

    def make():
        machine, back = encoder(path), Decoder(path)

        def run(batch):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if with_ids else {})
            for t in batch:
                encoded, decoded, count, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                for packed in machine.parts(t):
                    ids = np.frombuffer(packed, dtype="<u4")
                    encoded.update(packed)
                    count += len(ids)
                    for start in range(0, len(ids), DECODE_STEP):
                        decoded.update(back.feed(ids[start : start + DECODE_STEP]).encode())
                    if with_ids:
                        kept.append(ids.astype(np.int32))
                decoded.update(back.finish().encode())
                out["n_tokens"].append(count)
                out["ids_sha256"].append(encoded.hexdigest())
                out["decoded_sha256"].append(decoded.hexdigest())
                if with_ids:
                    out["ids"].append(np.concatenate(kept) if kept else np.zeros(0, np.int32))
            return out if not with_ids else out | {"ids": pa.array(out["ids"], pa.list_(pa.int32()))}

        return run

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return texts.per_text(docs, make, schema, *keep, text=text)
