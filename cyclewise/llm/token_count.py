"""Token counts by byte-pair merging over a heap and a linked list; no ids are made.

The count of a piece is its number of bytes less the number of merges. The heap holds the adjacent pairs by rank
and place; the list holds each symbol's neighbours. A popped pair that is no longer adjacent is passed over.
"""

from __future__ import annotations

from functools import cache
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewise.llm import texts, vocab


def merges_of(symbols: list[int], vocabulary: vocab.Vocabulary) -> int:
    """How many merges a list of symbols undergoes."""
    size, get, made = len(symbols), vocabulary.ranks.get, vocabulary.made
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    ranks = list(map(get, zip(symbols, symbols[1:])))  # of the pair that begins at each place, as it is now
    ranks.append(None)
    heap = [rank * size + i for i, rank in enumerate(ranks) if rank is not None]
    heapify(heap)
    done = 0
    while heap:
        rank, i = divmod(heappop(heap), size)
        if ranks[i] != rank:  # one of the two has gone since
            continue
        done += 1
        symbol = symbols[i] = made[rank]
        gone = after[i]
        follower = after[i] = after[gone]
        ranks[gone] = ranks[i] = None
        if follower < size:
            before[follower] = i
            if (rank := get((symbol, symbols[follower]))) is not None:
                ranks[i] = rank
                heappush(heap, rank * size + i)
        if (leader := before[i]) >= 0:
            rank = ranks[leader] = get((symbols[leader], symbol))
            if rank is not None:
                heappush(heap, rank * size + leader)
    return done


class Counter:
    """Counts whole texts; known words are looked up."""

    def __init__(self, path: str):
        self._vocabulary = vocab.vocabulary(path)
        self._pieces = texts.Memo(self._piece)
        self._words = texts.Memo(lambda word: self._plain(" " + word))

    def _piece(self, piece: str) -> int:
        symbols = self._vocabulary.symbols(piece)
        return len(symbols) - merges_of(symbols, self._vocabulary)

    def _plain(self, text: str) -> int:
        return sum(map(self._pieces.__getitem__, vocab.pieces(text)))

    def count(self, text: str) -> int:
        total = 0
        for plain, special in self._vocabulary.segments(text):
            if (cut := vocab.words(plain)) is None:
                total += self._plain(plain)
            else:
                total += self._plain(cut[0]) + sum(map(self._words.__getitem__, cut[1]))
            total += special is not None
        return total


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, *keep: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every text.

    Null counts as empty: 0 bytes, 0 tokens. Special strings inside a text count as one token each. Repeated rows stay;
    columns not named are not read.
    """

    def make():
        count = counter(path).count
        return lambda batch: {"n_bytes": [len(t.encode("utf-8", "replace")) for t in batch], "n_tokens": [count(t) for t in batch]}

    rows = texts.per_text(docs, make, "n_bytes bigint, n_tokens bigint", *keep, text=text)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
