"""Documents that hold a benchmark's test items: BM25 with block-max WAND, then a check of the words' order.

The index is of test items (long ones in parts): for each term its postings with BM25 weights, as shares of the part's own
score, in blocks of parts with the largest weight of each term in the block. Every passage of every document is a query;
passages overlap by half, so that any part of an item lies whole in one.

A block's bound for a passage is the sum of its terms' largest weights there. It is worked out for all passages of a
document at once, over arrays: common terms count together, as the most that a part of the block has of them. Blocks
whose bound is below the threshold are skipped; in the others WAND moves through the postings from pivot to pivot. So
all parts above the threshold are retrieved. They are leaks if the question's and the answer's shingles are in the passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewise import shared
from cyclewise.llm import texts

PART_WORDS = 64
K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.5
WORDS = 5
# Questions and answers of fewer words are compared word by word, at the place that is most like them and their neighbours.
SHORT = 10
BLOCK_PARTS = 6
MOST_BLOCKS = 64
# Terms in more than this share of all parts count as common.
COMMON = 0.025
# Words whose terms a worker keeps.
WORD_ENTRIES = 1 << 18
# Half passages of a text that are looked at together.
STRETCH = 1 << 10
# Text of the items that one index may hold; a larger benchmark is taken in several passes over the documents.
INDEX_BYTES = 8 << 20
_ODD = re.compile(r"[\W_]+")


def term(word: str) -> str:
    return _ODD.sub("", word.lower())


@dataclass(frozen=True)
class Part:
    """A stretch of a test item: its terms in order, and how many of them belong to the question."""

    item: int
    terms: tuple[int, ...]
    question: int


def cut(text: str) -> list[tuple[list[str], int]]:
    """The parts of an item, of about as many terms each: (terms, how many of them belong to the question)."""
    end = text.rstrip().rfind("\n")
    words = [t for t in map(term, text.split()) if t]
    asked = len([t for t in map(term, text[:end].split()) if t]) if end > 0 else 0
    if not 0 < asked < len(words):
        asked = (len(words) + 1) // 2
    pieces = max(1, -(-len(words) // PART_WORDS))
    bounds = [len(words) * p // pieces for p in range(pieces + 1)]
    return [(words[a:b], min(max(asked - a, 0), b - a)) for a, b in zip(bounds, bounds[1:]) if b > a]


class Index:
    """Weights of terms in parts, by block of parts and term.

    ``rows`` has (item, terms, terms of the question, in how many of all parts each term is) of the parts in this index; ``total``
    and ``mean`` are the number of all parts and their mean length, so that weights don't depend on which parts share an index.
    """

    def __init__(self, rows: list[tuple[int, list[str], int, list[int]]], total: int, mean: float):
        self.vocabulary: dict[str, int] = {}
        parts, held = [], {}
        for item, words, asked, found_in in rows:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words)
            held.update(zip(ids, found_in))
            parts.append(Part(item, ids, asked))
        counts = [Counter(p.terms) for p in parts]
        common = {t for t, n in held.items() if n > max(2, COMMON * total)}
        weights = []
        for part, count in zip(parts, counts):
            norm = K1 * (1 - B + B * len(part.terms) / mean)
            own = {t: math.log(1 + (total - held[t] + 0.5) / (held[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in count.items()}
            whole = sum(own.values())
            weights.append({t: w / whole for t, w in own.items()})
        # Parts with alike sums over common terms share a block, so that the block's sum says much about each of them.
        sums = [sum(w for t, w in own.items() if t in common) for own in weights]
        order = sorted(range(len(parts)), key=lambda n: sums[n])
        blocks = min(MOST_BLOCKS, -(-len(parts) // BLOCK_PARTS))
        self.parts = [parts[n] for n in order]
        #: For each block, its postings: term -> [(part, weight)], and the largest weight of each term.
        self.postings: list[dict[int, list[tuple[int, float]]]] = [defaultdict(list) for _ in range(blocks)]
        #: By term and block: the largest weight; none for common terms and (last) words that no item has.
        self.largest = np.zeros((len(self.vocabulary) + 1, blocks), dtype=np.float32)
        #: The most that a part of each block has of all common terms.
        self.commons = np.zeros(blocks, dtype=np.float32)
        for place, n in enumerate(order):
            block = place * blocks // len(order)
            self.commons[block] = max(self.commons[block], sums[n])
            for t, w in weights[n].items():
                self.postings[block][t].append((place, w))
                if t not in common:
                    self.largest[t, block] = max(self.largest[t, block], w)
        self.rare = self.largest.any(axis=1) if blocks else np.zeros(len(self.largest), dtype=bool)
        self.peaks = [{t: max(w for _, w in posts) for t, posts in block.items()} for block in self.postings]

    def bounds(self, ids: np.ndarray) -> np.ndarray:
        """For each half passage, with the one after it, the bound of every block."""
        at = np.flatnonzero(self.rare[ids])
        half = np.zeros((-(-len(ids) // PART_WORDS) + 1, len(self.commons)), dtype=np.float32)
        if len(at):
            group = at // PART_WORDS
            starts = np.flatnonzero(np.r_[True, np.diff(group) > 0])
            half[group[starts]] = np.add.reduceat(self.largest[ids[at]], starts, axis=0)
        return half[:-1] + half[1:] + self.commons

    def retrieve(self, terms: set[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """All (part, score) of a block with at least ``threshold``, by WAND."""
        least, postings, peaks = threshold - 1e-9, self.postings[block], self.peaks[block]
        cursors = [[postings[t][0][0], 0, t] for t in sorted(terms & postings.keys())]
        found = []
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, cursor in enumerate(cursors):
                bound += peaks[cursor[2]]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                return found
            number = cursors[pivot][0]
            if cursors[0][0] < number:
                self._advance(cursors, postings, number)
                continue
            score = sum(postings[t][at][1] for part, at, t in cursors if part == number)
            if score >= least:
                found.append((number, score))
            self._advance(cursors, postings, number + 1)

    @staticmethod
    def _advance(cursors: list, postings: dict, target: int) -> None:
        """Move all cursors before ``target`` to it or beyond; drop those that come to their end."""
        for cursor in cursors:
            posts, at = postings[cursor[2]], cursor[1]
            while at < len(posts) and posts[at][0] < target:
                at += 1
            cursor[:2] = (posts[at][0], at) if at < len(posts) else (-1, at)
        cursors[:] = [c for c in cursors if c[0] >= 0]


def _shared(part: tuple[int, ...], passage: list[int]) -> float:
    """Share of the part's shingles (of five words) that the passage has."""
    if not part:
        return 1.0
    there = set(zip(*(passage[i:] for i in range(WORDS))))
    own = list(zip(*(part[i:] for i in range(WORDS))))
    return sum(s in there for s in own) / len(own)


def _in_order(own: tuple[int, ...], there: list[int]) -> int:
    """How many words of ``own`` are in ``there`` in the same order (longest common subsequence)."""
    row = [0] * (len(own) + 1)
    for word in there:
        last, row = row, [0]
        for n, mine in enumerate(own):
            row.append(last[n] + 1 if mine == word else max(row[n], last[n + 1]))
    return row[-1]


def _place(own: tuple[int, ...], passage: list[int]) -> list[int]:
    """The stretch of the passage, hardly longer than ``own``, that has most of its words in order."""
    width = len(own) + len(own) // 4
    stretches = (passage[i : i + width] for i in range(max(1, len(passage) - width + 1)))
    return max(stretches, key=lambda there: _in_order(own, there))


def overlaps(part: Part, passage: list[int]) -> tuple[float, float]:
    """Shares of the question and of the answer that the passage has.

    Of a short side the words count that follow (or precede) those of the other side at their place. A short item must stand
    together, with at most one word in five missing or changed.
    """
    terms, cut = part.terms, part.question
    if len(terms) < SHORT:
        same = _in_order(terms, _place(terms, passage))
        share = same / len(terms) if len(terms) - same <= len(terms) // 5 else 0.0
        return share, share

    def share(own, stretch, beside):
        if not own or len(own) >= SHORT:
            return _shared(own, passage)
        there = _place(stretch, passage)
        return max(0, _in_order(stretch, there) - _in_order(beside, there)) / len(own)

    return share(terms[:cut], terms[:SHORT], terms[cut:SHORT]), share(terms[cut:], terms[-SHORT:], terms[-SHORT:cut])


class Searcher:
    """Looks for the items of an index in whole texts."""

    def __init__(self, index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP):
        self._index, self._threshold, self._overlap = index, threshold, overlap
        self._unknown = len(index.vocabulary)
        self._ids = texts.Memo(self._number, entries=WORD_ENTRIES)

    def _number(self, word: str) -> bytes:
        plain = term(word)
        return self._index.vocabulary.get(plain, self._unknown).to_bytes(4, "little") if plain else b""

    def leaks(self, text: str) -> list[tuple[int, float, float, float]]:
        """(item, score, question's share, answer's share) of every item found, once each, at its best passage."""
        ids = np.frombuffer(b"".join(map(self._ids.__getitem__, text.split())), dtype="<u4")
        index, best = self._index, {}
        for first in range(0, len(ids), STRETCH * PART_WORDS):
            bounds = index.bounds(ids[first : first + (STRETCH + 1) * PART_WORDS])
            here, terms = -1, set()
            for i, block in np.argwhere(bounds[:STRETCH] >= self._threshold - 1e-4).tolist():
                if i != here:
                    here, start = i, first + i * PART_WORDS
                    passage = ids[start : start + 2 * PART_WORDS].tolist()
                    terms = set(passage)
                for number, score in index.retrieve(terms, block, self._threshold):
                    part = index.parts[number]
                    asked, told = overlaps(part, passage)
                    if min(asked, told) >= self._overlap:
                        best[part.item] = max(best.get(part.item, (0.0, 0.0, 0.0)), (score, asked, told))
        return [(item, *found) for item, found in sorted(best.items())]


def weighed(items: DataFrame, slices: int, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """The parts of all items: ``slice`` (by the item's id), ``item``, ``place``, ``terms``, ``question``, and ``found_in``: in how many of
    all parts each of the terms is. Items without an id or a word have none."""
    rows = items.select(F.col(id_column).cast("bigint").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.where("item IS NOT NULL").distinct()

    def run(batches):
        kind = pa.list_(pa.struct([("terms", pa.list_(pa.string())), ("question", pa.int32())]))
        for batch in batches:
            parts = [[{"terms": terms, "question": asked} for terms, asked in cut(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(1).to_pylist()), pa.array(parts, kind)], names=["item", "text", "parts"])

    schema = "item bigint, text string, parts array<struct<terms: array<string>, question: int>>"
    told = texts.whole_texts(rows, "item", "text").mapInArrow(run, schema)
    told = told.select("item", F.xxhash64("text").alias("version"), F.posexplode("parts").alias("place", "part"))
    parts = shared.settle(told.select("item", "version", "place", "part.terms", "part.question"), "item-parts")
    each = parts.select("item", "version", "place", F.posexplode("terms").alias("at", "term"))
    counts = each.groupBy("term").agg(F.count_distinct("item", "version", "place").alias("n"))
    same = ["item", "version", "place"]
    found_in = each.join(shared.settle(counts, "item-terms"), "term").groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("at", "n")))["n"].alias("found_in"))
    number = F.pmod(F.xxhash64("item"), F.lit(slices)).cast("int")
    return parts.join(found_in, same).select(number.alias("slice"), *same, "terms", "question", "found_in")


@dataclass(frozen=True)
class IndexFile:
    """One slice of the weighed parts, in a file that Spark ships to the workers."""

    name: str
    slice: int
    total: int
    mean: float

    def load(self) -> Index:
        """In a worker: its index."""
        columns = ["item", "version", "place", "terms", "question", "found_in"]
        table = pq.read_table(SparkFiles.get(self.name), columns=columns, filters=[("slice", "=", self.slice)], partitioning=None)
        rows = sorted(zip(*(table.column(c).to_pylist() for c in columns)))
        return Index([(item, terms, asked, found_in) for item, _, _, terms, asked, found_in in rows], self.total, self.mean)


def publish(items: DataFrame, id_column: str = "item_id", text: str = "text", most: int = INDEX_BYTES) -> list[IndexFile]:
    """One file, or several of at most about ``most`` bytes of text each, one for each pass over the documents.

    Terms are counted and weighed over all parts of all items before they are dealt to files, so what is found doesn't depend on the
    number of files. The driver sees names, counts and a mean.
    """
    spark = items.sparkSession
    size = items.agg(F.sum(F.octet_length(text))).head()[0] or 0
    slices = max(1, -(-size // most))
    rows = weighed(items, slices, id_column, text)
    path = shared.scratch(spark, "item-index")
    rows.repartition(slices, "slice").write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    total, mean = rows.agg(F.count("*"), F.avg(F.size("terms"))).head()
    files = [(r["slice"], r["file"]) for r in rows.select("slice", F.input_file_name().alias("file")).distinct().collect()]
    for file in sorted({f for _, f in files}):
        spark.sparkContext.addFile(file)
    return [IndexFile(file.rsplit("/", 1)[-1], number, total, mean) for number, file in sorted(files)]


def find_leaks(docs: DataFrame, items: DataFrame, *keep: str, text: str = "text", item_column: str = "item_id", most: int = INDEX_BYTES) -> DataFrame:
    """One row for each document and test item found in it: the columns in ``keep``, the item's id, ``score`` (share of the
    item's own BM25 score), ``question_overlap`` and ``answer_overlap``.

    An item's last line is its answer; without one, its second half. Items that repeat an id count as parts of one. A null or
    empty text holds nothing; without items, or with items without words, there are no rows. Repeated rows of ``docs`` are searched
    each; columns not named aren't read.
    """
    kind = pa.list_(pa.struct([("item", pa.int64()), *((n, pa.float64()) for n in ("score", "asked", "told"))]))
    schema = "found array<struct<item: bigint, score: double, asked: double, told: double>>"
    out = None
    for file in publish(items, item_column, most=most):

        def make(file=file):
            search = Searcher(file.load()).leaks
            return lambda batch: {"found": pa.array([[dict(zip(("item", "score", "asked", "told"), x)) for x in search(t)] for t in batch], kind)}

        found = texts.per_text(docs, make, schema, *keep, text=text).select(*keep, F.explode("found").alias("f"))
        out = found if out is None else out.union(found)
    told = {item_column: "item", "score": "score", "question_overlap": "asked", "answer_overlap": "told"}
    if out is None:
        none = docs.limit(0).select(*keep, F.lit(None).cast(schema.removeprefix("found ")).alias("found"))
        out = none.select(*keep, F.explode("found").alias("f"))
    return out.select(*keep, *[F.col(f"f.{c}").alias(name) for name, c in told.items()])


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_column: str = "item_id", most: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in which no test item is found."""
    for file in publish(items, item_column, most=most):

        def make(file=file):
            search = Searcher(file.load()).leaks
            return lambda batch: [not search(t) for t in batch]

        docs = texts.filter_texts(docs, make, text)
    return docs
