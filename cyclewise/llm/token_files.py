"""Token ids in files, with a minimal perfect hash index from document keys to offsets.

Documents are dealt to shards by ranges of their key and sorted. A shard's file rows are blocks: the keys, the end of each
document in the block, the ids one after the other (two bytes each where the vocabulary allows it, else four; lowest byte
first) and the index. The index maps a key, without storing it, to the place of its first document in the block: a
hash function without collisions or gaps (levels of bit arrays: keys that are alone at their bit stay, the others go on to
the next level), and for each place a 32-bit fingerprint, the document's number and how many documents have the key.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cyclewise import shared
from cyclewise.llm import near_dup, texts, vocab

SHARD_ROWS = 1 << 13
BLOCK_DOCS = 1 << 12
BLOCK_BYTES = 8 << 20
# Bytes of text that are encoded together, in slices of SLICE_ROWS rows.
PORTION_BYTES = 2 << 20
SLICE_ROWS = 16
# Pieces and words whose ids a worker keeps.
WORD_ENTRIES = 1 << 20
JOINED_WORDS = 200
MOST_LEVELS = 64
# Blocks whose key ranges go to all workers at a time; a larger directory takes several passes over the keys.
DIRECTORY_BLOCKS = 1 << 20
# Shards that a lookup names to the scan of the files; beyond, all files are joined.
NAMED_SHARDS = 1 << 10
SCHEMA = "shard int, block int, n_docs bigint, n_ids bigint, first_key bigint, last_key bigint, width int, keys binary, ends binary, index binary, payload binary"
STEP = 0x9E3779B97F4A7C15  # 2^64 over the golden ratio


def hashed(keys: np.ndarray, level: int) -> np.ndarray:
    return near_dup.mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(STEP * (level + 1) % (1 << 64)))


class PerfectHash:
    """Distinct 64-bit keys to 0 .. n - 1, with fingerprints."""

    def __init__(self, sizes: list[int], bits: np.ndarray, values: np.ndarray):
        self.sizes, self.bits, self.values = sizes, bits, values
        self.ranks = np.cumsum(bits) - bits
        self.starts = np.cumsum([0, *sizes])

    @classmethod
    def build(cls, keys: np.ndarray, firsts: np.ndarray, runs: np.ndarray) -> PerfectHash:
        """``keys`` are distinct; their values are the number of the first document and how many there are."""
        left, sizes, levels = keys, [], []
        while len(left):
            if len(sizes) == MOST_LEVELS:
                raise ValueError("keys repeat")
            size = 2 * len(left)
            at = (hashed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        bits = np.concatenate(levels).astype(np.uint8) if levels else np.empty(0, dtype=np.uint8)
        out = cls(sizes, bits, np.zeros((len(keys), 3), dtype="<u4"))
        out.values[out.places(keys)] = np.stack([out.prints(keys), firsts, runs], axis=1)
        return out

    @staticmethod
    def prints(keys: np.ndarray) -> np.ndarray:
        return hashed(keys, MOST_LEVELS) >> np.uint64(32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for some keys that aren't in the set, any place for others."""
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (hashed(keys[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            here = self.bits[at] == 1
            out[left[here]] = self.ranks[at[here]]
            left = left[~here]
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; -1 and 0 where the fingerprint differs."""
        at = self.places(keys)
        if not len(self.values):
            return np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        rows = self.values[at]
        known = (at >= 0) & (rows[:, 0] == self.prints(keys))
        return np.where(known, rows[:, 1].astype(np.int64), -1), np.where(known, rows[:, 2].astype(np.int64), 0)

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), len(self.values), *self.sizes], dtype="<u8")
        return head.tobytes() + np.packbits(self.bits).tobytes() + self.values.tobytes()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        levels, n = (int(x) for x in np.frombuffer(data, dtype="<u8", count=2))
        sizes = np.frombuffer(data, dtype="<u8", count=levels, offset=16).astype(np.int64).tolist()
        at, total = 16 + 8 * levels, sum(sizes)
        bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=-(-total // 8), offset=at), count=total)
        return cls(sizes, bits, np.frombuffer(data, dtype="<u4", offset=at + -(-total // 8)).reshape(n, 3))


# How a vocabulary must lower and split for its texts to be cut here.
LOWERING = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
AS_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
SPLITTING = {"type": "Sequence", "pretokenizers": [SPLIT, AS_BYTES]}
# Texts of these characters only, and without the beginning of a special string, are cut into pieces as bytes: no normal form changes
# their letters, and a second byte of 0x80 to 0x9E belongs to a capital.
_beyond = "[^\\x00-\\x1b\\x20-\\x7fÀ-ÖØ-öø-ÿ]"
_low = np.array([b + 0x20 if 0x41 <= b <= 0x5A or 0x80 <= b <= 0x9E else b for b in range(256)], dtype=np.uint8)
BLANK, LETTER, DIGIT, MARK = range(4)
_kind = lambda b: LETTER if b >= 0x80 or chr(b).isalpha() else BLANK if b in vocab.SPACE else DIGIT if chr(b).isdigit() else MARK
_kinds = np.array([_kind(b) for b in range(256)], dtype=np.uint8)


def cut(column: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The pieces of plain texts, lowered, and the number of the first piece of each text (and the number of all pieces at the end).

    Pieces are runs of letters, single digits and runs of marks; a quote by itself takes the s, t, re, ve, m, ll or d after it.
    """
    offsets = np.frombuffer(column.buffers()[1], dtype="<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    data = _low[np.concatenate([data, np.full(3, ord(" "), dtype=np.uint8)])]
    kinds = _kinds[data]
    begins = kinds == DIGIT
    begins[1:] |= kinds[1:] != kinds[:-1]
    begins[offsets] = True
    heads = np.zeros(len(data), dtype=bool)
    heads[offsets] = True
    after = np.flatnonzero((data == ord("'")) & begins) + 1
    after = after[(kinds[after] == LETTER) & ~heads[after]]
    first, second = data[after], np.where(begins[after + 1], 0, data[after + 1])
    one = np.isin(first, list(b"stmd"))
    two = (np.isin(first, list(b"rv")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
    begins[after[one | two]] = False
    begins[after[one] + 1] = True
    begins[after[two] + 2] = True
    kept = kinds != BLANK
    begins &= kept
    firsts = np.searchsorted(np.flatnonzero(begins), offsets)
    data = data[kept]
    starts = np.append(np.flatnonzero(begins[kept]), len(data)).astype("<i4")
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data)), firsts


class LibraryEncoder:
    """Ids of the tokenizers library, as four bytes each. Pieces of plain texts and words of others are encoded once and looked up after that.

    The vocabulary drops white space and merges inside pieces only, so that a text's ids are those of its pieces in order. Texts
    beyond the plain ones are split at white space; those with white space or control characters about which Python and the library
    may disagree go to the library whole, as do all texts if the vocabulary lowers or splits in another way.
    """

    def __init__(self, path: str, entries: int = WORD_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        spec = json.loads(self._tokenizer.to_str())
        special = all(t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"])
        self._cuts = special and (spec["normalizer"], spec["pre_tokenizer"]) == (LOWERING, SPLITTING)
        # For pieces, which are lowered and cut already.
        self._merger = Tokenizer.from_file(path)
        self._merger.no_truncation()
        self._merger.no_padding()
        self._merger.normalizer = normalizers.Sequence([])
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), as_bytes])
        self.size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._ends = np.zeros(self.size, dtype=bool)
        for token, i in self._tokenizer.get_vocab().items():
            self._ends[i] = token.endswith("</w>")
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._half = max(1, entries // 2)
        self._odd = [chr(c) for c in (*range(0x1C, 0x20), *(s for s in vocab.SPACE if s > 0x7F))]

    def _library(self, items: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(items, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """As ``_library``, for pieces: many to a call, told apart by the ids that end a piece."""
        out = []
        for start in range(0, len(pieces), JOINED_WORDS):
            some = pieces[start : start + JOINED_WORDS]
            (found,) = self._merger.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            if len(ends) != len(some):
                return self._library(pieces)
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _remembered(self, words: list[str], encode) -> list[bytes]:
        """The ids of different words; ``encode`` gets those not known. Very long ones aren't kept."""
        if len(self._known) >= self._half:
            self._old, self._known = self._known, {}
        known, old = self._known, self._old
        out = list(map(known.get, words))
        missing = [i for i, ids in enumerate(out) if ids is None]
        for i in missing:
            out[i] = old.get(words[i])
        new = [i for i in missing if out[i] is None]
        for i, ids in zip(new, encode([words[i] for i in new])):
            out[i] = ids
        known.update((words[i], out[i]) for i in missing if len(words[i]) <= texts.Memo.LONGEST)
        return out

    def _plain(self, column: pa.StringArray) -> list[bytes]:
        """Ids of plain texts: each different piece is looked up once, and its ids are copied to its places."""
        pieces, firsts = cut(column)
        coded = pieces.dictionary_encode()
        at = coded.indices.to_numpy()
        found = self._remembered(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._merged)
        data = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts, sizes = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.cumsum(sizes)
        ids = data[np.arange(len(at) and ends[-1]) + np.repeat(starts - ends + sizes, sizes)]
        bounds = np.append(0, ends)[firsts].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def _apart(self, column: pa.StringArray, encode) -> list[bytes]:
        """Ids of the plain texts by pieces, and of the others by ``encode``."""
        beyond = pc.or_(pc.match_substring_regex(column, _beyond), pc.match_substring(column, "<|"))
        plain = iter(self._plain(column.filter(pc.invert(beyond))))
        others = iter(encode(column.filter(beyond).to_pylist()))
        return [next(others if b else plain) for b in beyond.to_pylist()]

    def _by_words(self, batch: list[str]) -> list[bytes]:
        whole, split = {}, {}
        for i, text in enumerate(batch):
            if any(c in text for c in (self._odd[:4] if text.isascii() else self._odd)):
                whole[i] = text
            else:  # capitals of plain text are lowered by the vocabulary anyway, except in special strings
                split[i] = (text.lower() if text.isascii() and "<|" not in text else text).split()
        words = list(set().union(*split.values()))
        known = dict(zip(words, self._remembered(words, lambda new: self._apart(pa.array(new, pa.string()), self._library))))
        out = dict(zip(whole, self._library(list(whole.values()))))
        out |= {i: b"".join(map(known.__getitem__, words)) for i, words in split.items()}
        return [out[i] for i in range(len(batch))]

    def packed(self, batch: list[str] | pa.StringArray) -> list[bytes]:
        column = pa.array(batch, pa.string()) if isinstance(batch, list) else batch.cast(pa.string())
        return self._apart(column, self._by_words) if self._cuts else self._library(column.to_pylist())


@cache
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def portions(batches):
    """The rows of the batches, joined or cut to portions of about ``PORTION_BYTES``."""
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            held.append(batch.slice(start, SLICE_ROWS))
            size += held[-1].nbytes
            if size >= PORTION_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def block_row(shard: int, block: int, width: int, keys: list, counts: list[int], payload: list[bytes]) -> dict:
    """One row of the files. Null keys come first and aren't in the index."""
    nulls = sum(k is None for k in keys)
    known = np.array([k for k in keys if k is not None], dtype="<i8")
    distinct, firsts, runs = np.unique(known, return_index=True, return_counts=True)
    return {
        "shard": shard,
        "block": block,
        "n_docs": len(keys),
        "n_ids": sum(counts),
        "first_key": int(known[0]) if len(known) else None,
        "last_key": int(known[-1]) if len(known) else None,
        "width": width,
        "keys": known.tobytes(),
        "ends": np.cumsum(counts, dtype="<u8").tobytes(),
        "index": PerfectHash.build(distinct, firsts + nulls, runs).dump(),
        "payload": b"".join(payload),
    }


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every text and ``end_id`` after each, in ascending order of the ids of documents, below ``path``.

    A null text counts as empty (only ``end_id``). Null document ids come first and can't be looked up. Rows that repeat an id are
    all written, ordered by their text's hash, and found together. Other columns aren't read.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    shards = max(1, -(-docs.select(id_column).count() // SHARD_ROWS))
    dealt = rows.repartitionByRange(shards, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def run(batches):
        encoder, shard, block = library_encoder(tokenizer), TaskContext.get().partitionId(), 0
        width = 2 if max(encoder.size - 1, end_id) < 1 << 16 else 4
        end = end_id.to_bytes(4, "little")
        keys, counts, payload, size = [], [], [], 0

        def row():
            out = block_row(shard, block, width, keys, counts, payload)
            return pa.RecordBatch.from_pylist([out], schema=arrow)

        for batch in portions(batches):
            packed = encoder.packed(pc.fill_null(batch.column(1), ""))
            for key, ids in zip(batch.column(0).to_pylist(), packed):
                if len(keys) == BLOCK_DOCS or keys and size + len(ids) > BLOCK_BYTES:
                    yield row()
                    block, keys, counts, payload, size = block + 1, [], [], [], 0
                keys.append(key)
                counts.append(len(ids) // 4 + 1)
                payload.append(np.frombuffer(ids + end, dtype="<u4").astype(f"<u{width}").tobytes())
                size += len(payload[-1])
        if keys:
            yield row()

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in SCHEMA.split(", "))])
    texts.whole_texts(dealt, "id", "text").mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """``before``: ids in the files ahead of each block. One small row for each block."""
    blocks = spark.read.schema(SCHEMA).parquet(path).select("shard", "block", "n_ids")
    ahead = F.sum("n_ids").over(Window.orderBy("shard", "block").rowsBetween(Window.unboundedPreceding, -1))
    return shared.settle(blocks.select("shard", "block", F.coalesce(ahead, F.lit(0)).alias("before")), "block-starts")


class Block:
    """One row of the files, opened."""

    def __init__(self, row: dict):
        self.keys = np.frombuffer(row["keys"], dtype="<i8")
        self.ends = np.frombuffer(row["ends"], dtype="<u8").astype(np.int64)
        self.index = PerfectHash.load(row["index"])
        self.ids = np.frombuffer(row["payload"], dtype=f"<u{row['width']}")

    def document(self, i: int) -> tuple[int, np.ndarray]:
        """Where document ``i`` starts in the block, and its ids."""
        start = int(self.ends[i - 1]) if i else 0
        return start, self.ids[start : int(self.ends[i])]

    def nulls(self) -> int:
        return len(self.ends) - len(self.keys)


def _opened(rows: DataFrame, columns: list[str], schema: str, visit) -> DataFrame:
    """``visit(row, block)`` gives tuples for every file row; as Arrow batches are bounded in bytes, few come at a time."""

    def run(batches):
        names = [c.split(" ")[0] for c in schema.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                found = list(visit(row, Block(row)))
                yield pa.RecordBatch.from_pydict({n: pa.array([f[i] for f in found], pa.int64() if n != "ids" else pa.list_(pa.int64())) for i, n in enumerate(names)})

    return texts.whole_texts(rows, *columns).mapInArrow(run, schema)


def _visit_all(row: dict, block: Block):
    """Every document: null keys by position, the others through the index."""
    firsts, runs = block.index.find(block.keys)
    places = [*range(block.nulls())]
    seen = -1
    for first, run in zip(firsts.tolist(), runs.tolist()):
        if first != seen:
            places += range(first, first + run)
            seen = first
    for i in places:
        start, ids = block.document(i)
        key = None if i < block.nulls() else int(block.keys[i - block.nulls()])
        yield key, row["shard"], row["block"], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def read_back(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """Per document in the files: its id, ``start`` (ids before it), ``n_tokens`` and ``ids_crc32``."""
    schema = "id bigint, shard bigint, block bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    blocks = spark.read.schema(SCHEMA).parquet(path)
    found = _opened(blocks, ["shard", "block", "width", "keys", "ends", "index", "payload"], schema, _visit_all)
    found = shared.settle(found, "token-digests")
    placed = found.join(block_starts(spark, path), ["shard", "block"])
    return placed.select(F.col("id").alias(id_column), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _routed(wanted: DataFrame, spans: pd.DataFrame) -> DataFrame:
    """``wanted`` with the blocks, of those given in the order of the files, whose range holds the key."""
    first, last, shard, block = (spans[c].to_numpy() for c in ("first_key", "last_key", "shard", "block"))

    def run(batches):
        for batch in batches:
            keys = np.asarray(batch.column(0), dtype=np.int64)
            low, high = np.searchsorted(last, keys, side="left"), np.searchsorted(first, keys, side="right")
            sizes = np.maximum(high - low, 0)
            at = np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns = [pa.array(np.repeat(keys, sizes)), pa.array(shard[at], pa.int32()), pa.array(block[at], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "shard", "block"])

    return wanted.mapInArrow(run, "id bigint, shard int, block int")


def lookup(keys: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """``ids`` of every document in the files whose key is in ``keys``; unknown and null keys give no row.

    Keys meet the blocks whose range they lie in; only files with such blocks are opened, and inside, the index leads to
    the document.
    """
    blocks = keys.sparkSession.read.schema(SCHEMA).parquet(path).where("first_key IS NOT NULL")
    spans = shared.settle(blocks.select("shard", "block", "first_key", "last_key"), "block-spans")
    wanted = keys.select(F.col(id_column).alias("id")).where("id IS NOT NULL").distinct()
    slices = max(1, -(-spans.count() // DIRECTORY_BLOCKS))
    met = None
    for s in range(slices):
        part = spans.where(F.pmod(F.xxhash64("shard", "block"), F.lit(slices)) == s).toPandas()
        found = _routed(wanted, part.sort_values(["shard", "block"]))
        met = found if met is None else met.union(found)
    asked = shared.settle(met.groupBy("shard", "block").agg(F.collect_list("id").alias("asked")), "asked-blocks")
    # Few shards are named to the scan, which then passes over files and row groups that hold none of them.
    some = [r["shard"] for r in asked.select("shard").distinct().limit(NAMED_SHARDS + 1).collect()]
    if len(some) <= NAMED_SHARDS:
        blocks = blocks.where(F.col("shard").isin(some))

    def visit(row, block):
        asked = np.array(row["asked"], dtype=np.int64)
        firsts, runs = block.index.find(asked)
        for key, first, run in zip(asked.tolist(), firsts.tolist(), runs.tolist()):
            for i in range(first, first + run):
                if int(block.keys[i - block.nulls()]) == key:
                    yield key, block.document(i)[1].tolist()

    joined = blocks.join(asked, ["shard", "block"])
    columns = ["asked", "width", "keys", "ends", "index", "payload"]
    return _opened(joined, columns, "id bigint, ids array<bigint>", visit).withColumnRenamed("id", id_column)
