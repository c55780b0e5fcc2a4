"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's set is its distinct shingles of ``WORDS`` words. Its signature has ``HASHES`` symbols of ``BITS`` bits (b-bit
MinHash), four to a 64-bit chunk. Two sets of similarity s differ in a symbol with probability 1 - s; at 0.85 more than
``ERRORS`` of 32 symbols differ once in 300,000 pairs, so that pairs within that distance are the candidates. At 0.80 that
would be once in 7,000; for less than 0.85 a signature has 48 symbols, of which more than 23 differ once in 300,000 pairs.

*Pigeonhole*: ``ERRORS`` errors over ``CHUNKS`` chunks leave a chunk with at most ``ERRORS // CHUNKS`` = 1 error (in each
layout, as twice the chunks less one may differ). Each chunk is entered once with every single symbol blotted out; two signatures within the distance meet under at least one
of these keys. The distance is then counted, and candidates are confirmed on the full sets.

*Groups of copies*: documents with equal sets are one class from the start. A shingle that no other class meeting anyone
has can't be shared: with u such shingles among n, two classes share at most min(n - u) shingles, which rules out most pairs
of a group of edited copies before they are made. Two classes measured against the same third one share at most the
part of it that neither lacks (a lower bound on what the two lack comes from bit maps of the lacking shingles), and the
lesser of what each has besides. Inside a key's bucket every class is then compared with one other
(that with the smallest share of shingles of its own, as an original has); classes that this has linked need no further
comparison. Only pairs that meet under a key and lie in different components are listed after that. No pair within the
distance is left out: it is confirmed, refuted on full sets, or its two ends are linked already.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewise import shared
from cyclewise.llm import components, texts

WORDS = 5
PERCENT = 85
HASHES, BITS, ERRORS = 32, 16, 15
LANES = 64 // BITS
CHUNKS = HASHES // LANES
assert ERRORS // CHUNKS == 1  # what the keys below allow for
CHUNK_NAMES = tuple(f"c{i}" for i in range(CHUNKS))
# Chunks of a signature, by the least similarity in percent that they are laid out for.
LAYOUTS = {PERCENT: CHUNKS, 80: 12}
# Bit maps of 256 bits.
MAP_NAMES = tuple(f"m{i}" for i in range(4))
# Words whose digests a worker keeps; a digest is quickly made anew.
WORD_ENTRIES = 1 << 17
# Documents whose ids are sent to all executors to pick out their texts; beyond it the texts are joined.
PICKED = 1 << 21

_random = np.random.default_rng(20)
_FACTORS = _random.integers(1 << 62, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASHERS = _random.integers(1 << 62, 1 << 63, LANES * max(LAYOUTS.values()), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def chunk_names(percent: int = PERCENT) -> tuple[str, ...]:
    """The chunks that a search for this similarity needs."""
    fitting = [chunks for least, chunks in LAYOUTS.items() if percent >= least]
    if not fitting:
        raise ValueError(f"signatures are laid out for a similarity of at least {min(LAYOUTS)} %")
    return tuple(f"c{i}" for i in range(min(fitting)))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the SplitMix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Texts to sorted distinct 64-bit shingle digests."""

    def __init__(self):
        self._words = texts.Memo(lambda word: xxhash.xxh64_digest(word), entries=WORD_ENTRIES)

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the six ASCII white spaces
        if not words:
            return np.empty(0, dtype=np.uint64)
        hashes = np.frombuffer(b"".join(map(self._words.__getitem__, words)), dtype=np.uint64)
        width = min(WORDS, len(hashes))
        rolled = reduce(np.add, (hashes[i : len(hashes) - width + 1 + i] * _FACTORS[i] for i in range(width)))
        return np.unique(mixed(rolled + np.uint64(width)))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray], chunks: int = CHUNKS) -> np.ndarray:
    """A row of 64-bit chunks for each set; sets without shingles get zeros."""
    out = np.zeros((len(sets), chunks * LANES), dtype=np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for k, factor in enumerate(_HASHERS[: chunks * LANES]):
            out[full, k] = np.minimum.reduceat(flat * factor, starts)
    symbols = mixed(out) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(LANES, dtype=np.uint64) * np.uint64(BITS)
    return (symbols.reshape(len(sets), chunks, LANES) << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: its id, ``text_key``, ``n_shingles``, ``set_key`` (128-bit digest of the set) and the signature's chunks."""
    names = chunk_names(percent)

    def make():
        shingles = Shingles()

        def run(batch):
            sets = [shingles.of(t) for t in batch]
            chunks = signatures(sets, len(names))
            out = {"n_shingles": [len(s) for s in sets], "set_key": pa.array([_digest(s) for s in sets], pa.binary())}
            return out | {name: np.ascontiguousarray(chunks[:, i]) for i, name in enumerate(names)}

        return run

    schema = "n_shingles bigint, set_key binary, " + ", ".join(f"{c} bigint" for c in names)
    rows = docs.select(id_column, F.xxhash64(text).alias("text_key"), F.col(text).alias("__body"))
    return texts.per_text(rows, make, schema, id_column, "text_key", text="__body")


def errors(prefix: str, other: str, names: tuple[str, ...] = CHUNK_NAMES) -> Column:
    """Symbols in which two signatures differ, over columns named with these prefixes."""

    def chunk(name):
        x = F.col(prefix + name).bitwiseXOR(F.col(other + name))
        for shift in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(sum(1 << BITS * i for i in range(LANES)))))

    return _total(map(chunk, names))


def keys(names: tuple[str, ...] = CHUNK_NAMES) -> Column:
    """All keys of a signature: every chunk with each of its symbols blotted out in turn."""
    blots = [((1 << 64) - 1) ^ (((1 << BITS) - 1) << BITS * i) for i in range(LANES)]
    signed = [b - (1 << 64) if b >> 63 else b for b in blots]
    return F.array(
        *(F.xxhash64(F.lit(c * LANES + i), F.col(name).bitwiseAND(F.lit(b))) for c, name in enumerate(names) for i, b in enumerate(signed))
    )


def _total(columns) -> Column:
    return reduce(Column.__add__, columns)


def _sides(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(*(F.col(c).alias(side if c == "class" else f"{side}_{c}") for c in facts.columns)), side)
    return pairs


def _near(percent: int) -> Column:
    """Signatures within the distance, and sizes and known overlaps that allow the similarity.

    ``hub`` is the class that a class was measured against, ``inside`` the shingles it shares with it, ``lacks`` how many of the
    hub's it hasn't, with a bit map of them; ``common`` are all its shingles that others have as well. A bit that only one
    of two maps has stands for a shingle that only that side lacks.
    """
    names = chunk_names(percent)
    most = F.least("a_common", "b_common")
    beside = F.least(F.col("a_common") - F.col("a_inside"), F.col("b_common") - F.col("b_inside"))
    only = lambda one, other: _total(F.bit_count(F.col(one + m).bitwiseAND(F.bitwise_not(F.col(other + m)))) for m in MAP_NAMES)
    lacking = F.greatest(F.col("a_lacks") + only("b_", "a_"), F.col("b_lacks") + only("a_", "b_"))
    inside = F.col("a_inside") + F.col("a_lacks") - lacking
    most = F.when(F.col("a_hub") == F.col("b_hub"), F.least(most, inside + F.greatest(beside, F.lit(0)))).otherwise(most)
    return (100 * most >= percent * (F.col("a_n") + F.col("b_n") - most)) & (errors("a_", "b_", names) <= 2 * len(names) - 1)


def full_sets(docs: DataFrame, wanted: DataFrame, id_column: str, text: str) -> DataFrame:
    """``class`` and ``shingles`` of the classes ``wanted`` (class, rep), from the texts of their first documents."""
    rows = docs.select(F.col(id_column).alias("rep"), F.col(text).alias("__body"))
    reps = wanted.select("rep").distinct()
    picked = rows.join(F.broadcast(reps) if wanted.count() <= PICKED else reps, "rep", "left_semi")

    def make():
        shingles = Shingles()

        def run(batch):
            sets = [shingles.of(t) for t in batch]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), pa.array(np.concatenate(sets).view(np.int64)))
            return {"set_key": pa.array([_digest(s) for s in sets], pa.binary()), "shingles": lists}

        return run

    found = texts.per_text(picked, make, "set_key binary, shingles array<bigint>", "rep", text="__body")
    found = found.withColumn("class", F.xxhash64("set_key")).join(wanted, ["class", "rep"], "left_semi").select("class", "shingles")
    found = shared.settle(found, "full-sets")
    if found.groupBy("class").count().where("count > 1").isEmpty():
        return found
    return shared.settle(found.dropDuplicates(["class"]), "full-sets")  # rows that repeat both id and text


def bit_map(mine: np.ndarray, other: np.ndarray) -> list[int]:
    """Which of 256 bits the shingles of ``other`` that ``mine`` lacks fall on."""
    bits = np.zeros(256, dtype=np.uint8)
    bits[np.setdiff1d(other, mine, assume_unique=True) & 255] = 1
    return np.packbits(bits).view(np.int64).tolist()


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``both`` (shared shingles), ``a_size`` and ``b_size`` of the pairs (a, b) of classes, from their full sets, and a bit
    map of the shingles of b that a lacks."""

    def run(batches):
        for batch in batches:
            left, right = ([np.asarray(x.values) for x in batch.column(i)] for i in (2, 3))
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)]
            numbers = [both, list(map(len, left)), list(map(len, right)), *zip(*map(bit_map, left, right))]
            columns = [batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in numbers)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "both", "a_size", "b_size", *MAP_NAMES])

    joined = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("left")), "a")
    joined = joined.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("right")), "b")
    schema = ", ".join(f"{c} bigint" for c in ("a", "b", "both", "a_size", "b_size", *MAP_NAMES))
    return texts.whole_texts(joined, "a", "b", "left", "right").mapInArrow(run, schema)


def similar(pairs: DataFrame, percent: int) -> DataFrame:
    """The measured pairs that are similar enough."""
    return pairs.where(100 * F.col("both") >= percent * (F.col("a_size") + F.col("b_size") - F.col("both"))).select("a", "b")


def similar_classes(classes: DataFrame, docs: DataFrame, id_column: str, text: str, percent: int) -> DataFrame:
    """``class`` and ``component`` of every class (class, rep, n and chunks) that is linked with another."""
    entered = classes.select(F.explode(keys(chunk_names(percent))).alias("key"), "class")
    common = entered.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    members = shared.settle(entered.join(shared.settle(common.select("key"), "keys"), "key"), "members")

    # How many shingles of each class that meets another are its own.
    meeting = shared.settle(classes.join(members.select("class").distinct(), "class"), "meeting")
    sets = full_sets(docs, meeting.select("class", "rep"), id_column, text)
    shingles = sets.select("class", F.explode("shingles").alias("shingle")).groupBy("shingle")
    own = shingles.agg(F.count("*").alias("rows"), F.min("class").alias("class")).where("rows = 1").groupBy("class").agg(F.count("*").alias("own"))
    facts = meeting.drop("rep", "set_key").join(own, "class", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0)))
    facts = shared.settle(facts.drop("own").where(100 * F.col("common") >= percent * F.col("n")), "facts")
    nothing = {"lacks": F.lit(0).cast("bigint")} | {m: F.lit(0).cast("bigint") for m in MAP_NAMES}
    unmeasured = facts.withColumns({"hub": F.col("class"), "inside": F.col("n")} | nothing)
    members = members.join(facts.select("class", (1 - F.col("common") / F.col("n")).alias("share")), "class")
    members = shared.settle(members, "members")

    # Every class with one other of its buckets.
    best = F.min(F.struct("share", "class")).alias("hub")
    hubs = members.groupBy("key").agg(best, F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    hubs = shared.settle(hubs.select("key", F.col("hub.class").alias("b"), F.col("hub.share").alias("hub_share")), "hubs")
    met = members.join(hubs, "key").where("class != b").groupBy(F.col("class").alias("a"), "b").agg(F.min("hub_share").alias("hub_share"))
    near = _sides(shared.settle(met, "met"), unmeasured).where(_near(percent))
    first = near.groupBy("a").agg(F.min(F.struct("hub_share", "b")).alias("hub")).select("a", F.col("hub.b").alias("b"))
    first = shared.settle(first, "first-pairs")
    known = shared.settle(measured(first, sets), "measured")
    links = shared.settle(similar(known, percent), "links")
    found = components.components(links)
    lacks = (F.col("b_size") - F.col("both")).alias("lacks")
    against = known.select(F.col("a").alias("class"), F.col("b").alias("hub"), F.col("both").alias("inside"), lacks, *MAP_NAMES)
    itself = {"hub": F.coalesce("hub", "class"), "inside": F.coalesce("inside", "n")}
    itself |= {c: F.coalesce(c, F.lit(0)) for c in ("lacks", *MAP_NAMES)}
    facts = shared.settle(facts.join(against, "class", "left").withColumns(itself), "facts")

    # Pairs that meet under a key and aren't in one component yet.
    placed = members.drop("share").join(found.withColumnRenamed("node", "class"), "class", "left")
    placed = shared.settle(placed.select("key", "class", F.coalesce("component", "class").alias("component")), "placed")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    sides = placed.join(shared.settle(open_keys.select("key"), "open-keys"), "key").join(facts, "class")
    sides = shared.settle(sides, "open-rows")
    named = lambda s: sides.select("key", *(F.col(c).alias(s if c == "class" else f"{s}_{c}") for c in sides.columns if c != "key"))
    apart = (F.col("a") > F.col("b")) & (F.col("a_component") != F.col("b_component"))
    rest = named("a").join(named("b"), "key").where(apart & _near(percent)).select("a", "b").distinct()
    refuted = first.union(first.select("b", "a"))
    rest = shared.settle(rest.join(refuted, ["a", "b"], "left_anti"), "other-pairs")
    if not rest.isEmpty():
        joined = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components.components(similar(measured(rest, sets), percent).union(joined))
    return found.withColumnRenamed("node", "class")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: its id, ``n_shingles``, ``component_id`` (smallest id reachable over links), ``kept`` and ``text_key``
    (64-bit hash of the text).

    Documents are linked when 100 * shared shingles >= ``percent`` * all shingles of the two. Words are what white space of
    ASCII separates, with A-Z in lower case; a text of fewer words than a shingle is one shingle, a null or blank text
    has none and is linked with nothing. Rows with a null id are linked with nothing, have a null component and are
    kept. Rows that repeat an id are judged each by its own text. Other columns aren't read. ``percent`` must be at
    least 80, for which the longest signatures are laid out. Sets are compared as 64-bit digests of their shingles.
    """
    names = chunk_names(percent)
    rows = shared.settle(sketches(docs, id_column, text, percent), "sketches")
    linked = rows.where(F.col(id_column).isNotNull() & (F.col("n_shingles") > 0))
    firsts = [F.first(c).alias(c) for c in names]
    classes = linked.groupBy("set_key", F.col("n_shingles").alias("n")).agg(F.min(id_column).alias("rep"), *firsts)
    classes = shared.settle(classes.withColumn("class", F.xxhash64("set_key")), "classes")
    found = similar_classes(classes, docs, id_column, text, percent)
    joined = classes.join(found, "class", "left").select("set_key", "n", "rep", F.coalesce("component", "class").alias("component"))
    joined = shared.settle(joined, "joined-classes")
    first = shared.settle(joined.groupBy("component").agg(F.min("rep").alias("component_id")), "component-ids")
    reps = shared.settle(joined.join(first, "component").select("set_key", F.col("n").alias("n_shingles"), "component_id"), "class-components")
    own = F.col(id_column)
    judged = rows.select(id_column, "text_key", "n_shingles", "set_key").join(reps, ["set_key", "n_shingles"], "left")
    component = F.when(own.isNotNull(), F.coalesce("component_id", own))
    kept = F.coalesce(own == component, F.lit(True))
    return judged.select(id_column, "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_key")


def first_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, with one document of each group of near-duplicates, and repeated rows (id and text) once."""
    judged = shared.settle(near_duplicates(docs, id_column, text, percent), "judged")
    same_id, same_text = texts.fresh(docs, "same_id"), texts.fresh(docs, "same_text")
    gone = judged.where("NOT kept").select(F.col(id_column).alias(same_id), F.col("text_key").alias(same_text)).distinct()
    again = judged.where(F.col(id_column).isNotNull()).groupBy(id_column, "text_key").count().where("count > 1")
    again = shared.settle(again.select(F.col(id_column).alias(same_id)).distinct(), "repeated-ids")
    same = (F.col(id_column) == F.col(same_id)) & (F.xxhash64(text) == F.col(same_text))
    rest = docs.join(F.broadcast(gone) if gone.count() <= PICKED else gone, same, "left_anti")
    if again.isEmpty():
        return rest
    repeated = F.col(id_column) == F.col(same_id)
    return rest.join(again, repeated, "left_anti").union(rest.join(again, repeated, "left_semi").dropDuplicates([id_column, text]))
