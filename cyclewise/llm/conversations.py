"""Repair of conversations: faults of every turn, the cheapest edits to a whole conversation, and its repaired turns.

A conversation is cut into blocks of turns along its order. For each block the cheapest edits between any two states are found on
their own (``edits``); the blocks of a conversation are then taken in order, one row each, to choose among them. So a
conversation with a large share of all turns is worked on by many tasks; only its edits, one letter a turn, meet in one.
The repaired turns of a conversation are hashed one after the other as they come, sorted, without being held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewise import shared
from cyclewise.llm import edits, places

BLOCK = 1024
BLANKS = " \t\n\x0b\f\r"
BLANK, DUPLICATE, TRUNCATED, NONE = "blank", "duplicate", "truncated", ""
USER, ASSISTANT = "user", "assistant"
WAYS = "array<struct<before:int,after:int,cost:bigint,edits:string>>"


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by the CRC-32 of ``conv_id:turn`` modulo 20 (null written as a space).

    0 drops a turn, 1 empties its text, 2 takes its full stops, question and exclamation marks away, 3 has it twice, 4 makes it a user's.
    Null roles and texts become one space. Columns besides conv_id, turn, role and text are neither read nor kept.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(name) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where("hit != 0").select(
        "conv_id",
        "turn",
        F.when(F.col("hit") == 4, USER).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def judged(turns: DataFrame) -> DataFrame:
    """Every turn with its ``place`` in the conversation and its first ``fault``; in the shared folder.

    Turns go by number, nulls first, then by role and text. A blank text has nothing but white space; a duplicate has role and
    text of an earlier turn; a truncated one doesn't end in a full stop, question or exclamation mark.
    """
    rows = turns.select(
        "conv_id",
        places.key_of(F.col("conv_id")).alias("conversation"),
        F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    own = F.sha2("text", 256)
    placed = shared.settle(places.numbered(rows, "conversation", order, "turns").withColumn("own", own), "turns")
    same = ["conversation", "role", "own"]
    repeated = placed.groupBy(*same).agg(F.count("*").alias("rows"), F.min("place").alias("first")).where("rows > 1").drop("rows")
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    fault = (
        F.when(last == "", BLANK)
        .when(F.col("place") > F.col("first"), DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED)
        .otherwise(NONE)
    )
    found = placed.join(shared.settle(repeated, "repeated-turns"), same, "left").withColumn("fault", fault).drop("own", "first")
    return shared.settle(found.withColumn("block", F.floor(F.col("place") / BLOCK).cast("bigint")), "judged-turns")


def counted(rows: DataFrame) -> DataFrame:
    """Per conversation: ``gaps`` in its turn numbers, and how many turns have each fault."""
    faults = [F.count_if(F.col("fault") == x).alias(x) for x in (BLANK, DUPLICATE, TRUNCATED)]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    return rows.groupBy("conversation").agg(gaps, *faults)


def blocks(rows: DataFrame) -> DataFrame:
    """Per block: the initials and faults of its turns as letters, and the cheapest edits between any two states."""
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    fault = F.when(F.col("fault").isin(BLANK, DUPLICATE), edits.GONE).when(F.col("fault") == TRUNCATED, edits.SHORT).otherwise(edits.WHOLE)
    letters = F.sort_array(F.collect_list(F.struct("place", initial.alias("initial"), fault.alias("fault"))))
    told = rows.groupBy("conversation", "block").agg(letters.alias("letters"))
    written = [F.array_join(F.col("letters")[name], "").alias(f"{name}s") for name in ("initial", "fault")]
    told = told.select("conversation", "block", *written)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            names = ("before", "after", "cost", "edits")
            ways = [[dict(zip(names, way)) for way in edits.through(i, f, b == 0)] for b, i, f in zip(*columns[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ways, _ways_type())], names=["conversation", "block", "initials", "ways"])

    return told.mapInArrow(run, f"conversation string, block bigint, initials string, ways {WAYS}")


def _ways_type() -> pa.DataType:
    return pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Whole conversations in one partition each, one after the other."""
    return rows.repartition("conversation").sortWithinPartitions("conversation", *order)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[tuple]]]:
    """(conversation, its rows) over batches sorted by the first column; the rows are read as they are asked for."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, key=lambda row: row[0])


def _illegal(initials: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))


def chosen(told: DataFrame) -> DataFrame:
    """From the blocks, in the shared folder: per block what becomes of its turns (``fates``), per conversation a row with a null
    block, its ``cost``, its ``audit`` (all edits) and ``illegal`` (neighbours whose initials may not follow each other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conversation", "block", "fates", "cost", "audit", "illegal"]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64()]
        out: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        for conversation, rows in _runs(batches):
            held, initials, illegal, last = edits.begin(edits.START, False), [], 0, ""
            for _, _, letters, ways in rows:
                illegal += _illegal(last + letters)
                last = letters[-1:]
                initials.append(letters)
                held = edits.after_block(held, [(w["before"], w["after"], w["cost"], w["edits"]) for w in ways])
            cost, audit = edits.best(held)
            state, pieces = edits.START, audit.pieces()
            for block, (piece, letters) in enumerate(zip(pieces, initials)):
                state, fates = edits.by_row(state, piece, letters)
                out.append((conversation, block, fates, None, None, None))
                if len(out) >= BLOCK:
                    yield flush()
                    out.clear()
            out.append((conversation, None, None, cost, "".join(pieces), illegal))
        if out:
            yield flush()

    schema = "conversation string, block bigint, fates array<string>, cost bigint, audit string, illegal bigint"
    return shared.settle(_in_order(told, "block").mapInArrow(run, schema), "edits")


def repaired(rows: DataFrame, fates: DataFrame) -> DataFrame:
    """The repaired turns: conversation, ``place`` (of the turn that they come from or follow), ``part`` at that place, role and text."""
    same = ["conversation", "block"]
    fate = F.get("fates", (F.col("place") % BLOCK).cast("int"))
    told = rows.join(fates.where("block IS NOT NULL").select(*same, "fates"), same)
    told = told.select("conversation", "place", "role", "text", fate.alias("fate")).where("fate != 'D'")
    letters = F.transform(F.sequence(F.lit(1), F.length("fate")), lambda i: F.substring("fate", i, 1))
    letter = F.col("letter")
    told = told.select("conversation", "place", "role", "text", F.posexplode(letters).alias("part", "letter"))
    own = letter.isin("K", "u", "a")
    role = F.when(letter == "K", F.col("role")).when(F.upper("letter") == "U", USER).otherwise(ASSISTANT)
    return told.where(letter != "D").select("conversation", "place", "part", role.alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"))


def hashed(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, joined by line feeds; a conversation's turns pass one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conversation, rows in _runs(batches):
            digest = hashlib.sha256()
            for i, row in enumerate(rows):
                digest.update(("\n" if i else "").encode() + row[3].encode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array([conversation]), pa.array([digest.hexdigest()])], names=["conversation", "repaired_sha256"])

    lines = turns.select("conversation", "place", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    return _in_order(lines, "place", "part").mapInArrow(run, "conversation string, repaired_sha256 string")


def audit(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per id in ``conversations``: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    ``turns`` has conv_id, turn, role and text; null roles and texts count as one space, a null conv_id is a conversation of its
    own. Ids without turns have zeros, no edits and the hash of an empty text. Other columns are not looked at.
    """
    rows = judged(turns)
    fates = chosen(blocks(rows))
    facts = counted(rows).join(fates.where("block IS NULL").drop("block", "fates"), "conversation")
    facts = facts.join(hashed(repaired(rows, fates)), "conversation", "left")
    ids = conversations.select("conv_id").distinct().withColumn("conversation", places.key_of(F.col("conv_id")))
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    told = ids.join(facts, "conversation", "left")
    return told.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
