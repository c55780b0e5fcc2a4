"""Shards of nearly equal bytes by Karmarkar-Karp differencing over groups that stay together.

A partial partition has one size for each shard. Differencing takes the two with the largest spread and joins the largest
part of one with the smallest of the other, and so on. Groups are dealt to slices by hash; every slice is differenced in
a task of its own and ends as one partial partition; these are differenced in turn, level by level, until one is left. What
each level decides is a renumbering of eight shards, kept in tables; no list of groups is ever in one place.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclewise import shared

SLICE_ROWS = 1 << 14
SLOT_ROWS = 1 << 14


def difference(items: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """For every partial partition, which part of the result each of its parts goes to; and the result's sizes."""
    width = len(items[0])
    ranked = [sorted(range(width), key=lambda p, s=s: (-s[p], p)) for s in items]
    sizes = [[s[p] for p in order] for s, order in zip(items, ranked)]  # by node, the largest part first
    joins: list[tuple[int, int, list[int]]] = []
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = [x + y for x, y in zip(sizes[a], reversed(sizes[b]))]
        order = sorted(range(width), key=lambda p: -both[p])
        joins.append((a, b, order))
        sizes.append([both[p] for p in order])
        heapq.heappush(heap, (sizes[-1][-1] - sizes[-1][0], len(sizes) - 1))
    goes = [None] * len(sizes)
    goes[-1] = list(range(width))
    for node in range(len(sizes) - 1, len(items) - 1, -1):
        a, b, order = joins[node - len(items)]
        left, right = [0] * width, [0] * width
        for place, p in enumerate(order):
            left[p] = right[width - 1 - p] = goes[node][place]
        goes[a], goes[b] = left, right
    out = []
    for order, to in zip(ranked, goes):
        part = [0] * width
        for place, p in enumerate(order):
            part[p] = to[place]
        out.append(part)
    return out, sizes[-1]


def _level(items: DataFrame, slices: int) -> DataFrame:
    """Every slice of ``items`` (item, sizes) differenced: where the parts of each item go, and a last row with the sizes."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", ignore_index=True)
        goes, left = difference([[int(x) for x in s] for s in rows["sizes"]])
        last = [False] * len(goes) + [True]
        return pd.DataFrame({"slice": key[0], "item": [*rows["item"], key[0]], "last": last, "parts": [*goes, left]})

    dealt = items.withColumn("slice", F.pmod(F.xxhash64("item", F.lit(slices)), F.lit(slices)).cast("long"))
    return dealt.groupBy("slice").applyInPandas(run, "slice bigint, item bigint, last boolean, parts array<bigint>")


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``group`` and ``shard`` for ``groups`` (group, bytes; one row each)."""
    first = F.concat(F.array("bytes"), F.array_repeat(F.lit(0).cast("bigint"), shards - 1))
    items = groups.select(F.col("group").alias("item"), first.alias("sizes"))
    levels, n = [], groups.count()
    while True:
        slices = max(1, -(-n // SLICE_ROWS))
        level = shared.settle(_level(items, slices), "shard-level")
        levels.append(level.where("NOT last"))
        items = level.where("last").select("item", F.col("parts").alias("sizes"))
        if slices == 1:
            break
        n = slices
    # From the last level down: where the parts of every slice end up.
    ends = levels[-1].select("item", F.col("parts").alias("ends"))
    for level in reversed(levels[:-1]):
        up = ends.withColumnRenamed("item", "slice")
        ends = level.join(up, "slice").select("item", F.transform("parts", lambda p: F.get("ends", p.cast("int"))).alias("ends"))
    return ends.select(F.col("item").alias("group"), F.get("ends", F.lit(0)).cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, ``size`` (UTF-8 bytes and one), ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    The shards are of nearly equal bytes (law ``bytes``); equal texts share a shard; slots number a shard's rows without
    gaps from 0. A null text is an empty one, a null id stays null; repeated rows get a slot each. Groups go by 64-bit hash:
    should two texts share one, they only stay together as well. ``grown_shard`` is null under this law.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("group"),
    )
    rows = shared.settle(rows, "shard-rows")
    groups = shared.settle(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-groups")
    homes = shared.settle(assign_groups(groups, shards), "shard-homes")
    placed = rows.join(homes, "group")
    slices = F.pmod(F.xxhash64("id", "group"), F.lit(max(1, -(-rows.count() // SLOT_ROWS)))).cast("int")
    placed = shared.settle(placed.withColumn("slice", slices), "shard-placed")
    counts = placed.groupBy("shard", "slice").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = shared.settle(counts.select("shard", "slice", F.coalesce(before, F.lit(0)).alias("before")), "shard-offsets")
    place = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("id", "group")) - 1
    numbered = placed.withColumn("place", place).join(offsets, ["shard", "slice"])
    return numbered.select(
        F.col("id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") + F.col("before")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
