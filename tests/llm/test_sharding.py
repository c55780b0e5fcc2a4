"""Shards by differencing."""

import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cyclewise.llm import sharding


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=80))
def test_parts_add_up(sizes):
    goes, total = sharding.difference([[s, 0, 0, 0] for s in sizes])
    sums = [0] * 4
    for size, to in zip(sizes, goes):
        assert sorted(to) == [0, 1, 2, 3]
        sums[to[0]] += size
    assert sums == total
    assert max(total) - min(total) <= max(sizes)


def test_two_way_differencing_by_hand():
    """8, 7, 6, 5, 4: the method ends with a difference of 2 (16 and 14)."""
    assert sorted(sharding.difference([[s, 0] for s in (8, 7, 6, 5, 4)])[1]) == [14, 16]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 500), min_size=3, max_size=3), min_size=1, max_size=30))
def test_partial_partitions(items):
    goes, total = sharding.difference(items)
    sums = [0] * 3
    for sizes, to in zip(items, goes):
        for size, part in zip(sizes, to):
            sums[part] += size
    assert sums == total


def check(rows, pairs, shards=8):
    assert len(rows) == len(pairs)
    by_id = defaultdict(list)
    for i, t in pairs:
        by_id[i].append((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    held = defaultdict(list)
    for r in rows:
        held[r.doc_id].append((r.size, r.text_crc32))
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert {k: sorted(v) for k, v in held.items()} == {k: sorted(v) for k, v in by_id.items()}
    slots, homes = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        homes[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in homes.values())


@pytest.mark.parametrize("small", [False, True])
def test_documents(spark, frame, edge_pairs, monkeypatch, small):
    if small:
        monkeypatch.setattr(sharding, "SLICE_ROWS", 20)
        monkeypatch.setattr(sharding, "SLOT_ROWS", 7)
    pairs = [*edge_pairs, *((100 + i, f"text {i} " * (i % 37)) for i in range(400)), *((1000 + i, "copies " * 9) for i in range(150))]
    check(sharding.shard_documents(frame(pairs)).collect(), pairs)


def test_few_and_none(spark, frame):
    assert sharding.shard_documents(frame([])).collect() == []
    check(sharding.shard_documents(frame([(1, None), (2, "")])).collect(), [(1, None), (2, "")])


def test_whole_table(spark, small):
    from cyclewise.llm import queries

    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = queries.queries()["op6_sharding"](spark, small).collect()
    check(rows, pairs)
    bytes_of = defaultdict(int)
    for r in rows:
        bytes_of[r.shard] += r.size
    largest = max(len((t or "").encode()) + 1 for _, t in pairs)
    assert max(bytes_of.values()) - min(bytes_of.values()) < 0.02 * max(bytes_of.values()) + largest // 8


def plain_differencing(sizes, shards=8):
    """item -> shard, with all partial partitions in lists."""
    pool = {n: [(size, [item])] + [(0, [])] * (shards - 1) for n, (item, size) in enumerate(sorted(sizes.items()))}
    made = len(pool)
    while len(pool) > 1:
        spread = lambda n: (pool[n][-1][0] - pool[n][0][0], n)
        a = pool.pop(min(pool, key=spread))
        b = pool.pop(min(pool, key=spread))
        both = [(x + y, left + right) for (x, left), (y, right) in zip(a, reversed(b))]
        pool[made] = sorted(both, key=lambda part: -part[0])
        made += 1
    return {item: shard for part in pool.values() for shard, (_, items) in enumerate(part) for item in items}


def test_query_by_plain_differencing(spark, small):
    """The query's shards are those of differencing all groups of equal texts in one list."""
    from cyclewise.llm import queries

    docs = spark.read.parquet(f"{small}/documents.parquet")
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(body).alias("item"), (F.octet_length(body) + 1).alias("size")).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.item] += r["size"]
    homes = plain_differencing(sizes)
    got = {r.doc_id: r.shard for r in queries.queries()["op6_sharding"](spark, small).collect()}
    assert got == {r.doc_id: homes[r.item] for r in rows} and len(set(homes.values())) == 8
