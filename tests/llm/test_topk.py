"""Exact top-k against all products."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cyclewise.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, shard string"


def brute(rows, k, step):
    whole = {}
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    asking = {}
    for (i, v), (_, raw) in zip(usable, [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]):
        if i % step == 0 and (i not in asking or raw < asking[i][1]):
            asking[i] = (v, raw)
    for q, (v, _) in asking.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def rows_of(n, width, seed):
    draw = random.Random(seed)
    f32 = lambda: float(np.float32(draw.gauss(0, 0.2)))
    return [(i, [f32() for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_all_products(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(topk, "SHARD_ROWS", 60)
        monkeypatch.setattr(topk, "LEAF_ROWS", 4)
    rows = rows_of(400, 6, 1)
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # copies, and ties
    rows += [(2000, None), (2001, []), (2002, [None, 1.0]), (2003, [float("nan")]), (2004, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(2010, [0.5]), (2020, [0.25] * 9), (5, rows[7][1]), (10, rows[8][1]), (2030, [3e30] * 6)]
    frame = spark.createDataFrame([(i, v, None, "x", "y") for i, v in rows], SCHEMA)
    got = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 10 == 0).collect()]
    limit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = {(q, r, i, limit(s)) for q, r, i, s in brute(rows, 10, 10)}
    huge = {q for q, _, _, s in want if abs(s) == (1 << 63) - 1 or s == -(1 << 63)} | {2030}
    assert {g for g in got if g[0] not in huge} == {w for w in want if w[0] not in huge} and len(got) == len(want)


def test_few_and_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(empty, F.col("vec_id") % 10 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0], 1, "", ""), (1, [-1.0], 1, "", "")], SCHEMA)
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") % 10 == 0).collect()] == [(0, 1, 1, -(1024 * 1024))]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 5), st.integers(1, 120), st.sampled_from([None, -50, 0, 5000]))
def test_tree(seed, width, n, floor):
    draw = np.random.default_rng(seed)
    rows, ids = draw.integers(-9, 9, (n, width)).astype(float), draw.permutation(n)
    query = draw.integers(-9, 9, width).astype(float)
    scored = sorted(((int(r @ query), int(i)) for r, i in zip(rows, ids) if i != 3), key=lambda b: (-b[0], b[1]))[:7]
    got = topk.BallTree(ids, rows, leaf=4).search(query, 7, 3, floor)
    assert [b for b in got if floor is None or b[0] >= floor] == [b for b in scored if floor is None or b[0] >= floor]


def test_nodes_are_skipped():
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(16, 8)) * 1000
    rows = np.floor(np.repeat(centres, 256, axis=0) + draw.normal(size=(4096, 8)))
    tree = topk.BallTree(np.arange(4096), rows)
    opened = []
    tree.rows = type("Seen", (np.ndarray,), {"__getitem__": lambda s, k: opened.append(len(k)) or np.asarray(s)[k]})(rows.shape, buffer=rows)
    tree.search(rows[0], 10, 0, None)
    assert sum(opened) < 4096 / 4


def test_queries_go_where_they_can_score(spark):
    """Balls that can't reach a query's floor aren't asked, and all that can are; a crowded ball's shards are all asked."""
    draw = np.random.default_rng(2)
    centres = np.floor(draw.normal(size=(20, 6)) * 1000)
    rows = np.floor(np.repeat(centres, 50, axis=0) + draw.normal(size=(1000, 6)) * 20)
    pivots = topk.Pivots(centres)
    number, distance = pivots.nearest(rows)
    assert (number == np.repeat(np.arange(20), 50)).all()
    pivots.radii, pivots.parts[3] = np.array([distance[number == p].max() for p in range(20)]), 3
    asked, want = [], {}
    for i in range(0, 1000, 25):
        scores = rows @ rows[i]
        scores[i] = -np.inf
        floor = int(np.sort(scores)[-10])
        asked.append((i, (rows[i] / 1024).tolist(), floor))
        want[i] = {int(number[j]) for j in np.flatnonzero(scores >= floor)}
    frame = spark.createDataFrame(asked, "id bigint, vector array<double>, floor bigint")
    starts = np.cumsum([0, *pivots.parts])
    sent = {i: set() for i in want}
    total = 0
    for first in (True, False):
        for r in topk._sent(frame, pivots, 6, first).collect():
            sent[r.id].add(int(np.searchsorted(starts, r.shard, side="right")) - 1)
            total += 1
    assert all(want[i] <= sent[i] for i in want)
    assert total < 0.4 * len(asked) * starts[-1]
    assert topk._sent(frame.withColumn("floor", F.lit(None).cast("bigint")), pivots, 6, False).count() >= len(asked) * 19
