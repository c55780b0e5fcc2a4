"""Near-duplicates against all pairs of full sets."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cyclewise.llm import components, near_dup


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(pairs, percent=85):
    """(id, shingles, component) of every row, by comparing all distinct sets."""
    sets = [shingles(t) for _, t in pairs]
    rows_of = defaultdict(list)
    for n, (i, _) in enumerate(pairs):
        if i is not None and sets[n]:
            rows_of[sets[n]].append(n)
    classes = list(rows_of)
    label = {c: min(pairs[n][0] for n in rows_of[c]) for c in classes}
    parent = {i: i for i in label.values()}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(classes):
        for b in classes[:x]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                low, high = sorted((root(label[a]), root(label[b])))
                parent[high] = low
    out = []
    for (i, _), s in zip(pairs, sets):
        component = None if i is None else root(label[s]) if s else i
        out.append((i, len(s), component, i is None or component == i))
    return out


def variants(base, count, edits, seed, first):
    draw = random.Random(seed)
    out = []
    for n in range(count):
        words = list(base)
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(len(words))] = f"n{draw.randrange(10**6)}"
        out.append((first + n, " ".join(words)))
    return out


def test_documents(spark, frame, edge_pairs):
    draw = random.Random(4)
    fresh = lambda n: [f"v{draw.randrange(10**6)}" for _ in range(n)]
    passage = fresh(60)
    pairs = [p for p in edge_pairs if p[0] != 6]
    pairs += variants(fresh(200), 120, 3, 1, 100)  # a group of near copies, many pairs about the limit
    pairs += variants(fresh(40), 30, 1, 2, 300)
    pairs += [(400 + i, " ".join(passage + fresh(30))) for i in range(60)]  # a passage that many share
    pairs += [(500 + i, " ".join(passage)) for i in range(40)]  # copies
    chain = fresh(400)
    pairs += [(600 + i, " ".join(chain[8 * i : 8 * i + 200])) for i in range(20)]  # each like the next only
    pairs += [(700 + i, t) for i, t in enumerate(["A B c", "a b C", "a b c d e", "A  B c d\te", "a b c d e f"])]
    got = near_dup.near_duplicates(frame(pairs)).drop("text_key").collect()
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted(brute(pairs), key=order)


def test_lower_similarity(spark, frame):
    """The longer signatures, on many pairs about 0.8."""
    pairs = variants([f"w{i}" for i in range(200)], 80, 5, 3, 0) + variants([f"u{i}" for i in range(60)], 40, 2, 4, 100)
    want = brute(pairs, 80)
    assert want != brute(pairs)
    got = near_dup.near_duplicates(frame(pairs), percent=80).drop("text_key").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert near_dup.near_duplicates(frame(pairs)).count() == len(pairs)
    with pytest.raises(ValueError):
        near_dup.near_duplicates(frame([]), percent=79)


def test_one_of_each(spark, frame, edge_pairs):
    pairs = [*edge_pairs, (7, "another text under the same id")]
    docs = frame(pairs)
    kept = near_dup.first_of_each(docs)
    assert kept.columns == docs.columns
    want = {(i, t) for (i, t), (_, _, _, keep) in zip(pairs, brute(pairs)) if keep}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("picked", [0, 1 << 20])
def test_joined_instead_of_sent(spark, frame, monkeypatch, picked):
    monkeypatch.setattr(near_dup, "PICKED", picked)
    pairs = variants([f"w{i}" for i in range(100)], 20, 2, 1, 0) + [(50, None)]
    got = near_dup.near_duplicates(frame(pairs)).drop("text_key").collect()
    assert sorted(map(tuple, got)) == sorted(brute(pairs))
    assert near_dup.first_of_each(frame(pairs)).count() == sum(r[3] for r in brute(pairs))


def test_nothing(spark, frame):
    assert near_dup.near_duplicates(frame([])).collect() == []
    assert near_dup.first_of_each(frame([])).collect() == []
    with pytest.raises(ValueError):
        near_dup.near_duplicates(frame([]), percent=50)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(0, near_dup.ERRORS))
def test_pairs_within_the_distance_share_a_key(seed, errors):
    """Pigeonhole: any ``ERRORS`` symbols may differ."""
    draw = np.random.default_rng(seed)
    symbols = draw.integers(0, 1 << near_dup.BITS, near_dup.HASHES)
    other = symbols.copy()
    at = draw.permutation(near_dup.HASHES)[:errors]
    other[at] ^= draw.integers(1, 1 << near_dup.BITS, errors)
    blotted = [set(), set()]
    for side, row in enumerate((symbols, other)):
        for chunk, part in enumerate(row.reshape(near_dup.CHUNKS, near_dup.LANES)):
            for lane in range(near_dup.LANES):
                blotted[side].add((chunk, lane, tuple(np.delete(part, lane))))
    assert blotted[0] & blotted[1]


def test_distance_and_keys_in_spark(spark):
    draw = np.random.default_rng(3)
    symbols = draw.integers(0, 3, (40, near_dup.HASHES)).astype(np.uint64)
    shifts = np.arange(near_dup.LANES, dtype=np.uint64) * np.uint64(near_dup.BITS)
    chunks = (symbols.reshape(40, near_dup.CHUNKS, near_dup.LANES) << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)
    rows = [(i, *(int(x) for x in c)) for i, c in enumerate(chunks)]
    frame = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} bigint" for c in near_dup.CHUNK_NAMES))
    side = lambda p: frame.select(*(F.col(c).alias(p + c) for c in frame.columns))
    pairs = side("a_").join(side("b_"), F.col("a_i") < F.col("b_i")).select("a_i", "b_i", near_dup.errors("a_", "b_")).collect()
    assert all(n == int((symbols[a] != symbols[b]).sum()) for a, b, n in pairs) and len(pairs) == 780
    keys = frame.select(near_dup.keys().alias("keys")).collect()
    assert all(len(set(r["keys"])) == near_dup.HASHES for r in keys)


def test_signatures_tell_similarity():
    draw = np.random.default_rng(9)
    same, mine, other = (draw.integers(0, 1 << 63, n, dtype=np.uint64) for n in (9000, 500, 500))
    rows = near_dup.signatures([np.unique(np.r_[same, mine]), np.unique(np.r_[same, other]), np.empty(0, dtype=np.uint64)])
    symbols = rows.view(np.uint64)[:, :, None] >> (np.arange(4, dtype=np.uint64) * np.uint64(16)) & np.uint64(0xFFFF)
    assert (symbols[0] != symbols[1]).sum() <= 10 and not rows[2].any()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30))
def test_bit_maps_never_say_too_much(seed):
    """Bits that only one map has can't be more than the shingles that only that side lacks."""
    draw = np.random.default_rng(seed)
    hub = np.unique(draw.integers(0, 1 << 62, 300))
    x, y = (np.setdiff1d(hub, draw.choice(hub, draw.integers(0, 250))) for _ in range(2))
    ones = lambda m: {(i, b) for i, part in enumerate(m) for b in range(64) if part >> b & 1}
    lacks_x, lacks_y = (ones(near_dup.bit_map(s, hub)) for s in (x, y))
    both = len(np.intersect1d(x, y))
    assert both <= len(hub) - (len(hub) - len(x)) - len(lacks_y - lacks_x)
    assert both <= len(hub) - (len(hub) - len(y)) - len(lacks_x - lacks_y)


@settings(max_examples=4, deadline=None)
@given(links=st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    parent = list(range(31))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = components.components(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {n: root(n) for pair in links for n in pair}
    assert len(got) == len({n for pair in links for n in pair})


def test_long_path(spark):
    path = spark.range(1, 300).selectExpr("id AS a", "id - 1 AS b")
    assert {r.component for r in components.components(path).collect()} == {0}


def test_whole_table(spark, small):
    from cyclewise.llm import queries

    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.queries()["op7_minhash"](spark, small).collect()
    assert sorted(map(tuple, got)) == sorted(brute(pairs))
