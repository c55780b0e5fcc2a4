"""Trees, proofs and checks against a version that holds all rows in lists."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cyclewise.llm import merkle, places, queries

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Root of a list of digests, and for each its siblings as (left, right) from below."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, n in zip(paths, own):
            first = n // 3 * 3
            path.append(("".join(nodes[first:n]), "".join(nodes[n + 1 : first + 3])))
        nodes, own = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [n // 3 for n in own]
    return nodes[0], paths


def brute(rows):
    """Result rows for (doc_id, text, lang, source, n_chars) rows."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        hit = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        arrived = leaf(doc_id, source, lang, n_chars, text.replace("\n", "") if hit else text)
        groups[source].append(((doc_id is not None, doc_id or 0), leaf(doc_id, source, lang, n_chars, text), doc_id, arrived))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in order}
    root, tops = climb([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, top in zip(order, tops):
        for (_, own, doc_id, arrived), path in zip(sorted(groups[s], key=lambda x: x[:2]), trees[s][1]):
            digest = arrived
            for left, right in path + top:
                digest = sha(left, digest, right)
            proof = sha(*(x for step in path + top for x in step))
            out.append((doc_id, own, trees[s][0], root, proof, digest, digest == root))
    return sorted(out, key=str)


def told(docs):
    return sorted(map(tuple, merkle.verify(docs, merkle.without_line_feeds()).collect()), key=str)


def plain(docs):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_odd_rows(frame, edge_pairs):
    docs = frame(edge_pairs)
    assert told(docs) == brute(plain(docs))


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [81, 82, 4], [300, 1, 1, 244], [1] * 90, [7000]])
def test_sizes(spark, sizes):
    """Trees of one, two and three bands, and a tree over many groups; a null group, an empty one, names beyond ASCII."""
    names = [None, "", "é", "e", "z", "￿", "😀"]
    name = lambda i: names[i] if i < len(names) else f"s{i}"
    flat = [(i, name(g)) for g, size in enumerate(sizes) for i in range(size)]
    rows = [(1000 * i, f"t\n{i}" if i % 5 else None, None, s, i) for i, s in flat]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got, want = told(docs.repartition(7)), brute(rows)
    assert len({r[3] for r in got}) == 1 and got == want
    assert {r[6] for r in got} <= {True, False} and any(not r[6] for r in got) == any(not r[6] for r in want)


def test_intervals(spark):
    """Each level's intervals cover all leaf ranks once; a node lies inside one node of the level above."""
    docs = spark.range(700).select(F.col("id").alias("doc_id"), *[F.lit("x").alias(c) for c in ("source", "lang", "text")], F.lit(1).alias("n_chars"))
    made = merkle.Manifest(docs)
    levels = defaultdict(list)
    for n in merkle.nodes(made.bands).collect():
        levels[n.level].append((n.lo, n.hi, n.digest))
    assert sorted(levels) == list(range(7)) and len(levels[6]) == 1
    for level in range(7):
        spans = sorted(levels[level])
        assert [s[0] for s in spans] == [0, *(s[1] for s in spans[:-1])] and spans[-1][1] == 700
        for lo, hi, digest in spans if level else ():
            assert digest == sha(*(d for a, b, d in sorted(levels[level - 1]) if lo <= a and b <= hi))


def test_changed_rows_are_found(frame):
    docs = frame([(i, f"line {i}\nend" if i % 2 else "one line") for i in range(40)])
    rows = {r.doc_id: r for r in merkle.verify(docs, merkle.without_line_feeds()).collect()}
    for i in range(40):
        assert rows[i].verified == (i % 2 == 0 or zlib.crc32(str(i).encode()) % 2 == 1)


def test_no_rows(frame):
    assert told(frame([])) == []


def test_places(spark):
    """Numbered in order although a group lies in several partitions."""
    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), (-F.col("id")).alias("x"))
    got = places.numbered(rows, "g", [F.asc("x")], "test").where("g = 'hot'").orderBy("x").collect()
    assert [r.place for r in got] == list(range(len(got))) and {r["size"] for r in got} == {len(got)}


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted(map(tuple, queries.queries()["op11_merkle"](spark, small).collect()), key=str)
    assert rows == brute(plain(docs))
