"""The quality classifier."""

import math
import zlib

import numpy as np
import pytest

from cyclewise.llm import queries, quality


def test_trees_learn_and_walk_alike():
    draw = np.random.default_rng(2)
    rows = draw.normal(size=(3000, 5))
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 2] < 0)).astype(float)
    trees = quality.fit(rows[:2000], labels[:2000])
    assert ((trees.score(rows[2000:]) >= 0.5) == labels[2000:]).mean() > 0.95

    def walk(row):
        total = trees.start
        for t in range(len(trees.leaf)):
            at = 0
            while at < trees.feature.shape[1]:
                at = 2 * at + 1 + int(row[trees.feature[t, at]] > trees.cut[t, at])
            total += trees.leaf[t, at - trees.feature.shape[1]]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in rows[:50]], trees.score(rows[:50]))


def plain_fit(rows, labels, fitted):
    """The same boosting by loops over rows, features and cuts; gives the leaves of every tree and the scores.

    Of splits that are equally good (they part the same rows) the one in ``fitted`` is followed.
    """
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    margin = [math.log(share / (1 - share))] * len(rows)
    cuts = [sorted({float(q) for q in np.quantile(rows[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])}) for f in range(rows.shape[1])]
    trees = []
    for t in range(quality.TREES):
        slope = [1 / (1 + math.exp(-m)) - y for m, y in zip(margin, labels)]
        bend = [(s + y) * (1 - s - y) for s, y in zip(slope, labels)]
        members = {0: list(range(len(rows)))}
        gain = lambda own: sum(slope[i] for i in own) ** 2 / (sum(bend[i] for i in own) + quality.RIDGE)
        for node in range(2**quality.DEPTH - 1):
            own, won = members[node], {}
            for f, edges in enumerate(cuts):
                for cut in edges:
                    left = [i for i in own if rows[i, f] <= cut]
                    right = [i for i in own if rows[i, f] > cut]
                    if min(len(left), len(right)) >= quality.LEAST:
                        won[f, cut] = gain(left) + gain(right) - gain(own)
            f, cut = int(fitted.feature[t, node]), float(fitted.cut[t, node])
            most = max(won.values(), default=0)
            assert (won[f, cut] >= most * (1 - 1e-9)) if most > 1e-9 else cut == math.inf
            members[2 * node + 1] = [i for i in own if rows[i, f] <= cut]
            members[2 * node + 2] = [i for i in own if rows[i, f] > cut]
        leaves = []
        for leaf in range(2**quality.DEPTH - 1, 2 ** (quality.DEPTH + 1) - 1):
            own = members[leaf]
            leaves.append(-quality.RATE * sum(slope[i] for i in own) / (sum(bend[i] for i in own) + quality.RIDGE))
            for i in own:
                margin[i] += leaves[-1]
        trees.append(leaves)
    return trees, [1 / (1 + math.exp(-m)) for m in margin]


@pytest.mark.parametrize("seed", range(6))
def test_fitting_by_loops(monkeypatch, seed):
    """Every split, leaf and score of the fit over arrays is that of a fit by loops."""
    for name, value in (("TREES", 4), ("DEPTH", 3), ("BINS", 8), ("LEAST", 3)):
        monkeypatch.setattr(quality, name, value)
    draw = np.random.default_rng(seed)
    rows = draw.normal(size=(90, 4))
    rows[:, 1] = np.round(rows[:, 1])  # many equal values
    labels = (rows[:, 0] + rows[:, 1] * rows[:, 2] + draw.normal(size=90) * 0.3 > 0).astype(float)
    trees = quality.fit(rows, labels)
    leaves, scores = plain_fit(rows, labels, trees)
    assert np.allclose(trees.leaf, leaves)
    assert np.allclose(trees.score(rows), scores)


@pytest.mark.parametrize("labels", [[], [1.0], [1.0, 1.0], [0.0] * 30])
def test_constant_where_there_is_nothing_to_learn(labels):
    trees = quality.fit(np.zeros((len(labels), len(quality.FEATURES))), np.array(labels))
    scores = trees.score(np.zeros((2, len(quality.FEATURES))))
    assert 0 < scores[0] < 1 and scores[0] == scores[1]


@pytest.mark.parametrize("text", ["", " ", "\n", "a", "🙂" * 9, "x" * 100000, "one two\n" * 5000])
def test_statistics_are_finite(text):
    assert len(quality.statistics(text)) == len(quality.FEATURES) and np.isfinite(quality.statistics(text)).all()


def test_documents(spark, frame, edge_pairs):
    good = [(1000 + i, " ".join(f"word{(i * j) % 97}" for j in range(60)) + ".") for i in range(150)]
    bad = [(2000 + i, "BUY!! " * (20 + i)) for i in range(150)]
    docs = frame([*edge_pairs, *good, *bad])
    marks = [(i, 1, None) for i, _ in good] + [(i, 0, 1) for i, _ in bad] + [(None, 1, 0), (1000, None, 0), (99999, 0, 0), (1001, 7, 0)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    trees = quality.fit_on(docs, labels)
    rows = quality.score(docs, trees, "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    score = {r.doc_id: r.score for r in rows}
    assert min(score[i] for i, _ in good) > 0.7 > 0.3 > max(score[i] for i, _ in bad)
    kept = quality.accepted(docs, trees)
    assert kept.columns == docs.columns and {i for i, _ in good} <= {r.doc_id for r in kept.collect()}
    assert not {i for i, _ in bad} & {r.doc_id for r in kept.collect()}
    assert quality.fit_on(docs, labels).leaf.tolist() == trees.leaf.tolist()  # the same on every run
    assert quality.score(frame([]), trees, "doc_id").collect() == []
    nothing = quality.fit_on(docs, labels.limit(0))
    assert len({r.score for r in quality.score(docs, nothing, "doc_id").collect()}) == 1


def test_share_of_many_labels(spark, frame):
    docs = frame([(i, f"text {i}") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    assert quality.fit_on(docs, labels, most=0).leaf.size == 0  # no row is within the bound


def test_rows_that_repeat_an_id_are_bounded(spark, frame, monkeypatch):
    """Labels and documents that repeat one id, with equal and with different texts."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, labels: seen.append(sorted(labels)))
    docs = frame([(1, f"text {i}") for i in range(3000)] + [(1, "copy")] * 3000 + [(4, "other"), (4, None)])
    labels = spark.createDataFrame([(1, 1, 0)] * 50 + [(4, 0, 0)], "doc_id bigint, quality int, toxic int")
    quality.fit_on(docs, labels)
    quality.fit_on(docs, labels, most=600)
    assert seen[0] == [0.0] * 2 + [1.0] * 3001
    assert 150 < len(seen[1]) < 600


def test_held_out_accuracy(spark):
    """On rows that no label is learnt from, at the smallest size with enough of them."""
    sf = "/root/testdata/sf0.1"
    rows = queries.queries()["op10_quality"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 500 and sum(p == q for p, q in judged) / len(judged) > 0.98
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
