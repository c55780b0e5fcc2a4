"""A quality classifier: histogram gradient-boosted trees over statistics of a document.

Only the text is looked at. The trees are fitted with numpy on at most about ``TRAIN_ROWS`` labelled rows (a share of all
labelled rows by the hash of id and text); every document is scored on the executors. The fitted trees are flat arrays, and
all trees are walked at once for a batch of documents.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewise import shared
from cyclewise.llm import texts

TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 80, 4, 0.15, 64, 10, 1.0
KEEP_FROM = 0.7

_KINDS = ("letter", "upper", "digit", "space", "mark", "sign", "high")
_MARKS = b".,;:!?'\"()-"


def _kinds() -> np.ndarray:
    """Which kinds each byte belongs to."""
    out = np.zeros((256, len(_KINDS)))
    for b in range(256):
        c = bytes([b])
        out[b] = (c.isalpha(), c.isupper(), c.isdigit(), c.isspace(), b in _MARKS, 32 < b < 127 and not c.isalnum() and b not in _MARKS, b > 127)
    return out


KINDS = _kinds()
FEATURES = (
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "distinct_pairs", "repeated_neighbours",
    "log_lines", "distinct_lines", "line_length", "marked_words", "entropy", "top_byte", *_KINDS,
)


def statistics(text: str) -> list[float]:
    """The features of one text; all are 0 for an empty one."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = counts / len(raw)
    some = shares[shares > 0]
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    seen = Counter(words)
    return [
        math.log1p(len(raw)),
        math.log1p(len(words)),
        sum(map(len, words)) / n,
        len(seen) / n,
        max(seen.values(), default=0) / n,
        len(set(zip(words, words[1:]))) / n,
        sum(map(eq, words, words[1:])) / n,
        math.log1p(len(lines)),
        len(set(lines)) / len(lines),
        math.log1p(len(raw) / len(lines)),
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in seen) / max(1, len(seen)),
        float(-(some * np.log2(some)).sum()),
        float(shares.max()),
        *(shares @ KINDS).tolist(),
    ]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth as arrays (tree, node); node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row."""
        trees, total = np.arange(len(self.leaf)), np.full(len(rows), self.start)
        if len(trees):
            at = np.zeros((len(rows), len(trees)), dtype=np.int64)
            line = np.arange(len(rows))[:, None]
            for _ in range(int(math.log2(self.leaf.shape[1]))):
                at = 2 * at + 1 + (rows[line, self.feature[trees, at]] > self.cut[trees, at])
            total = total + self.leaf[trees, at - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Boost trees on the logistic loss. Without rows, or with one label only, the score is a constant."""
    nodes, leaves = 2**DEPTH - 1, 2**DEPTH
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    start = math.log(share / (1 - share))
    empty = Trees(np.zeros((0, nodes), dtype=np.int64), np.zeros((0, nodes)), np.zeros((0, leaves)), start)
    if len(np.unique(labels)) < 2:
        return empty
    n, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], axis=1)
    place = binned + np.arange(width) * BINS
    margin = np.full(n, start)
    features, cuts, values = [], [], []
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-margin))
        slope, bend = chance - labels, chance * (1 - chance)
        at = np.zeros(n, dtype=np.int64)
        feature, cut_bin, cut = np.zeros(nodes, dtype=np.int64), np.full(nodes, BINS), np.full(nodes, np.inf)
        for depth in range(DEPTH):
            first, count = 2**depth - 1, 2**depth
            cell = ((at - first)[:, None] * (width * BINS) + place).ravel()
            sums = [
                np.bincount(cell, np.repeat(w, width), count * width * BINS).reshape(count, width, BINS)
                for w in (slope, bend, np.ones(n))
            ]
            (gl, hl, cl), (g, h, c) = ([np.cumsum(s, axis=2) for s in sums], [s[:, :1].sum(axis=2, keepdims=True) for s in sums])
            gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
            gain[(cl < LEAST) | (c - cl < LEAST)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], cut_bin[first + k], cut[first + k] = f, b, edges[f][b]
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > cut_bin[at])
        leaf = at - nodes
        value = -RATE * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, bend, leaves) + RIDGE)
        margin = margin + value[leaf]
        features.append(feature), cuts.append(cut), values.append(value)
    return Trees(np.array(features), np.array(cuts), np.array(values), start)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", most: int = TRAIN_ROWS) -> Trees:
    """Fit on the labelled documents that aren't held out; of more than ``most`` rows, on a share of about that many.

    The share is taken by the hash of id and text, before documents and labels are joined, and equal rows are one; so the bound
    holds for rows that repeat an id, too. Rows with a null id, label or both are passed over; a null text counts as empty.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(F.col(id_column)))
    known = shared.settle(known.select(F.col(id_column).alias("__id"), F.col("quality").cast("double").alias("__label")).distinct(), "labels")
    rows = docs.select(F.col(id_column).alias("__id")).join(known, "__id").count()
    share = min(1.0, most / max(1, rows))
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(id_column).alias("__id"), body.alias("__body"), F.xxhash64(id_column, body).alias("__hash"))
    picked = own.where(F.pmod("__hash", F.lit(1 << 40)) < int(share * (1 << 40))).join(known, "__id")
    chosen = picked.groupBy("__id", "__hash", "__label").agg(F.first("__body").alias("__body"))
    found = texts.per_text(chosen, _features, "features array<double>", "__id", "__label", text="__body").toPandas()
    found = found.assign(f=found["features"].map(tuple)).sort_values(["__id", "__label", "f"])
    rows = np.array(found["features"].tolist(), dtype=np.float64).reshape(len(found), len(FEATURES))
    return fit(rows, found["__label"].to_numpy(dtype=np.float64))


def _features():
    return lambda batch: {"features": pa.array([statistics(t) for t in batch], pa.list_(pa.float64()))}


def _scores(trees: Trees, batch: list[str]) -> np.ndarray:
    return trees.score(np.array([statistics(t) for t in batch], dtype=np.float64).reshape(len(batch), len(FEATURES)))


def score(docs: DataFrame, trees: Trees, *keep: str, text: str = "text") -> DataFrame:
    """``score`` (0 to 1, higher: label 1 is likelier) of every text beside the columns in ``keep``.

    Null and empty texts have a score too. Rows don't depend on each other; other columns aren't read.
    """
    return texts.per_text(docs, lambda: lambda batch: {"score": _scores(trees, batch)}, "score double", *keep, text=text)


def accepted(docs: DataFrame, trees: Trees, text: str = "text", least: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``least``."""
    return texts.filter_texts(docs, lambda: lambda batch: _scores(trees, batch) >= least, text)
