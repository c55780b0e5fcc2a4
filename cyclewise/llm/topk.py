"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Rows are dealt to the nearest of a bounded number of rows, so that each holds a ball; crowded balls are split into shards by hash. In
a worker, a shard's rows arrive first and become a ball tree; the queries that follow visit its nodes by falling upper bound
(centre's product plus radius times the query's length) and stop when no node can reach the k-th score. A query first searches
the ball in which it may score highest; the score of its k-th row there goes with it to the other shards, and it isn't sent to those
whose ball can't reach it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclewise import shared

SHARD_ROWS = 8192
LEAF_ROWS = 64
QUERY_BATCH = 512
# Rows that others are dealt to by nearness; the driver and the workers hold them.
MOST_PIVOTS = 1 << 10
LARGEST = 1 << 63


class BallTree:
    """Integer vectors in nested balls."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS):
        self.ids, self.rows = ids, rows
        self.order = np.arange(len(ids))
        self.children, centres, radii, self.spans = [], [], [], []
        plain = rows.astype(np.float64)
        pending = [(0, len(ids), None)]
        while pending:
            low, high, parent = pending.pop()
            node, inside = len(self.spans), self.order[low:high]
            points = plain[inside]
            centre = points.mean(axis=0)
            centres.append(centre)
            radii.append(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))
            self.spans.append((low, high))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            if high - low > leaf and radii[-1] > 0:
                along, cut = self._parted(points, centre)
                self.order[low:high] = inside[np.argpartition(along, cut)]
                pending += [(low, low + cut, node), (low + cut, high, node)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    @staticmethod
    def _parted(points: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, int]:
        """Where each point lies between two that are far apart, and how many are nearer to the first.

        Points that form groups part between them; where one side would have nearly all, they part in halves.
        """
        first = points[((points - centre) ** 2).sum(axis=1).argmax()]
        second = points[((points - first) ** 2).sum(axis=1).argmax()]
        along = points @ (second - first)
        nearer = int((along < (first + second) @ (second - first) / 2).sum())
        return along, nearer if len(points) <= 16 * min(nearer, len(points) - nearer) else len(points) // 2

    def search(self, query: np.ndarray, k: int, own: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) apart from ``own``, ties to the smaller id; those below ``floor`` may be missing."""
        plain = query.astype(np.float64)
        reach = np.sqrt((plain**2).sum()) * self.radii
        bounds = self.centres @ plain + reach
        bounds += 1e-9 * (np.abs(bounds) + 2 * reach) + 1e-6  # more than rounding can take away
        best: list[tuple[int, int]] = []
        least = -np.inf if floor is None else floor
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= least:
            node = heapq.heappop(heap)[1]
            for child in self.children[node]:
                if bounds[child] >= least:
                    heapq.heappush(heap, (-bounds[child], child))
            if not self.children[node]:
                low, high = self.spans[node]
                inside = self.order[low:high]
                scores = self.rows[inside] @ query
                for i in np.flatnonzero((scores >= least) & (self.ids[inside] != own)):
                    best.append((int(scores[i]), int(self.ids[inside[i]])))
                best = heapq.nsmallest(k, best, key=lambda b: (-b[0], b[1]))
                if len(best) == k:
                    least = max(least, best[-1][0])
        return best


def whole_numbers(lists: list[np.ndarray], width: int) -> np.ndarray:
    """floor(1024 x) as rows; shorter vectors are filled up with zeros. Products of the rows are exact."""
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = np.floor(1024 * np.asarray(x, dtype=np.float64))
    if not out.size or np.abs(out).max() ** 2 * width < 1 << 53:
        return out
    return np.array([[int(x) for x in row] for row in out], dtype=object).reshape(out.shape)


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def _searched(rows: DataFrame, asked: DataFrame, k: int, shards: int, width: int) -> DataFrame:
    """Hits of the queries in the shards they are sent to."""
    tagged = rows.select("shard", F.lit(0).alias("asks"), "id", "vector", F.lit(None).cast("bigint").alias("floor"))
    tagged = tagged.unionByName(asked.select("shard", F.lit(1).alias("asks"), "id", "vector", "floor"))
    dealt = tagged.repartition(shards, "shard").sortWithinPartitions("shard", "asks", "id")

    def run(batches):
        tree, current, ids, vectors, ended = None, None, [], [], False
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for batch in batches:
            for shard, asks, vec_id, vector, floor in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != current:
                    tree, current, ids, vectors = None, shard, [], []
                if not asks:
                    ids.append(vec_id)
                    vectors.append(np.array(vector))
                    continue
                if tree is None and ids:
                    tree = BallTree(np.array(ids, dtype=np.int64), whole_numbers(vectors, width))
                    vectors = []
                query = whole_numbers([np.array(vector)], width)[0]
                if tree is not None and tree.rows.dtype != query.dtype:
                    tree.rows, query = tree.rows.astype(object), np.array([int(x) for x in query], dtype=object)
                    tree.rows = np.array([[int(x) for x in r] for r in tree.rows], dtype=object).reshape(tree.rows.shape)
                for score, hit in tree.search(query, k, vec_id, floor) if tree is not None else ():
                    found["query_id"].append(vec_id)
                    found["vec_id"].append(hit)
                    found["score"].append(max(-LARGEST, min(LARGEST - 1, score)))
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in found.items()})
            found = {n: [] for n in found}

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(QUERY_BATCH))
    return dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


class Pivots:
    """Rows that the others are dealt to by nearness, and the ball around each that holds what was dealt to it."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows.astype(np.float64)
        self.squares = (self.rows**2).sum(axis=1)
        self.radii, self.parts = np.zeros(len(rows)), np.ones(len(rows), dtype=np.int64)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and distance of the nearest pivot of each vector."""
        plain = vectors.astype(np.float64)
        number = (self.squares - 2 * (plain @ self.rows.T)).argmin(axis=1)
        return number, np.sqrt(((plain - self.rows[number]) ** 2).sum(axis=1))

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The most that a row of each pivot's ball can score; infinite where numbers are too large to tell."""
        plain = query.astype(np.float64)
        reach = np.sqrt((plain**2).sum()) * self.radii
        out = self.rows @ plain + reach
        out += 1e-9 * (np.abs(out) + 2 * reach) + 1e-6
        return np.where(np.isnan(out), np.inf, out)


def _dealt(rows: DataFrame, pivots: Pivots, width: int) -> DataFrame:
    """``rows`` (id, vector) with the number of the nearest pivot and the distance from it."""

    def run(batches):
        for batch in batches:
            lists = [np.array(v) for v in batch.column(1).to_pylist()]
            number, distance = pivots.nearest(whole_numbers(lists, width))
            columns = [batch.column(0), batch.column(1), pa.array(number, pa.int32()), pa.array(np.nan_to_num(distance, nan=np.inf), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "pivot", "distance"])

    return rows.select("id", "vector").mapInArrow(run, "id bigint, vector array<double>, pivot int, distance double")


def _sent(asking: DataFrame, pivots: Pivots, width: int, first: bool) -> DataFrame:
    """The queries with the shards that they are sent to: those of the ball where they score highest if ``first``, else those of
    all others that can reach their ``floor``."""
    starts = np.cumsum([0, *pivots.parts])

    def run(batches):
        for batch in batches:
            out = {"id": [], "vector": [], "floor": [], "shard": []}
            for vec_id, vector, floor in zip(*(c.to_pylist() for c in batch.columns)):
                query = whole_numbers([np.array(vector)], width)[0]
                bounds = pivots.bounds(query)
                home = int(bounds.argmax())
                wanted = [home] if first else [p for p in np.flatnonzero(bounds >= (-np.inf if floor is None else floor)).tolist() if p != home]
                for shard in (x for p in wanted for x in range(starts[p], starts[p + 1])):
                    for name, value in zip(out, (vec_id, vector, floor, shard)):
                        out[name].append(value)
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return asking.select("id", "vector", "floor").mapInArrow(run, "id bigint, vector array<double>, floor bigint, shard int")


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k rows of highest integer product for each query.

    ``queries`` says which rows ask; every row but those with the query's id answers. Components become floor(1024 x); ties go
    to the smaller id; with fewer rows all are returned. Vectors that are null or hold a null, a NaN or an infinity take no
    part, nor do rows without an id. Vectors may differ in length (missing components are 0). Of rows that repeat an id
    all answer, and the smallest vector asks. Scores beyond 64 bits are cut to the largest number there is.
    """
    usable = vectors.where(F.col(id_column).isNotNull() & _usable(F.col(vector)))
    counted = usable.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).head()
    width = max(1, counted.width or 0)
    rows = usable.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    none = F.lit(None).cast("bigint")
    asking = usable.where(queries).groupBy(F.col(id_column).alias("id")).agg(F.min(F.col(vector).cast("array<double>")).alias("vector"))
    asking = shared.settle(asking.withColumn("floor", none), "queries")
    few = min(MOST_PIVOTS, max(1, -(-counted.n // SHARD_ROWS)))
    picked = rows.orderBy(F.xxhash64("id"), "vector").limit(few).collect()
    pivots = Pivots(whole_numbers([np.array(r.vector) for r in picked] or [np.zeros(width)], width))
    near = shared.settle(_dealt(rows, pivots, width), "dealt-vectors")
    for r in near.groupBy("pivot").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect():
        pivots.radii[r.pivot], pivots.parts[r.pivot] = r.radius, -(-r.n // SHARD_ROWS)
    # A crowded ball is split by hash, so that no shard holds many more rows than others.
    starts, parts = (F.get(F.lit([int(x) for x in xs]), F.col("pivot")) for xs in (np.cumsum([0, *pivots.parts])[:-1], pivots.parts))
    dealt = near.select("id", "vector", (starts + F.pmod(F.xxhash64("id", "vector"), parts)).cast("int").alias("shard"))
    shards = int(pivots.parts.sum())
    hits = shared.settle(_searched(dealt, _sent(asking, pivots, width, True), k, shards, width), "home-hits")
    if len(pivots.rows) > 1:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        floors = hits.withColumn("place", place).where(F.col("place") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        others = shared.settle(_sent(asking.drop("floor").join(floors, "id", "left"), pivots, width, False), "sent-queries")
        hits = hits.union(_searched(dealt, others, k, shards, width))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
