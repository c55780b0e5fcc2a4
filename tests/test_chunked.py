"""Chunked per-key work must equal the plain window, also when one key owns a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cyclewise.operators import chunked, windows


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    units = [0] * 400 + [rng.randrange(1, 60) for _ in range(800)]
    rng.shuffle(units)
    rows = [(i, u, rng.randrange(0, 500)) for i, u in enumerate(units)]
    return spark.createDataFrame(rows, "arrival long, unit long, cycle long").repartition(6).cache()


def collect(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("hot_rows", [0, 50, 10_000])
@pytest.mark.parametrize("span", [1, 37, 5000])
def test_ordinal(skewed, hot_rows, span):
    plain = skewed.withColumn("n", F.row_number().over(W.partitionBy("unit").orderBy("arrival")))
    chunk = F.floor(F.col("arrival") / span)
    got = chunked.with_ordinal(skewed, ["unit"], [F.col("arrival")], chunk, "n", hot_rows)
    assert collect(got, "arrival", "n") == collect(plain, "arrival", "n")


@pytest.mark.parametrize("hot_rows", [0, 50])
def test_late_drop(skewed, hot_rows):
    seen, kept = {}, []
    for arrival, unit, cycle in sorted(tuple(r) for r in skewed.collect()):
        if unit not in seen or cycle > seen[unit]:
            seen[unit] = cycle
            kept.append((arrival,))
    got = windows.drop_late(skewed, arrivals_per_chunk=40, hot_rows=hot_rows)
    assert collect(got, "arrival") == kept


@pytest.mark.parametrize("hot_rows", [0, 50])
def test_previous(skewed, hot_rows):
    plain = skewed.withColumn("p", F.lag("cycle").over(W.partitionBy("unit").orderBy("arrival")))
    got = chunked.with_previous(
        skewed, ["unit"], ["arrival"], F.floor(F.col("arrival") / 40), "cycle", "p", hot_rows
    )
    wrong = got.join(plain.select("arrival", F.col("p").alias("q")), "arrival").where(~F.col("p").eqNullSafe(F.col("q")))
    assert got.count() == 1200 and wrong.count() == 0


def test_global_ordinal(skewed):
    got = chunked.with_global_ordinal(skewed, [F.col("arrival")], F.floor(F.col("arrival") / 100), "n")
    assert collect(got, "arrival", "n") == [(i, i + 1) for i in range(1200)]


def test_latest_and_last_n(skewed):
    rows = [tuple(r) for r in skewed.collect()]
    last = {u: max(r for r in rows if r[1] == u) for _, u, _ in rows}
    assert collect(chunked.latest_per_key(skewed, ["unit"], ["arrival"]), "arrival", "unit", "cycle") == sorted(last.values())
    got = chunked.last_n_per_key(skewed, ["unit"], [F.desc("arrival")], 7)
    want = [r for u in last for r in sorted((r for r in rows if r[1] == u), reverse=True)[:7]]
    assert collect(got, "arrival", "unit", "cycle") == sorted(want)


def test_last_n_is_cut_before_the_shuffle(skewed):
    plan = chunked.last_n_per_key(skewed, ["unit"], [F.desc("arrival")], 7)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.index("Final") < physical.index("Exchange") < physical.index("Partial")


@pytest.mark.parametrize("numbered", [True, False])
@pytest.mark.parametrize("chunk_rows", [5, 6, 23, 10_000])
def test_windows_over_chunk_borders(spark, numbered, chunk_rows):
    """Gaps in the cycles; units of many sizes; one unit far longer than a chunk."""
    rows, want = [], []
    for unit, n in enumerate([0, 1, 4, 5, 6, 23, 24, 211]):
        cycles = [1 + 3 * i for i in range(n)]
        for i, c in enumerate(cycles):
            rows.append((unit, c, i + 1, float(c), n - i))
            if i >= 4:
                want.append((unit, c, [[float(x)] for x in cycles[i - 4 : i + 1]], n - i))
    df = spark.createDataFrame(rows, "unit int, cycle int, i int, s2 double, RUL int").repartition(5)
    got = windows.sliding_windows(df, ["s2"], 5, ordinal="i" if numbered else None, chunk_rows=chunk_rows)
    assert collect(got, "unit", "cycle", "features", "label") == sorted(want)
