"""Ordered per-key work that does not put one key's whole history into one task.

A key may own a large share of all rows (one engine, one sensor). A plain window over that key would
run on a single task. Here an ordered key is cut into chunks along its order; each chunk is summarised
(with map-side combine), the summaries, of which there is one row per chunk, are accumulated along the
key, and the accumulated value is joined back to the rows of the chunk. The result is exact for every
choice of chunk expression that grows with the order; the choice only decides how even the tasks are.

Rows are counted per key first. Where no key is hot, a plain window does the work: one read and one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cyclewise import config, shared

CHUNK = "_chunk"
SLICES = 1024


def cut_points(column: str, slices: int = SLICES) -> Column:
    """Aggregate: ``slices - 1`` ascending values that cut a column into about equal parts (a mergeable sketch)."""
    return F.percentile_approx(column, [i / slices for i in range(1, slices)], 10 * slices)


def slice_of(x: Column, cuts: Column, slices: int = SLICES) -> Column:
    """Number of cut points below ``x``, found by halving; ``slices`` is a power of two."""
    steps = F.array(*[F.lit(slices >> i) for i in range(1, slices.bit_length())])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.element_at(cuts, at + step) < x, at + step).otherwise(at)
    )


def key_counts(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(key..., _n)``, kept in the shared folder: one read of the key columns, with map-side combine."""
    return shared.settle(df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), "key-counts")


def hot_keys(df: DataFrame, key: Sequence[str], hot_rows: int | None = None, counts: DataFrame | None = None) -> DataFrame | None:
    """The keys with more than ``hot_rows`` rows (null is a key like others), or None when there are none.

    ``counts`` may be given where they are known; else the rows are counted when this is called.
    """
    counts = key_counts(df, key) if counts is None else counts
    hot = shared.settle(counts.where(F.col("_n") > (config.HOT_ROWS if hot_rows is None else hot_rows)).select(*key), "hot-keys")
    return None if hot.isEmpty() else hot


def _same(left: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in left]


def assign_chunk(df: DataFrame, key: Sequence[str], chunk: Column, hot: DataFrame) -> DataFrame:
    """Add the chunk number to the rows of the hot keys; null for the other keys.

    The list of hot keys is read from the shared folder, so that its true size decides how it is joined.
    """
    marked = hot.select(*[F.col(c).alias(f"_hot_{c}") for c in key], F.lit(True).alias("_hot"))
    return (
        df.join(marked, _same(key, "_hot_"), "left")
        .withColumn(CHUNK, F.when(F.col("_hot"), chunk))
        .drop("_hot", *[f"_hot_{c}" for c in key])
    )


def _chunk_summary(rows: DataFrame, key: Sequence[str], summary: Column) -> DataFrame:
    """One row per chunk of a hot key; a key that is not hot is one task's work and needs no summary."""
    return rows.where(F.col(CHUNK).isNotNull()).groupBy(*key, CHUNK).agg(summary.alias("_part"))


def _join_summary(df: DataFrame, summary: DataFrame, key: Sequence[str]) -> DataFrame:
    """Bring ``_before`` to the rows; the shuffle on key and chunk, if any, also serves the window that follows."""
    renamed = summary.select(*[F.col(c).alias(f"_k_{c}") for c in (*key, CHUNK)], "_before")
    return df.join(renamed, _same((*key, CHUNK), "_k_"), "left").drop(*[f"_k_{c}" for c in (*key, CHUNK)])


def with_ordinal(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    name: str,
    hot_rows: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of each key 1, 2, ... along ``order``."""
    hot = hot_keys(df, key, hot_rows, counts)
    if hot is None:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*order)).cast("long"))
    rows = assign_chunk(df, key, chunk, hot)
    earlier = W.partitionBy(*key).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    counts = _chunk_summary(rows, key, F.count(F.lit(1)))
    offsets = counts.withColumn("_before", F.sum("_part").over(earlier))
    inside = W.partitionBy(*key, CHUNK).orderBy(*order)
    number = F.coalesce("_before", F.lit(0)) + F.row_number().over(inside)
    return _join_summary(rows, offsets, key).withColumn(name, number.cast("long")).drop("_before", CHUNK)


def with_running_max(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    value: str,
    name: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add the largest ``value`` among all strictly earlier rows of the key (null for the first)."""
    hot = hot_keys(df, key, hot_rows)
    if hot is None:
        before = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn(name, F.max(value).over(before))
    rows = assign_chunk(df, key, chunk, hot)
    earlier = W.partitionBy(*key).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    peaks = _chunk_summary(rows, key, F.max(value)).withColumn("_before", F.max("_part").over(earlier))
    inside = W.partitionBy(*key, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    highest = F.greatest(F.col("_before"), F.max(value).over(inside))
    return _join_summary(rows, peaks, key).withColumn(name, highest).drop("_before", CHUNK)


def with_previous(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: str,
    name: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add ``value`` of the row just before along ``order`` (null for the first row of the key)."""
    hot = hot_keys(df, key, hot_rows)
    if hot is None:
        return df.withColumn(name, F.lag(value).over(W.partitionBy(*key).orderBy(*order)))
    rows = assign_chunk(df, key, chunk, hot)
    by_chunk = W.partitionBy(*key).orderBy(CHUNK)
    last = _chunk_summary(rows, key, F.max_by(value, F.struct(*order)))
    last = last.withColumn("_before", F.lag("_part").over(by_chunk))
    inside = W.partitionBy(*key, CHUNK).orderBy(*order)
    return (
        _join_summary(rows, last, key)
        .withColumn("_row", F.row_number().over(inside))
        .withColumn(name, F.when(F.col("_row") == 1, F.col("_before")).otherwise(F.lag(value).over(inside)))
        .drop("_before", "_row", CHUNK)
    )


def with_global_ordinal(df: DataFrame, order: Sequence[Column], bucket: Column, name: str) -> DataFrame:
    """Number all rows 1, 2, ... along ``order``; ``bucket`` grows with the order and has few values, null first."""
    rows = df.withColumn(CHUNK, bucket)
    earlier = W.orderBy(F.asc_nulls_first(CHUNK)).rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_part"))
    offsets = counts.withColumn("_before", F.sum("_part").over(earlier))
    number = F.coalesce("_before", F.lit(0)) + F.row_number().over(W.partitionBy(CHUNK).orderBy(*order))
    return _join_summary(rows, offsets, []).withColumn(name, number.cast("long")).drop("_before", CHUNK)


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key along ``order``: an aggregate, combined on the map side, so that a hot key shuffles one row a task.

    Spark groups rows for it by sorting each task's share, as what it keeps for a key is a whole row.
    """
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*key, *[F.col("_row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def last_n_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key along ``order``.

    The rank filter is applied on the map side too, so a hot key shuffles at most ``n`` rows per task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")
