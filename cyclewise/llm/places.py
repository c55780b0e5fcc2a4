"""Places of rows in the order of their group, however large a group is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclewise import shared


def key_of(column: Column) -> Column:
    """A string that is never null: strings keep the order of their bytes, null comes first and apart from the empty string."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def numbered(rows: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """``place`` (from 0) and ``size`` (rows of the group) of every row, along ``order`` inside ``group``, which has no nulls.

    The rows are sorted as a whole, so that a large group lies in several partitions; a row's place is that in its partition
    and what the partitions before hold of its group. Kept in the shared folder under ``name``.
    """
    ordered = rows.orderBy(group, *order).withColumn("at", F.monotonically_increasing_id())
    ordered = shared.settle(ordered.withColumn("slice", F.shiftright("at", 33)), f"{name}-sorted")
    counts = ordered.groupBy(group, "slice").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    whole = Window.partitionBy(group)
    before = F.sum("rows").over(whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(group, "slice", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("size"))
    placed = ordered.join(shared.settle(offsets, f"{name}-offsets"), [group, "slice"])
    return placed.withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("at", "slice", "first", "before")
