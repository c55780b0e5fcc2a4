"""Per-engine windows over cycles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from cyclewise import config
from cyclewise.operators import chunked, transform


def sensor_row(sensors: Sequence[str]) -> Column:
    return F.array(*[F.col(s).cast("float") for s in sensors])


def _in_chunks(
    df: DataFrame,
    columns: Sequence[str],
    size: int,
    unit: str,
    cycle: str,
    ordinal: str | None,
    chunk_rows: int | None,
) -> tuple[DataFrame, WindowSpec]:
    """Rows spread over tasks so that each task can build windows of ``size`` rows, and the frame to use.

    ``ordinal`` names a column that numbers the rows of a unit 1, 2, ...; without it the rows are numbered
    first. A unit with more than ``chunk_rows`` rows is worked on in several tasks: each chunk also gets
    the last ``size - 1`` rows of the chunk before it. Only rows with ``_own`` are a chunk's own.
    """
    chunk_rows = max(config.CHUNK_ROWS if chunk_rows is None else chunk_rows, size)
    rows = df.select(*dict.fromkeys([unit, cycle, *columns, *([ordinal] if ordinal else [])]))
    if ordinal is None:
        ordinal = "_ordinal"
        rows = chunked.with_ordinal(rows, [unit], [F.col(cycle)], F.floor(F.col(cycle) / chunk_rows), ordinal)
    place = F.col(ordinal) - 1
    home = F.floor(place / chunk_rows)
    is_halo_of_next = place % chunk_rows >= chunk_rows - (size - 1)
    spread = (
        rows.withColumn("_home", home)
        .withColumn("_task", F.explode(F.when(is_halo_of_next, F.array(home, home + 1)).otherwise(F.array(home))))
        .withColumn("_own", F.col("_home") == F.col("_task"))
    )
    return spread, W.partitionBy(unit, "_task").orderBy(ordinal).rowsBetween(-(size - 1), 0)


def rolling_arrays(
    df: DataFrame,
    reading: str,
    size: int = config.WINDOW_SIZE,
    unit: str = "unit",
    cycle: str = "cycle",
    carry: Sequence[str] = (),
    ordinal: str | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Every full window of ``size`` consecutive rows of a unit: ``(unit, cycle, *carry, features)``."""
    rows, frame = _in_chunks(df, [reading, *carry], size, unit, cycle, ordinal, chunk_rows)
    return (
        rows.withColumn("features", F.collect_list(reading).over(frame))
        .where(F.col("_own") & (F.size("features") == size))
        .select(unit, cycle, *carry, "features")
    )


def window_features(
    df: DataFrame,
    sensors: Sequence[str] = config.SENSORS,
    size: int = config.WINDOW_SIZE,
    unit: str = "unit",
    cycle: str = "cycle",
    label: str = "RUL",
    ordinal: str | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Last value, mean, deviation and slope of each sensor over each full window.

    Four numbers per sensor and window instead of ``size``; the windows themselves are never written out. Spark deals and sorts the
    rows; a worker makes the numbers of all windows of a batch at once. A frame of Spark's takes each row ``size`` times, one by one.
    """
    rows, _ = _in_chunks(df, [*sensors, label], size, unit, cycle, ordinal, chunk_rows)
    place = ordinal or "_ordinal"
    names = [f"{s}_{stat}" for s in sensors for stat in ("last", "mean", "std", "slope")]
    kept = rows.select(unit, cycle, F.col(label).alias("label")).schema.fields
    schema = T.StructType([*kept[:2], *[T.StructField(n, T.DoubleType()) for n in names], kept[2]])
    readings = [F.col(s).cast("double").alias(f"_x{i}") for i, s in enumerate(sensors)]
    carried = [F.col(c).alias(f"_c{i}") for i, c in enumerate((unit, cycle, label))]
    # Sorted in Spark, so that a worker goes through a chunk's rows as they come and holds one batch and a window of them.
    sorted_rows = rows.repartition(unit, "_task").sortWithinPartitions(unit, "_task", place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            (units, cycles, labels, own, at), found = batch.columns[:5], batch.columns[5:]
            columns = [np.asarray(at, dtype="i8")]
            for x in found:
                columns += [x.to_numpy(zero_copy_only=False).astype("f8"), np.asarray(x.is_valid())]
            if before is not None:
                columns = [np.concatenate(pair) for pair in zip(before, columns)]
            before = [c[max(0, len(c) - size + 1) :] for c in columns]
            places, n = columns[0], max(0, len(columns[0]) - size + 1)
            # Within a chunk places follow one another; where they don't, another chunk begins.
            chunk = np.cumsum(np.diff(places, prepend=places[:1]) != 1)
            ready = np.zeros(batch.num_rows, dtype=bool)
            ready[batch.num_rows - n :] = chunk[size - 1 :] == chunk[:n]
            ready &= np.asarray(own)
            taken = ready[batch.num_rows - n :]
            told = pa.array(ready)
            stats = []
            for i, x in enumerate(found):
                values, valid = columns[1 + 2 * i : 3 + 2 * i]
                stats += [x.filter(told), *_moments(values, valid, places.astype("f8"), size, taken)]
            yield pa.RecordBatch.from_arrays([units.filter(told), cycles.filter(told), *stats, labels.filter(told)], names=schema.names)

    return sorted_rows.select(*carried, "_own", F.col(place).cast("long").alias("_place"), *readings).mapInArrow(run, schema)


def _moments(x: np.ndarray, valid: np.ndarray, places: np.ndarray, size: int, taken: np.ndarray) -> list[pa.Array]:
    """Mean, deviation and slope of the windows in ``taken``, one for each row from the ``size``-th on. Rows are added one after
    the other, all windows at once, by the steps of Spark's own ``avg``, ``stddev_pop`` and ``covar_pop``; nulls are passed over."""
    n = len(x) - size + 1
    count, spotless = 0.0, bool(valid.all())
    total = mean = squares = y_mean = products = np.zeros(max(0, n))
    for j in range(size if n > 0 else 0):
        value, y, here = x[j : j + n], places[j : j + n], valid[j : j + n]
        more = count + 1.0
        delta = value - mean
        step = delta / more
        new_y = y_mean + (y - y_mean) / more
        new = (more, total + value, mean + step, squares + delta * (delta - step), new_y, products + delta * (y - new_y))
        old = (count, total, mean, squares, y_mean, products)
        count, total, mean, squares, y_mean, products = new if spotless else (np.where(here, a, b) for a, b in zip(new, old))
    none = np.broadcast_to(count == 0, total.shape)[taken]
    some = np.maximum(count, 1.0)
    spread = (size * size - 1) / 12.0 if size > 1 else 1.0
    # The positions in a full window are consecutive, so their variance is known.
    return [pa.array(s[taken], mask=none) for s in (total / some, np.sqrt(squares / some), products / some / spread)]


def sliding_windows(
    df: DataFrame,
    sensors: Sequence[str] = config.SENSORS,
    size: int = config.WINDOW_SIZE,
    unit: str = "unit",
    cycle: str = "cycle",
    label: str = "RUL",
    ordinal: str | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Windows of the sensor columns with the last row's label: ``(unit, cycle, features, label)``."""
    rows = df.withColumn("_x", sensor_row(sensors))
    found = rolling_arrays(rows, "_x", size, unit, cycle, [label], ordinal, chunk_rows)
    return found.select(unit, cycle, "features", F.col(label).alias("label"))


def array_features(df: DataFrame, sensors: Sequence[str], size: int, window: str = "features") -> DataFrame:
    """The same numbers as ``window_features``, from windows that are there as arrays."""
    spread = (size * size - 1) / 12.0 if size > 1 else 1.0

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def numbers(name: str, index: int) -> dict[str, Column]:
        xs = F.transform(window, lambda row: row[index].cast("double"))
        mean = total(xs) / size
        squares = F.transform(xs, lambda x: (x - mean) * (x - mean))
        moved = F.transform(xs, lambda x, j: x * (j - (size - 1) / 2.0))
        return {
            f"{name}_last": F.element_at(xs, -1),
            f"{name}_mean": mean,
            f"{name}_std": F.sqrt(total(squares) / size),
            f"{name}_slope": total(moved) / size / spread,
        }

    stats = {}
    for i, s in enumerate(sensors):
        stats.update(numbers(s, i))
    return df.withColumns(stats).drop(window)


def last_windows(
    df: DataFrame,
    sensors: Sequence[str] = config.SENSORS,
    size: int = config.WINDOW_SIZE,
    unit: str = "unit",
    cycle: str = "cycle",
    label: str = "RUL",
) -> DataFrame:
    """One window per unit from its last rows; a short unit is padded with zero rows in front."""
    kept = chunked.last_n_per_key(
        df.select(unit, cycle, sensor_row(sensors).alias("_x"), label), [unit], [F.desc(cycle)], size
    )
    zeros = F.array(*[F.lit(0.0).cast("float") for _ in sensors])
    rows = F.transform(F.sort_array(F.collect_list(F.struct(cycle, "_x"))), lambda r: r["_x"])
    return (
        kept.groupBy(unit)
        .agg(F.max(cycle).alias(cycle), rows.alias("_rows"), F.max_by(label, cycle).alias("label"))
        .select(
            unit,
            cycle,
            F.concat(F.array_repeat(zeros, F.lit(size) - F.size("_rows")), F.col("_rows")).alias("features"),
            "label",
        )
    )


def drop_late(
    df: DataFrame,
    unit: str = "unit",
    cycle: str = "cycle",
    arrival: str = "arrival",
    arrivals_per_chunk: int = 1_000_000,
    hot_rows: int | None = None,
) -> DataFrame:
    """Keep a row only when its cycle is above every cycle of the unit that arrived earlier."""
    seen = chunked.with_running_max(
        df, [unit], [F.col(arrival)], F.floor(F.col(arrival) / arrivals_per_chunk), cycle, "_seen", hot_rows
    )
    return seen.where(F.col("_seen").isNull() | (F.col(cycle) > F.col("_seen"))).drop("_seen")


def push_buffer(
    df: DataFrame, reading: Sequence[str], size: int = config.WINDOW_SIZE, unit: str = "unit", arrival: str = "arrival"
) -> DataFrame:
    """The last ``size`` readings of each engine, oldest first, with the buffer size."""
    kept = chunked.last_n_per_key(df.select(unit, arrival, *reading), [unit], [F.desc(arrival)], size)
    return kept.groupBy(unit).agg(
        F.count(F.lit(1)).cast("int").alias("buffer_size"),
        F.sort_array(F.collect_list(F.struct(arrival, *reading))).alias("readings"),
    )


def full_buffers(buffers: DataFrame, size: int = config.WINDOW_SIZE) -> DataFrame:
    return buffers.where(F.col("buffer_size") == size)


def lifecycle_stage(
    df: DataFrame, unit: str = "unit", cycle: str = "cycle", life: DataFrame | None = None
) -> DataFrame:
    """Fraction of the unit's life at each row and its stage; the last stage is closed on the right."""
    fraction = F.col(cycle) / F.col("life")
    stage = None
    for name, upper in config.LIFECYCLE_STAGES[:-1]:
        stage = F.when(fraction < upper, name) if stage is None else stage.when(fraction < upper, name)
    stage = stage.otherwise(config.LIFECYCLE_STAGES[-1][0])
    rows = transform.with_life(df, unit, cycle, life)
    return rows.withColumns({"life_fraction": fraction, "stage": stage}).drop("life")
