"""Batch core: columns, labels, scaler fit and use, truth attachment, group split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewise import config, shared
from cyclewise.functions import scalars as S
from cyclewise.operators import chunked


def drop_columns(df: DataFrame, columns: Sequence[str] = config.DROPPED_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def sensor_columns(df: DataFrame, prefix: str = "s") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def column_coverage(reference: Sequence[str], current: Sequence[str]) -> tuple[list[str], list[str]]:
    """Wanted columns that are present, and those that are missing; none present is an error."""
    available = [c for c in reference if c in current]
    if not available:
        raise ValueError("no wanted sensor column is present")
    return available, [c for c in reference if c not in current]


def unit_life(df: DataFrame, unit: str = "unit", cycle: str = "cycle") -> DataFrame:
    return df.groupBy(unit).agg(F.max(cycle).alias("life"))


def add_rul(
    df: DataFrame,
    clip: int = config.RUL_CLIP,
    unit: str = "unit",
    cycle: str = "cycle",
    life: DataFrame | None = None,
) -> DataFrame:
    """Remaining cycles to the last cycle of the unit, clipped.

    ``life`` (unit, life) may be given where it is known; else it is aggregated, with map-side combine.
    """
    rows = with_life(df, unit, cycle, life)
    return rows.withColumn("RUL", F.least(F.col("life") - F.col(cycle), F.lit(clip))).drop("life")


def with_life(df: DataFrame, unit: str, cycle: str, life: DataFrame | None = None) -> DataFrame:
    """Join each unit's life; rows without a unit count as one unit. The lives are computed when this is called."""
    lives = unit_life(df, unit, cycle) if life is None else life
    lives = shared.settle(lives.select(F.col(unit).alias("_unit"), "life"), "life")
    return df.join(lives, F.col(unit).eqNullSafe(F.col("_unit"))).drop("_unit")


def truth_by_position(units: DataFrame, truth: DataFrame, distinct: bool = False) -> DataFrame:
    """Pair the i-th unit (sorted) with the i-th truth line; raises when their counts differ.

    ``units`` has an integer column ``unit`` (repeats allowed unless ``distinct``: a small table of one row each, as
    ``chunked.key_counts`` keeps it), ``truth`` has ``pos`` (1, 2, ...) and ``rul``.
    """
    distinct = units.select("unit") if distinct else shared.settle(units.select("unit").distinct(), "units")
    cuts = distinct.agg(chunked.cut_points("unit").alias("c")).scalar()
    sliced = distinct.withColumn("_cuts", cuts)
    place = chunked.slice_of(F.col("unit"), F.col("_cuts"))
    ranked = chunked.with_global_ordinal(sliced, [F.col("unit")], place, "_pos").drop("_cuts")
    paired = ranked.join(truth, F.col("_pos") == F.col("pos"), "full")
    # The check is part of the row filter, so it cannot be pruned away with an unused column.
    matched = F.col("unit").isNotNull() & F.col("pos").isNotNull()
    failed = F.raise_error(F.lit("units and truth lines differ in number")).cast("boolean")
    return paired.where(F.when(matched, F.lit(True)).otherwise(failed)).select("unit", F.col("rul").alias("RUL"))


def attach_truth(test: DataFrame, unit_truth: DataFrame) -> DataFrame:
    """Every test row gets the final RUL of its unit."""
    return test.join(shared.settle(unit_truth, "truth"), "unit", "left")


def fit_scaler(train: DataFrame, sensors: Sequence[str] = config.SENSORS) -> DataFrame:
    """One row per sensor ``(sensor, pos, min, max, range)`` from one pass over the train rows."""
    bounds = train.agg(
        *[F.min(s).cast("double").alias(f"lo_{s}") for s in sensors],
        *[F.max(s).cast("double").alias(f"hi_{s}") for s in sensors],
    )
    return _as_rows(bounds, sensors)


def fit_scaler_by_unit(rows: DataFrame, sensors: Sequence[str] = config.SENSORS, *keys: str) -> DataFrame:
    """Bounds of each unit ``(keys..., n, lo_..., hi_...)``, kept in the shared folder: one read, map-side combined.

    The units themselves, their row counts and the bounds of any set of them (``bounds_of_units``, ``bounds_by``) follow without
    another. ``keys`` are the unit unless said otherwise.
    """
    keys = keys or ("unit",)
    ends = [F.min(s).cast("double").alias(f"lo_{s}") for s in sensors] + [F.max(s).cast("double").alias(f"hi_{s}") for s in sensors]
    return shared.settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *ends), "unit-bounds")


def bounds_by(per_unit: DataFrame, group: str, sensors: Sequence[str] = config.SENSORS) -> DataFrame:
    """``(group, lo_..., hi_...)`` from bounds of finer keys."""
    ends = [F.min(f"lo_{s}").alias(f"lo_{s}") for s in sensors] + [F.max(f"hi_{s}").alias(f"hi_{s}") for s in sensors]
    return per_unit.groupBy(group).agg(*ends)


def bounds_of_units(per_unit: DataFrame, units: DataFrame, sensors: Sequence[str] = config.SENSORS, unit: str = "unit") -> DataFrame:
    """As ``fit_scaler`` on the rows of the given units (null is one like others)."""
    wanted = units.select(F.col(unit).alias("_unit"))
    own = per_unit.join(wanted, F.col(unit).eqNullSafe(F.col("_unit")), "left_semi")
    ends = [F.min(f"lo_{s}").alias(f"lo_{s}") for s in sensors] + [F.max(f"hi_{s}").alias(f"hi_{s}") for s in sensors]
    return _as_rows(own.agg(*ends), sensors)


def _as_rows(bounds: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """One row of ``lo_...`` and ``hi_...`` as one row for each sensor."""
    told = [
        F.struct(
            F.lit(s).alias("sensor"),
            F.lit(i).alias("pos"),
            F.col(f"lo_{s}").alias("min"),
            F.col(f"hi_{s}").alias("max"),
            (F.col(f"hi_{s}") - F.col(f"lo_{s}")).alias("range"),
        )
        for i, s in enumerate(sensors)
    ]
    return bounds.select(F.inline(F.array(*told)))


def scale(df: DataFrame, bounds: DataFrame, sensors: Sequence[str] = config.SENSORS) -> DataFrame:
    """Min-max scale the sensor columns with fitted bounds, not clamped.

    The bounds are one row for each sensor. They come to the driver and enter as literals, so there is nothing to join or
    shuffle and one scan in the plan; a sensor without bounds becomes null.
    """
    known = bounds_to_dict(bounds)
    ends = {s: [F.lit(x).cast("double") for x in known.get(s, (None, None))] for s in sensors}
    return df.withColumns({s: S.min_max(F.col(s).cast("double"), *ends[s]) for s in sensors})


def bounds_to_dict(bounds: DataFrame) -> dict[str, tuple[float, float]]:
    """Bring the bounds to the driver as literals for a stream: one row per sensor."""
    return {r["sensor"]: (r["min"], r["max"]) for r in bounds.select("sensor", "min", "max").collect()}


def check_bounds(bounds: DataFrame, sensors: Sequence[str] = config.SENSORS) -> DataFrame:
    """Fail when the fitted parameters do not cover exactly the configured sensors."""
    found = bounds.count()
    if found != len(sensors):
        raise ValueError(f"{found} fitted sensors, {len(sensors)} configured")
    return bounds


def scale_per_group(df: DataFrame, group: str, sensors: Sequence[str], bounds: DataFrame | None = None) -> DataFrame:
    """Min-max scale within each operating condition (null is one too); the bounds are one row per condition.

    ``bounds`` (group, lo_..., hi_...) may be given where they are known, as from ``bounds_by``; else they are read from ``df``.
    """
    if bounds is None:
        bounds = bounds_by(fit_scaler_by_unit(df, sensors, group), group, sensors)
    renamed = {group: "_group", **{f"{end}_{s}": f"_{end}_{s}" for s in sensors for end in ("lo", "hi")}}
    bounds = shared.settle(bounds.select(*renamed).withColumnsRenamed(renamed), "bounds")
    scaled = {s: S.min_max(F.col(s).cast("double"), F.col(f"_lo_{s}"), F.col(f"_hi_{s}")) for s in sensors}
    return df.join(bounds, F.col(group).eqNullSafe(F.col("_group"))).withColumns(scaled).drop(*bounds.columns)


def target_scaled(label: Column, clip: float = config.RUL_CLIP) -> Column:
    return (label.cast("float") / F.lit(float(clip))).cast("float")


def sample_weight(label: Column) -> Column:
    return F.lit(1.0) + F.lit(1.5) * label


def group_split(
    df: DataFrame,
    unit: str = "unit",
    share: float = config.VALIDATION_SHARE,
    seed: int = config.SPLIT_SEED,
    units: DataFrame | None = None,
) -> DataFrame:
    """One row per unit (null is one too) with ``split``: exactly ceil(share * units) units are 'val', the rest 'train'.

    Units are ranked by a seeded hash. The first four hex digits cut the ranking into 65,536 even slices, so
    no task sees more than a sliver of the units. ``units`` (one row each) may be given where they are known; else they
    are read from ``df``.
    """
    units = shared.settle(df.select(unit).distinct(), "units") if units is None else units.select(unit)
    total = units.agg(F.count(F.lit(1)).alias("n")).scalar()
    keyed = units.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(unit).cast("string"), F.lit(""))).cast("binary")))
    bucket = F.conv(F.substring("_h", 1, 4), 16, 10).cast("long")
    ranked = chunked.with_global_ordinal(keyed, [F.col("_h"), F.col(unit)], bucket, "_rank")
    return ranked.select(
        unit, F.when(F.col("_rank") <= F.ceil(F.lit(share) * total), "val").otherwise("train").alias("split")
    )
