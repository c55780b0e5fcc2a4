"""Column expressions: clipping, scaling, risk grading, rounding, text keys, time parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cyclewise import config


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def half_up(x: Column) -> Column:
    """Round to a whole number, halves upwards (the dashboard's rounding)."""
    return F.floor(x + 0.5)


def half_even(x: Column, digits: int = 0) -> Column:
    """Round halves to the even neighbour (the scoring service's rounding)."""
    return F.bround(x, digits)


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Min-max scale, not clamped; a constant sensor (zero range) divides by 1."""
    spread = high - low
    return (x - low) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)


def min_max_stream(x: Column, low: float, high: float) -> Column:
    """Min-max scale in single precision, clamped to [0, 1]."""
    low_f, high_f = F.lit(low).cast("float"), F.lit(high).cast("float")
    spread = (high_f - low_f).cast("float")
    spread = F.when(spread == 0, F.lit(1.0).cast("float")).otherwise(spread)
    # Double division of two floats, rounded once to float, equals float division.
    scaled = ((x.cast("float") - low_f).cast("float").cast("double") / spread.cast("double")).cast("float")
    one, zero = F.lit(1.0).cast("float"), F.lit(0.0).cast("float")
    return F.when(scaled > one, one).when(scaled < zero, zero).otherwise(scaled)


def rul_from_score(score: Column, clip: float = config.RUL_CLIP) -> Column:
    return F.greatest(F.lit(0.0), score * F.lit(float(clip)))


def risk_from_rul(rul: Column, clip: float = config.RUL_CLIP) -> Column:
    return clamp(F.lit(1.0) - rul / F.lit(float(clip)), 0.0, 1.0)


def risk_level(risk: Column) -> Column:
    grade = None
    for level, cut in config.RISK_CUTS:
        grade = F.when(risk >= cut, level) if grade is None else grade.when(risk >= cut, level)
    return grade.otherwise("LOW")


def risk_rank(level: Column, unknown: int) -> Column:
    grade = None
    for rank, name in enumerate(config.RISK_LEVELS):
        grade = F.when(level == name, rank) if grade is None else grade.when(level == name, rank)
    return grade.otherwise(unknown)


def engine_id(unit: Column) -> Column:
    return F.concat(F.lit(config.ENGINE_PREFIX), unit.cast("string"))


def unit_of(engine: Column) -> Column:
    return F.replace(engine, F.lit(config.ENGINE_PREFIX), F.lit(""))


def _filled(pattern: str, engine: Column, kind: str = "") -> Column:
    before, after = pattern.replace("{kind}", kind).split("{id}")
    return F.concat(F.lit(before), engine, F.lit(after))


def store_key(engine: Column, kind: str) -> Column:
    """Key of an engine's ``features``, ``meta`` or ``buffer``."""
    return _filled(config.STORE_KEY, engine, kind)


def engine_of_key(key: Column) -> Column:
    return F.split_part(key, F.lit(":"), F.lit(2))


def topic(engine: Column) -> Column:
    return _filled(config.TOPIC, engine)


def partition_parts(epoch_ms: Column) -> tuple[Column, Column]:
    """UTC ``date`` and ``hour`` strings of an epoch-millisecond column."""
    moment = F.timestamp_millis(epoch_ms)
    return F.date_format(moment, "yyyy-MM-dd"), F.date_format(moment, "HH")


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def sensor_array(sensors: Column, names: Sequence[str] = config.SENSORS) -> Column:
    """The named readings in order; a missing reading is 0."""
    return F.array(*[F.coalesce(F.try_element_at(sensors, F.lit(n)), F.lit(0.0)) for n in names])


def missing_keys(sensors: Column, names: Sequence[str] = config.SENSORS) -> Column:
    """Required sensors that a reading lacks, in order; a null reading lacks all."""
    required = F.array(*[F.lit(n) for n in names])
    return F.when(sensors.isNull(), required).otherwise(F.array_except(required, F.map_keys(sensors)))


def has_shape(window: Column, rows: int, width: int) -> Column:
    """True for a window of exactly ``rows`` x ``width``; false for a null window."""
    ok = (F.size(window) == rows) & F.forall(window, lambda row: F.coalesce(F.size(row) == width, F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def reshape(flat: Column, rows: int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(flat, i * width + 1, F.lit(width)))


def normalize_stream(
    values: Column, bounds: Mapping[str, tuple[float, float]], names: Sequence[str] = config.SENSORS
) -> Column:
    """Scale an ordered sensor array with literal bounds; runs inside generated code, no Python worker."""
    return F.array(*[min_max_stream(values[i], *bounds[name]) for i, name in enumerate(names)])
