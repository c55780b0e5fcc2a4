"""From a normalised score to prediction records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewise import config
from cyclewise.functions import scalars as S


def grade(df: DataFrame, score: Column, clip: float = config.RUL_CLIP, round_first: bool = False) -> DataFrame:
    """Add ``remaining_cycles, failure_risk, risk_level``.

    The request path grades the unrounded risk and rounds on output; the live path rounds to three digits
    first and grades the rounded value (``round_first``).
    """
    rul = S.rul_from_score(score, clip)
    risk = S.risk_from_rul(rul, clip)
    rounded = S.half_even(risk, 3)
    return df.withColumns(
        {
            "remaining_cycles": S.half_even(rul).cast("int"),
            "failure_risk": rounded,
            "risk_level": S.risk_level(rounded if round_first else risk),
        }
    )


def confidence(samples: DataFrame, engine: str, sample: str) -> DataFrame:
    """Mean of the sampled predictions and the confidence from their population deviation."""
    spread = F.stddev_pop(sample)
    return samples.groupBy(engine).agg(
        F.avg(sample).alias("mean_score"),
        S.half_even(S.clamp(F.lit(1.0) - F.lit(10.0) * spread, 0.0, 1.0), 3).alias("confidence"),
    )


def confidence_of(samples: Column) -> tuple[Column, Column]:
    """Mean and confidence of the sampled predictions that one row holds as an array."""
    n = F.size(samples)
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(F.transform(samples, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / n)
    return mean, S.half_even(S.clamp(F.lit(1.0) - F.lit(10.0) * spread, 0.0, 1.0), 3)


def prediction_records(df: DataFrame, score: Column, confidence: Column, at: Column, version: str) -> DataFrame:
    return grade(df, score).select(
        "engine_id",
        "remaining_cycles",
        "failure_risk",
        "risk_level",
        confidence.alias("confidence"),
        at.alias("timestamp"),
        F.lit(version).alias("model_version"),
    )


def audit_records(predictions: DataFrame, at: Column, latency_ms: Column) -> DataFrame:
    """Log records of predictions, to be written with ``tables.write_audit``."""
    return predictions.select(
        at.alias("timestamp"),
        F.lit("INFO").alias("level"),
        F.lit("Prediction completed").alias("message"),
        "engine_id",
        F.col("remaining_cycles").alias("rul"),
        F.col("failure_risk").alias("risk"),
        "risk_level",
        "confidence",
        latency_ms.alias("latency_ms"),
    )


def with_shape_errors(
    df: DataFrame, window: str, score: Column, rows: int = config.WINDOW_SIZE, width: int = len(config.SENSORS)
) -> DataFrame:
    """Grade the rows whose window has the right shape; the others keep their row and get an ``error``."""
    ok = S.has_shape(F.col(window), rows, width)
    graded = grade(df.withColumn("_ok", ok), F.when(ok, score))
    fields = ("remaining_cycles", "failure_risk", "risk_level")
    blanked = {c: F.when(F.col("_ok"), F.col(c)) for c in fields}
    error = F.when(~F.col("_ok"), F.concat(F.lit(config.SHAPE_ERROR.format(rows=rows, width=width)), _shape_text(window)))
    return graded.withColumns({**blanked, "error": error}).drop("_ok")


def _shape_text(window: str) -> Column:
    width = F.coalesce(F.array_max(F.transform(window, F.size)), F.lit(0))
    return F.concat(
        F.lit("("), F.coalesce(F.size(window), F.lit(0)).cast("string"), F.lit(", "), width.cast("string"), F.lit(")")
    )


def scale_raw_window(
    readings: Column, bounds: Mapping[str, tuple[float, float]], names: Sequence[str] = config.SENSORS
) -> Column:
    """Scale an array of sensor maps to an array of ordered rows, not clamped."""

    def row(reading: Column) -> Column:
        scaled = [
            S.min_max(F.element_at(reading, n).cast("float").cast("double"), F.lit(lo), F.lit(hi)).cast("float")
            for n, (lo, hi) in ((n, bounds[n]) for n in names)
        ]
        return F.array(*scaled)

    return F.transform(readings, row)


def raw_window_problem(readings: Column, rows: int, names: Sequence[str] = config.SENSORS) -> Column:
    """Why a raw window cannot be scored, or null: wrong length, else the first reading's missing sensors."""
    lacking = F.filter(F.transform(readings, lambda r: S.missing_keys(r, names)), lambda m: F.size(m) > 0)
    return F.when(
        F.size(readings) != rows,
        F.concat(F.lit(config.LENGTH_ERROR.format(rows=rows)), F.size(readings).cast("string")),
    ).when(
        F.size(lacking) > 0,
        F.concat(F.lit(config.KEYS_ERROR), F.array_join(F.get(lacking, F.lit(0)), ",")),
    )
