"""The scoring service's calls as functions from request tables to answer tables.

A call that took one request over the network takes a table of requests here. ``score`` is the model: it turns
a column of flattened windows into normalised scores (``models.external_score`` makes one from any predictor,
a plain expression will do as well). A model that gives several sampled scores per window is passed as ``samples``
instead: the answer's score is their mean, and its confidence comes from their spread; without samples it is 1.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewise import config
from cyclewise.functions import scalars as S
from cyclewise.operators import drift, evaluate, fleet, scoring, windows
from cyclewise.sources import tables


@dataclass(frozen=True)
class FleetService:
    score: Callable[[Column], Column] | None
    bounds: Mapping[str, tuple[float, float]]
    sensors: Sequence[str] = config.SENSORS
    size: int = config.WINDOW_SIZE
    version: str = "unknown"
    samples: Callable[[Column], Column] | None = None

    def predict(self, requests: DataFrame) -> DataFrame:
        """``(engine_id, sensor_data array<array<float>>)``: scaled windows. A bad row gets an ``error``."""
        ok = S.has_shape(F.col("sensor_data"), self.size, len(self.sensors))
        scored = self._scored(requests, self._flat_where(ok, F.flatten("sensor_data")))
        answers = scoring.with_shape_errors(scored, "sensor_data", F.col("_score"), self.size, len(self.sensors))
        return self._answer(answers)

    def predict_raw(self, requests: DataFrame) -> DataFrame:
        """``(engine_id, sensor_data array<map<string,double>>)``: raw windows, checked and scaled first."""
        raw = F.col("sensor_data")
        checked = requests.withColumn("error", scoring.raw_window_problem(raw, self.size, self.sensors))
        scaled = scoring.scale_raw_window(raw, self.bounds, self.sensors)
        scored = self._scored(checked, self._flat_where(F.col("error").isNull(), F.flatten(scaled)))
        graded = scoring.grade(scored, F.col("_score"))
        blank = {c: F.when(F.col("error").isNull(), F.col(c)) for c in ("remaining_cycles", "failure_risk", "risk_level")}
        return self._answer(graded.withColumns(blank))

    def predict_engines(self, store: DataFrame, now_ms: Column) -> DataFrame:
        """Every engine whose online vector is complete and not expired; its readings are scaled already."""
        live = tables.online_features(store, self.size, len(self.sensors), now_ms)
        graded = scoring.grade(self._scored(live, F.col("features")), F.col("_score"))
        return self._answer(graded.withColumn("error", F.lit(None).cast("string")))

    def predict_engine(self, store: DataFrame, now_ms: Column, engine_id: str) -> DataFrame:
        """One engine's answer; no row when it isn't in the store, is incomplete or has expired."""
        return self.predict_engines(store.where(F.col("engine_id") == engine_id), now_ms)

    def predict_buffered(self, readings: DataFrame) -> DataFrame:
        """``(engine_id, arrival, sensors)``: the last full window of each engine's raw readings."""
        accepted, _ = self.push(readings)
        full = windows.full_buffers(self.buffers(accepted), self.size)
        raw = F.transform("readings", lambda r: F.map_from_entries(r["pairs"]))
        return self.predict_raw(full.select("engine_id", raw.alias("sensor_data")))

    def push(self, readings: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Readings that hold every sensor, and the rejected ones with what they lack."""
        checked = readings.withColumn("missing", S.missing_keys(F.col("sensors"), self.sensors))
        return checked.where(F.size("missing") == 0).drop("missing"), checked.where(F.size("missing") > 0)

    def buffers(self, accepted: DataFrame) -> DataFrame:
        """The last readings of each engine, oldest first. Maps cannot be sorted, so they travel as pairs."""
        pairs = accepted.withColumn("pairs", F.map_entries("sensors"))
        return windows.push_buffer(pairs, ["pairs"], self.size, unit="engine_id")

    def engines(self, buffers: DataFrame, store: DataFrame, predictions: DataFrame) -> DataFrame:
        return fleet.engine_status(buffers, store, predictions, self.size).orderBy("engine_id")

    def alerts(self, predictions: DataFrame, min_risk: str = "HIGH") -> DataFrame:
        return fleet.alerts(predictions, min_risk)

    def evaluation(self, errors: DataFrame) -> DataFrame:
        return evaluate.summary(evaluate.metrics_row(errors))

    def drift(self, reference: DataFrame, current: DataFrame) -> DataFrame:
        return drift.drift_summary(reference, current, self.sensors)

    def _flat_where(self, ok: Column, flat: Column) -> Column:
        """A Python model sees every row, so rows that are not to be scored hand it zeros of the right length."""
        zeros = F.array_repeat(F.lit(0.0).cast("float"), self.size * len(self.sensors))
        return F.when(ok, flat.cast("array<float>")).otherwise(zeros)

    def _scored(self, rows: DataFrame, flat: Column) -> DataFrame:
        """Add ``_score`` and ``_confidence``."""
        if self.samples is None:
            return rows.withColumn("_score", self.score(flat)).withColumn("_confidence", F.lit(1.0))
        mean, confidence = scoring.confidence_of(F.col("_samples"))
        return rows.withColumn("_samples", self.samples(flat)).withColumns({"_score": mean, "_confidence": confidence})

    def _answer(self, graded: DataFrame) -> DataFrame:
        return graded.select(
            "engine_id",
            "remaining_cycles",
            "failure_risk",
            "risk_level",
            F.when(F.col("error").isNull(), F.col("_confidence")).alias("confidence"),
            F.current_timestamp().alias("timestamp"),
            F.lit(self.version).alias("model_version"),
            "error",
        )
