"""The batch run: bronze text, checks, silver rows, gold windows, model, evaluation, gate.

Stages talk through tables below one work folder; inside a stage everything is one lazy plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclewise import config, shared
from cyclewise.operators import evaluate, models, quality, transform, windows
from cyclewise.sources import tables, text


class ValidationError(RuntimeError):
    pass


@dataclass(frozen=True)
class BatchRun:
    spark: SparkSession
    work: str
    sensors: tuple[str, ...] = config.SENSORS
    size: int = config.WINDOW_SIZE
    clip: int = config.RUL_CLIP
    trees: int = 20

    def _path(self, name: str) -> str:
        return f"{self.work}/{name}"

    def _lines(self, path: str) -> DataFrame:
        return tables.read_parquet(self.spark, path)

    def ingest(self, train: str, test: str, truth: str) -> dict[str, str]:
        return tables.ingest_bronze(self.spark, {"train": train, "test": test, "RUL": truth}, self._path("bronze"))

    def parse(self, bronze: dict[str, str]) -> None:
        """The text becomes typed columns once; the passes that follow read only the columns they need."""
        for name in ("train", "test"):
            tables.write_silver(text.placed_cycles(self._lines(bronze[name])), self._path(f"typed/{name}"))

    def _typed(self, name: str) -> DataFrame:
        return tables.read_parquet(self.spark, self._path(f"typed/{name}"))

    def validate(self, bronze: dict[str, str]) -> DataFrame:
        """Run every check, write the status, and stop the run when one failed."""
        checks = None
        for name in ("train", "test"):
            order = quality.cycle_order_violations(self._typed(name), ["place", "line_order"], F.col("place"))
            falling = order.agg(
                F.lit("cycle_order").alias("check"), F.coalesce(F.sum("violations"), F.lit(0)).alias("violations")
            )
            found = quality.main_checks(text.tokenize(self._lines(bronze[name]))).unionAll(falling)
            found = found.withColumn("check", F.concat(F.lit(f"{name}_"), F.col("check")))
            checks = found if checks is None else checks.unionAll(found)
        checks = checks.unionAll(quality.truth_checks(text.tokenize(self._lines(bronze["RUL"]))))
        status = quality.verdict(checks)
        tables.write_metadata(status, self._path("status"))
        row = tables.read_metadata(self.spark, self._path("status"), status.schema).first()
        if row["status"] != "passed":
            raise ValidationError(row["error"])
        return checks

    def transform(self, bronze: dict[str, str]) -> None:
        """Silver rows of train and test, and the scaler parameters (fitted on train only)."""
        train, test = (
            transform.drop_columns(self._typed(name).drop("place", "line_order")) for name in ("train", "test")
        )
        train = transform.add_rul(train, self.clip)
        unit_truth = transform.truth_by_position(test.select("unit"), text.truth(self._lines(bronze["RUL"])))
        bounds = shared.settle(transform.fit_scaler(train, self.sensors), "bounds")
        transform.check_bounds(bounds, self.sensors)
        tables.write_bounds(bounds, self._path("scaler"))
        tables.write_metadata(tables.feature_config(bounds, self.size, self.clip), self._path("feature_config"))
        tables.write_silver(transform.scale(train, bounds, self.sensors), self._path("silver/train"))
        tables.write_silver(
            transform.scale(transform.attach_truth(test, unit_truth), bounds, self.sensors), self._path("silver/test")
        )

    def features(self) -> None:
        """Gold: feature rows of train and validation units, last windows of the test units."""
        train = tables.read_parquet(self.spark, self._path("silver/train"))
        test = tables.read_parquet(self.spark, self._path("silver/test"))
        rows = windows.window_features(train, self.sensors, self.size)
        split = transform.group_split(train)
        tables.write_gold(models.training_rows(rows, split, self.clip), self._path("gold/train"))
        last = windows.last_windows(test, self.sensors, self.size)
        tables.write_silver(last, self._path("gold/test"))

    def train(self) -> PipelineModel:
        rows = tables.read_parquet(self.spark, self._path("gold/train"))
        model = models.train(rows, trees=self.trees)
        model.write().overwrite().save(self._path("model"))
        return model

    def evaluate(self) -> DataFrame:
        """Results per test unit and the report; returns the unrounded metrics."""
        model = PipelineModel.load(self._path("model"))
        last = tables.read_parquet(self.spark, self._path("gold/test"))
        rows = windows.array_features(last, self.sensors, self.size)
        scored = models.score(model, rows, self.clip)
        truth = F.least(F.greatest(F.col("label"), F.lit(0)), F.lit(self.clip))
        tables.write_silver(evaluate.error_table(scored, F.col("pred_norm"), truth, self.clip), self._path("results"))
        results = tables.read_parquet(self.spark, self._path("results"))
        metrics = evaluate.metrics_row(results)
        tables.write_metadata(metrics, self._path("metrics"))
        return tables.read_metadata(self.spark, self._path("metrics"), metrics.schema)

    def promote(self, metrics: DataFrame) -> bool:
        return evaluate.promotion(metrics).first()["promote"]

    def run(self, train: str, test: str, truth: str) -> bool:
        bronze = self.ingest(train, test, truth)
        self.parse(bronze)
        self.validate(bronze)
        self.transform(bronze)
        self.features()
        self.train()
        return self.promote(self.evaluate())
