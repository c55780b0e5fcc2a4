"""Remaining-life regression, bulk scoring and operating-condition clusters with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclewise import config, shared
from cyclewise.functions import scalars as S
from cyclewise.operators import scoring, transform

NOT_FEATURES = ("unit", "cycle", "label", "split", "y", "weight", "engine_id")


def training_rows(features: DataFrame, split: DataFrame, clip: float = config.RUL_CLIP) -> DataFrame:
    """Window features with their unit's split, the scaled target and the sample weight."""
    y = transform.target_scaled(F.col("label"), clip).cast("double")
    parts = shared.settle(split.withColumnRenamed("unit", "_unit"), "split")
    rows = features.join(parts, F.col("unit").eqNullSafe(F.col("_unit"))).drop("_unit")
    return rows.withColumn("y", y).withColumn("weight", transform.sample_weight(F.col("y")))


def train(rows: DataFrame, trees: int = 20, depth: int = 5, seed: int = config.SPLIT_SEED) -> PipelineModel:
    """Weighted gradient-boosted regression on the train units; the fit is distributed.

    ``train_with_history`` also looks at the validation units.
    """
    return Pipeline(stages=[_assembler(rows), _booster(trees, depth, seed)]).fit(rows.where(F.col("split") == "train"))


def _assembler(rows: DataFrame) -> VectorAssembler:
    return VectorAssembler(inputCols=[c for c in rows.columns if c not in NOT_FEATURES], outputCol="features")


def _booster(trees: int, depth: int, seed: int) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed)


def train_with_history(
    rows: DataFrame, trees: int = 20, depth: int = 5, seed: int = config.SPLIT_SEED, stop_early: bool = False
) -> tuple[PipelineModel, DataFrame]:
    """The fit of ``train``, cut back to its best round on the validation units, and its history.

    History: ``epoch`` (the number of trees), ``loss`` and ``val_loss`` (mean squared error of the scaled target on either
    side), ``rmse`` and ``val_rmse``. The model keeps the trees up to the first epoch of the smallest validation loss. All
    ``trees`` rounds are made and told unless ``stop_early``: then boosting ends at the first round that is worse on the
    validation units, and the history ends with the best. The rows are read from the shared folder, and dealt evenly before: each
    of the hundred and more passes of a fit takes as long as its largest task, and one task more than there are cores doubles it.
    """
    assembler = _assembler(rows)
    told = F.col("split") == "val"
    dealt = assembler.transform(rows).repartition(rows.sparkSession.sparkContext.defaultParallelism, told, "unit", "cycle")
    held = shared.settle(dealt.select(told.alias("validation"), "y", "weight", "features"), "boosting")
    sides = [held.where(~F.col("validation")), held.where("validation")]
    booster = _booster(trees, depth, seed)
    if stop_early:
        model = booster.setValidationIndicatorCol("validation").setParams(validationTol=0.0).fit(held)
    else:
        model = booster.fit(sides[0])
    # The weights steer the fit; a loss is a plain mean.
    losses = list(zip(*[model.evaluateEachIteration(side.withColumn("weight", F.lit(1.0)), "squared") for side in sides]))
    best = min(range(len(losses)), key=lambda i: (losses[i][1], i)) + 1
    schema = "epoch int, loss double, val_loss double, rmse double, val_rmse double"
    history = [(i + 1, a, b, math.sqrt(a), math.sqrt(b)) for i, (a, b) in enumerate(losses)]
    return PipelineModel([assembler, first_trees(model, best)]), rows.sparkSession.createDataFrame(history, schema)


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model as it was after ``n`` rounds."""
    own = model._java_obj
    gateway = SparkSession.active().sparkContext._gateway
    regression = gateway.jvm.org.apache.spark.ml.regression
    kept, weights = gateway.new_array(regression.DecisionTreeRegressionModel, n), gateway.new_array(gateway.jvm.double, n)
    trees = own.trees()
    for i in range(n):
        kept[i], weights[i] = trees[i], float(model.treeWeights[i])
    return GBTRegressionModel(regression.GBTRegressionModel(own.uid(), kept, weights, own.numFeatures()))


def score(model: PipelineModel, features: DataFrame, clip: float = config.RUL_CLIP) -> DataFrame:
    """Add ``pred_norm`` and ``pred_rul`` (in cycles, clipped to [0, clip])."""
    scored = model.transform(features).drop("features").withColumnRenamed("prediction", "pred_norm")
    return scored.withColumn("pred_rul", S.clamp(F.col("pred_norm") * float(clip), 0.0, clip))


def external_score(make_predict: Callable, rows: int, width: int, batch_size: int = 1024):
    """Column function that scores flattened windows with any model.

    ``make_predict`` runs once per Python worker and returns a function from an array (n, rows, width) to n scores.
    """

    def load():
        predict = make_predict()
        return lambda windows: np.asarray(predict(windows), dtype="f8").reshape(-1)

    return predict_batch_udf(
        load, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[rows, width]]
    )


def fleet_predictions(model: PipelineModel, features: DataFrame, version: str) -> DataFrame:
    """Prediction records of the live path: graded after rounding, confidence 1."""
    graded = scoring.grade(score(model, features), F.col("pred_norm"), round_first=True)
    return graded.select(
        S.engine_id(F.col("unit")).alias("engine_id"),
        "cycle",
        "remaining_cycles",
        "failure_risk",
        "risk_level",
        F.lit(1.0).alias("confidence"),
        F.lit(version).alias("model_version"),
    )


def cluster_conditions(df: DataFrame, settings: Sequence[str], k: int, seed: int = config.SPLIT_SEED) -> DataFrame:
    """Group rows by operating condition with k-means on the setting columns; adds ``condition``."""
    rows = shared.settle(df.groupBy(*settings).agg(F.count(F.lit(1)).alias("n")), "settings")
    return fit_conditions(rows, settings, k, seed).transform(df).drop("_settings")


def fit_conditions(rows: DataFrame, settings: Sequence[str], k: int, seed: int = config.SPLIT_SEED) -> PipelineModel:
    """k-means on settled ``rows`` (settings..., n, ...): equal settings are one point that counts ``n`` times, so the rounds of the
    fit read no more than the different settings."""
    weighted = rows.withColumn("_weight", F.col("n").cast("double"))
    assembler = VectorAssembler(inputCols=list(settings), outputCol="_settings")
    clusters = KMeans(featuresCol="_settings", predictionCol="condition", weightCol="_weight", k=k, seed=seed)
    return Pipeline(stages=[assembler, clusters]).fit(weighted)


def scale_by_conditions(
    df: DataFrame, settings: Sequence[str], sensors: Sequence[str], k: int, per_setting: DataFrame | None = None, seed: int = config.SPLIT_SEED
) -> DataFrame:
    """Cluster rows by their settings and scale the sensors within each cluster; adds ``condition``.

    ``per_setting`` (settings..., n, lo_..., hi_...; other keys may split it further) may be given where it is known. It is one
    read of the rows; clusters and their bounds come from it, so the rows are read once more only, to be scaled.
    """
    if per_setting is None:
        per_setting = transform.fit_scaler_by_unit(df, sensors, *settings)
    model = fit_conditions(shared.settle(per_setting.groupBy(*settings).agg(F.sum("n").alias("n")), "settings"), settings, k, seed)
    bounds = transform.bounds_by(model.transform(per_setting), "condition", sensors)
    return transform.scale_per_group(model.transform(df).drop("_settings"), "condition", sensors, bounds)
