"""Parquet, JSON and text tables of the batch run and the online store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclewise import config
from cyclewise.sources import text


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ingest_bronze(spark: SparkSession, sources: dict[str, str], bronze: str) -> dict[str, str]:
    """Copy raw text inputs into the bronze area; an input that is already there as a whole is left alone.

    A folder without the mark of a finished write is left over from an aborted one and written anew.

    Bronze lines keep their place in the input as columns, because line order carries meaning and the order of
    copied files would not keep it.
    """
    targets = {}
    for name, uri in sources.items():
        targets[name] = f"{bronze}/{name}"
        if not _is_complete(spark, targets[name]):
            text.read_lines(spark, uri).write.mode("overwrite").parquet(targets[name])
    return targets


def _is_complete(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def write_silver(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_gold(windows: DataFrame, path: str) -> None:
    """Feature windows with their split as partition, so one split is read without the others."""
    windows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_metadata(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_bounds(bounds: DataFrame, path: str) -> None:
    """Scaler parameters as two CSV lines, minimum and maximum, 8 decimals; one row per sensor comes in."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "min", "max")))
    lines = bounds.agg(ordered.alias("b")).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("line"),
                        F.array_join(F.transform("b", lambda e: F.format_string("%.8f", e[c])), ",").alias("value"),
                    )
                    for i, c in enumerate(("min", "max"))
                ]
            )
        ).alias("r")
    )
    lines.select("r.line", "r.value").coalesce(1).sortWithinPartitions("line").select("value").write.mode(
        "overwrite"
    ).text(path)


def read_bounds(spark: SparkSession, path: str, sensors: tuple[str, ...] = config.SENSORS) -> DataFrame:
    """The two-line parameter file as ``(sensor, pos, min, max, range)``; its length must match the sensors."""
    minimum, maximum = (r["value"].split(",") for r in spark.read.text(path, wholetext=False).take(2))
    if not len(minimum) == len(maximum) == len(sensors):
        raise ValueError(f"{len(minimum)} and {len(maximum)} parameters for {len(sensors)} sensors")
    rows = [
        (s, i, float(lo), float(hi), float(hi) - float(lo))
        for i, (s, lo, hi) in enumerate(zip(sensors, minimum, maximum))
    ]
    return spark.createDataFrame(rows, "sensor string, pos int, min double, max double, range double")


def feature_config(bounds: DataFrame, size: int = config.WINDOW_SIZE, clip: int = config.RUL_CLIP) -> DataFrame:
    """What a scoring job must know about the features, as one row; one row per sensor comes in."""
    by_position = F.array_sort(F.collect_list(F.struct("pos", "sensor", "min", "max", "range")))
    column = lambda name: F.transform("b", lambda e: e[name])
    return bounds.agg(by_position.alias("b")).select(
        column("sensor").alias("sensors"),
        F.size("b").alias("n_sensors"),
        F.lit(size).alias("window_size"),
        F.lit(clip).alias("rul_clip"),
        column("min").alias("data_min"),
        column("max").alias("data_max"),
        column("range").alias("data_range"),
    )


def write_audit(predictions: DataFrame, path: str) -> None:
    """One JSON object per prediction and line; fields without a value are left out."""
    predictions.select(F.to_json(F.struct(*predictions.columns)).alias("value")).write.mode("append").text(path)


def online_features(store: DataFrame, rows: int, width: int, now_ms, ttl: int = config.ONLINE_TTL_SECONDS) -> DataFrame:
    """Unexpired online rows whose feature vector has the full length."""
    return store.where(
        (F.size("features") == rows * width) & (F.col("updated_at_ms") >= now_ms - F.lit(ttl * 1000))
    )
