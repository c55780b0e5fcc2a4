"""Fleet state: alerts, engine status, rollups and searches over one prediction row per engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewise import config
from cyclewise.functions import scalars as S


def at_or_above(predictions: DataFrame, min_risk: str = "HIGH") -> DataFrame:
    """Predictions at or above a level; an unknown minimum means HIGH, an unknown level LOW."""
    wanted = min_risk.upper()
    threshold = config.RISK_LEVELS.index(wanted) if wanted in config.RISK_LEVELS else 2
    return predictions.where(S.risk_rank(F.col("risk_level"), 0) >= threshold)


def alerts(predictions: DataFrame, min_risk: str = "HIGH") -> DataFrame:
    """The risky predictions, worst first."""
    return at_or_above(predictions, min_risk).orderBy(F.desc("failure_risk"), "engine_id")


def search(predictions: DataFrame, text: str = "", level: str | None = None) -> DataFrame:
    found = predictions.where(F.lower("engine_id").contains(text.lower()))
    return found.where(F.col("risk_level") == level) if level else found


def top_at_risk(predictions: DataFrame, n: int = 15) -> DataFrame:
    return predictions.orderBy(F.desc("failure_risk"), "engine_id").limit(n)


def risk_distribution(predictions: DataFrame) -> DataFrame:
    """Engines per level; all four levels are present, with 0 where there is none."""
    counts = predictions.agg(*[F.count_if(F.col("risk_level") == n).alias(n) for n in config.RISK_LEVELS])
    pairs = F.array(*[F.struct(F.lit(n).alias("risk_level"), F.col(n).alias("engines")) for n in config.RISK_LEVELS])
    return counts.select(F.explode(pairs).alias("r")).select("r.*")


def kpis(predictions: DataFrame, cycle: str = "cycle") -> DataFrame:
    """Fleet size, critical and high counts, mean RUL and mean cycle (rounded half up, 0 when empty)."""
    return predictions.agg(
        F.count(F.lit(1)).alias("active"),
        F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high"),
        F.coalesce(S.half_up(F.avg("remaining_cycles")), F.lit(0)).cast("long").alias("avg_rul"),
        F.coalesce(S.half_up(F.avg(cycle)), F.lit(0)).cast("long").alias("avg_cycle"),
    )


def telemetry_snapshot(engines: DataFrame, meta: DataFrame, window_size: int = config.WINDOW_SIZE) -> DataFrame:
    """Engines with their meta data; defaults where an engine has none."""
    return engines.join(meta, "engine_id", "left").select(
        "engine_id",
        F.coalesce("cycle", F.lit(0)).alias("cycle"),
        F.coalesce("event_time_ms", F.lit(0)).cast("long").alias("event_time_ms"),
        F.coalesce("window_size", F.lit(window_size)).alias("window_size"),
    )


def engine_status(
    buffers: DataFrame, store: DataFrame, predictions: DataFrame, window_size: int = config.WINDOW_SIZE
) -> DataFrame:
    """All engines of the push buffer and the online store, where they come from and whether they can be scored.

    All three inputs hold one row per engine.
    """
    joined = (
        buffers.select("engine_id", "buffer_size")
        .join(store.select("engine_id", F.lit(True).alias("_stored")), "engine_id", "full")
        .join(predictions.select("engine_id", "remaining_cycles", "risk_level"), "engine_id", "left")
    )
    stored = F.coalesce("_stored", F.lit(False))
    return joined.select(
        "engine_id",
        F.when(stored, config.SOURCE_STORE).otherwise(config.SOURCE_BUFFER).alias("source"),
        (stored | (F.coalesce("buffer_size", F.lit(0)) >= window_size)).alias("ready"),
        F.col("remaining_cycles").alias("last_remaining_cycles"),
        F.col("risk_level").alias("last_risk_level"),
    )


def engine_union(*sources: DataFrame) -> DataFrame:
    ids = [s.select("engine_id") for s in sources]
    merged = ids[0]
    for more in ids[1:]:
        merged = merged.union(more)
    return merged.distinct()


def new_alerts(batch: DataFrame, open_alerts: DataFrame, order: str = "arrival") -> DataFrame:
    """First alert of each engine in the batch, unless the engine already has an unacknowledged one.

    An open alert keeps the values it was raised with.
    """
    waiting = open_alerts.where(~F.col("acknowledged")).select("engine_id").distinct()
    rest = [c for c in batch.columns if c != "engine_id"]
    first = (
        batch.groupBy("engine_id")
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("_a"))
        .select("engine_id", *[F.col("_a")[c].alias(c) for c in rest])
    )
    return first.join(waiting, "engine_id", "left_anti").withColumn("acknowledged", F.lit(False))


def keep_newest(alert_rows: DataFrame, n: int = config.ALERT_LIMIT) -> DataFrame:
    return alert_rows.orderBy(F.desc("timestamp"), "engine_id").limit(n)


def unacknowledged(alert_rows: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` open ones among the newest alerts."""
    newest = keep_newest(alert_rows)
    return newest.where(~F.col("acknowledged")).orderBy(F.desc("timestamp"), "engine_id").limit(n)


def alert_id(engine: Column, timestamp: Column) -> Column:
    return F.concat(engine, F.lit("-"), timestamp)


def active(store: DataFrame, now_ms: Column, ttl_seconds: int = config.ONLINE_TTL_SECONDS) -> DataFrame:
    """Engines whose online row has not expired."""
    return store.where(F.col("updated_at_ms") >= now_ms - ttl_seconds * 1000)
