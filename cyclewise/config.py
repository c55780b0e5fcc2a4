"""Fixed values of the data model and the tunables of the Spark jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

# --- Fixed values: the input format and the published thresholds -----------------------------
SENSORS = ("s2", "s3", "s4", "s7", "s9", "s11", "s12", "s14", "s17", "s20", "s21")
RAW_COLUMNS = ("unit", "cycle", "os1", "os2", "os3") + tuple(f"s{i}" for i in range(1, 22))
DROPPED_COLUMNS = ("s1", "s5", "s6", "s8", "s10", "s13", "s15", "s16", "s18", "s19", "os3")
RUL_CLIP = 125
WINDOW_SIZE = 30
VALIDATION_SHARE = 0.2
SPLIT_SEED = 42
CRITICAL_RUL = 30
RISK_CUTS = (("CRITICAL", 0.8), ("HIGH", 0.6), ("MEDIUM", 0.3))
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
PROMOTION_RMSE = 70
PROMOTION_NASA = 10000
DRIFT_P_VALUE = 0.05
DRIFT_WARNING_SHARE = 0.3
DRIFT_CRITICAL_SHARE = 0.5
DRIFT_MIN_ROWS = 100
ONLINE_TTL_SECONDS = 3600
STREAM_RETENTION = 50_000
ALERT_LIMIT = 50
# Positions of the kept sensors in a raw line, counted from 0, and the length of such a line.
SENSOR_POSITIONS = (6, 7, 8, 11, 13, 15, 16, 18, 21, 24, 25)
RAW_TOKENS = 26
ENGINE_PREFIX = "ENG-"
STORE_KEY = "engine:{id}:{kind}"
TOPIC = "aircraft/engine/{id}/telemetry/cycle"
TOPIC_PATTERN = "^aircraft/engine/[^/]+/telemetry/cycle$"
SOURCE_STORE = "redis_stream"
SOURCE_BUFFER = "push_buffer"
SHAPE_ERROR = "Expected shape ({rows}, {width}), got "
LENGTH_ERROR = "Expected {rows} readings, got "
KEYS_ERROR = "Missing required sensor keys: "
RUL_BINS = (
    ("critical(0-30)", 0, 30),
    ("degrading(30-60)", 30, 60),
    ("mid(60-90)", 60, 90),
    ("healthy(90-125)", 90, 125),
)
LIFECYCLE_STAGES = (("LOW", 0.4), ("MEDIUM", 0.6), ("HIGH", 0.8), ("CRITICAL", 1.0))
RUL_BUCKETS = (0, 10, 20, 30, 50, 75, 100, 125)
SHARE_BUCKETS = tuple(i / 10 for i in range(11))
LATENCY_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
METRIC_TARGETS = (
    ("rmse", "<", 20.0),
    ("nasa_score", "<", 2000.0),
    ("precision_critical", ">", 0.8),
    ("recall_critical", ">", 0.75),
    ("f1_critical", ">", 0.8),
    ("accuracy", ">", 0.8),
    ("f1_weighted", ">", 0.8),
)
# ---------------------------------------------------------------------------------------------

# A key with more rows than this is cut into chunks, so that no task holds one key's history.
HOT_ROWS = 2_000_000
# Rows of one key that a single sliding-window task may hold.
CHUNK_ROWS = 200_000


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session settings that results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark
