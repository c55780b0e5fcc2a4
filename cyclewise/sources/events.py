"""Engine events: JSON form, bad-record split, conversion from raw lines, topic routing, stream input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclewise import config
from cyclewise.functions import scalars as S

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("engine_id", T.StringType()),
        T.StructField("cycle", T.IntegerType()),
        T.StructField("event_time_ms", T.LongType()),
        T.StructField("sensors", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def encode(df: DataFrame) -> Column:
    return F.to_json(F.struct("engine_id", "cycle", "event_time_ms", "sensors"))


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """Parse JSON messages; an unreadable one keeps its text in ``_corrupt`` and nulls elsewhere."""
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(
        F.col(value).cast("string"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    return messages.withColumn("_e", parsed).select(
        *[c for c in messages.columns if c != value],
        F.col(value).cast("string").alias("_raw"),
        "_e.engine_id",
        "_e.cycle",
        "_e.event_time_ms",
        "_e.sensors",
        F.col("_e._corrupt").alias("_corrupt"),
    )


def is_bad() -> Column:
    """An event is unusable when it does not parse or lacks a required field."""
    required = [F.col(c).isNull() for c in ("engine_id", "cycle", "event_time_ms", "sensors")]
    bad = F.col("_corrupt").isNotNull()
    for r in required:
        bad = bad | r
    return bad


def good_events(decoded: DataFrame) -> DataFrame:
    return decoded.where(~is_bad()).drop("_raw", "_corrupt")


def quarantined(decoded: DataFrame) -> DataFrame:
    rest = [c for c in decoded.columns if c not in ("_raw", "_corrupt", *EVENT_SCHEMA.fieldNames())]
    reason = F.when(F.col("_corrupt").isNotNull() | F.col("engine_id").isNull(), "malformed").otherwise("incomplete")
    return decoded.where(is_bad()).select(*rest, F.col("_raw").alias("raw"), reason.alias("reason"))


def event_from_tokens(
    lines: DataFrame,
    now_ms: Column,
    names: Sequence[str] = config.SENSORS,
    positions: Sequence[int] = config.SENSOR_POSITIONS,
    width: int = config.RAW_TOKENS,
) -> DataFrame:
    """Raw tokens to an event; lines that are too short or hold something else than numbers are left out.

    ``rejected_tokens`` has those lines. A line's tokens are made and parsed once: a filter on them would be put before the
    step that makes them, with a copy of that step for each token it asks for.
    """

    def event(t: Column) -> Column:
        whole, readings = _parsed(t, positions)
        return F.struct(
            S.engine_id(F.get(t, F.lit(0))).alias("engine_id"),
            whole.alias("cycle"),
            F.array(*readings).alias("readings"),
            _problem(t, positions, width).alias("problem"),
        )

    parsed = lines.select(now_ms.cast("long").alias("event_time_ms"), F.inline(F.transform(F.array("tokens"), event)))
    sensors = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.col("readings"))
    return parsed.where(F.col("problem").isNull()).select("engine_id", "cycle", "event_time_ms", sensors.alias("sensors"))


def _parsed(tokens: Column, positions: Sequence[int]) -> tuple[Column, list[Column]]:
    return F.get(tokens, F.lit(1)).try_cast("int"), [F.get(tokens, F.lit(p)).try_cast("double") for p in positions]


def _problem(tokens: Column, positions: Sequence[int], width: int) -> Column:
    cycle, readings = _parsed(tokens, positions)
    whole = cycle.isNotNull()
    for reading in readings:
        whole = whole & reading.isNotNull()
    return F.when(F.coalesce(F.size(tokens), F.lit(0)) < width, "incomplete").when(~whole, "malformed")


def token_problem(positions: Sequence[int] = config.SENSOR_POSITIONS, width: int = config.RAW_TOKENS) -> Column:
    """Why a line of tokens can't be an event, or null. Names the tokens once, however they are made."""
    return F.element_at(F.transform(F.array("tokens"), lambda t: _problem(t, positions, width)), 1)


def rejected_tokens(
    lines: DataFrame, positions: Sequence[int] = config.SENSOR_POSITIONS, width: int = config.RAW_TOKENS
) -> DataFrame:
    """Lines that ``event_from_tokens`` leaves out, for the quarantine: ``raw`` and ``reason``."""
    found = lines.withColumn("reason", token_problem(positions, width)).where(F.col("reason").isNotNull())
    return found.select(F.array_join("tokens", " ").alias("raw"), "reason")


def subscribe(df: DataFrame, topic: str = "topic") -> DataFrame:
    return df.where(F.col(topic).rlike(config.TOPIC_PATTERN))


def retain_newest(df: DataFrame, offset: str, n: int = config.STREAM_RETENTION, accuracy: int = 10_000) -> DataFrame:
    """The ``n`` rows with the highest offset (a whole number).

    A first read finds an offset that at least ``n`` rows reach, and not many more, from a sketch that is off by at most one
    in ``accuracy`` of all rows. It goes into the second read as a plain bound, by which files and row groups are skipped.
    """
    # Each share of the rows from the top that the sketch can tell apart from its neighbour, with room for its error.
    shares = [i / accuracy for i in range(2, 64)] + [2.0**-i for i in range(7, 0, -1)]
    cuts = F.percentile_approx(offset, [1 - share for share in shares], accuracy)
    told = df.agg(F.count(offset).alias("rows"), cuts.alias("cuts")).first()
    bound = next((cut for share, cut in zip(shares, told["cuts"] or []) if (share - 1 / accuracy) * told["rows"] >= n + 1), None)
    newest = df if bound is None else df.where(F.col(offset) >= F.lit(bound))
    return newest.orderBy(F.desc(offset)).limit(n)


def stream(
    spark: SparkSession,
    source: str,
    *,
    schema: T.StructType | None = None,
    path: str | None = None,
    per_trigger: int | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """An event stream. ``source`` is a file format or 'kafka'; the job on top of it is the same for both.

    ``per_trigger`` bounds one micro-batch (files, or offsets for Kafka). The source's position is kept in the
    query's checkpoint, so a bounded run repeated on the same checkpoint continues where the last one ended.
    """
    reader = spark.readStream.format(source)
    if source == "kafka":
        reader = reader.option("startingOffsets", "earliest")
        if per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    else:
        reader = reader.schema(schema)
        if per_trigger:
            reader = reader.option("maxFilesPerTrigger", per_trigger)
    for name, value in (options or {}).items():
        reader = reader.option(name, value)
    return reader.load(path) if path else reader.load()
