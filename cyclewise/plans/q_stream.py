"""Registered queries: streaming jobs over the event table, run until all input is taken.

Each job writes below the shared folder and the query reads the result back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclewise import config, shared
from cyclewise.operators import fleet, scoring
from cyclewise.plans.q_monitor import grid_sql
from cyclewise.plans.registry import query
from cyclewise.plans.views import HUNDREDTHS, READING_SENSORS, TELEMETRY_SENSORS, Fleet, hundredths
from cyclewise.sources import events as E
from cyclewise.sources import log
from cyclewise.streaming import jobs, sinks, state

# In the stream with late readings, every ninth one comes with a cycle number this far back.
SET_BACK = 2_000
BOUNDS = {"s2": (0.0, 100.0), "s3": (10.0, 90.0), "s4": (0.0, 23.0)}


def event_stream(v: Fleet, path: str | None = None, per_trigger: int = 256) -> DataFrame:
    """The event table as a stream; a micro-batch takes at most ``per_trigger`` files."""
    schema = v.table("events").schema
    # A pattern, because the table may be one file or a folder of files; a stream takes a plain path only for a folder.
    path = path or f"{v.dir}/event[s].parquet"
    return E.stream(v.spark, "parquet", schema=schema, path=path, per_trigger=per_trigger)


def reading_rows(rows: DataFrame) -> DataFrame:
    x = F.array(*[F.col(s).cast("float") for s in TELEMETRY_SENSORS])
    return rows.select("engine_id", "cycle", "event_time_ms", "arrival", x.alias("x"))


def in_order(v: Fleet, events: DataFrame) -> DataFrame:
    """A stream whose cycle is the arrival number: nothing is late."""
    return reading_rows(v.base(events).withColumn("cycle", F.col("arrival")))


def late(v: Fleet, events: DataFrame) -> DataFrame:
    back = F.when(F.col("arrival") % 9 == 0, SET_BACK).otherwise(0)
    return reading_rows(v.base(events).withColumn("cycle", F.col("arrival") - back))


_KEPT = f"""
  SELECT engine_id, unit, cycle, arrival, event_time_ms, value, k
  FROM (SELECT *, max(cycle) OVER (PARTITION BY unit ORDER BY arrival
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
        FROM (SELECT * REPLACE (arrival - CASE WHEN arrival % 9 = 0 THEN {SET_BACK} ELSE 0 END AS cycle) FROM telemetry))
  WHERE seen IS NULL OR cycle > seen"""
_LATE_VECTORS = f"""
  SELECT engine_id, cycle, event_time, {HUNDREDTHS.format('f')} AS features
  FROM (SELECT engine_id, cycle, event_time_ms AS event_time,
               list([value, k]) OVER (PARTITION BY unit ORDER BY arrival ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS f FROM ({_KEPT}))
  WHERE len(f) = 30"""


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select("engine_id", "cycle", "event_time", hundredths(F.col("features")).alias("features"))


@query("stream_source", "SELECT event_id, event_type, value FROM events")
def stream_source(v: Fleet) -> DataFrame:
    """Two bounded runs on one checkpoint: the second finds nothing new."""
    out, checkpoint = shared.scratch(v.spark, "stream-source"), shared.scratch(v.spark, "checkpoint")
    for _ in range(2):
        rows = event_stream(v).select("event_id", "event_type", "value")
        jobs.run_bounded(rows.writeStream.format("parquet").option("path", out), checkpoint)
    return v.spark.read.parquet(out)


@query(
    "stream_normalize",
    """SELECT arrival, CAST(arrival AS INTEGER) AS cycle, least(greatest(CAST(s2 AS FLOAT) / 100::FLOAT, 0), 1) AS n2,
              least(greatest((CAST(s3 AS FLOAT) - 10) / 80::FLOAT, 0), 1) AS n3,
              least(greatest(coalesce(CAST(s4 AS FLOAT), 0) / 23::FLOAT, 0), 1) AS n4
       FROM readings""",
)
def stream_normalize(v: Fleet) -> DataFrame:
    """JSON messages in, scaled readings out."""
    rows = v.readings(v.base(event_stream(v)).withColumn("cycle", F.col("arrival")))
    messages = rows.select("arrival", E.encode(rows).alias("value"))
    scaled = jobs.normalized(messages, BOUNDS, READING_SENSORS)
    out = shared.scratch(v.spark, "stream-normalize")
    jobs.run_bounded(scaled.writeStream.format("parquet").option("path", out), shared.scratch(v.spark, "checkpoint"))
    parts = [F.col("x")[i].alias(f"n{s[1:]}") for i, s in enumerate(READING_SENSORS)]
    return v.spark.read.parquet(out).select("arrival", "cycle", *parts)


def _rolling(v: Fleet, size: int, **options) -> jobs.RollingFeatures:
    path = shared.scratch(v.spark, "rolling")
    return jobs.RollingFeatures(v.spark, path, len(TELEMETRY_SENSORS), size, **options)


@query("stream_rolling", _LATE_VECTORS)
def stream_rolling(v: Fleet) -> DataFrame:
    job = _rolling(v, config.WINDOW_SIZE)
    jobs.run_bounded(job.writer(late(v, event_stream(v))), shared.scratch(v.spark, "checkpoint"))
    return _vectors(job.vectors())


@query("stream_rolling_state", _LATE_VECTORS)
def stream_rolling_state(v: Fleet) -> DataFrame:
    """The same vectors from the stream itself into a table, without a call for each batch; small batches."""
    vectors = state.rolling_vectors(late(v, event_stream(v, per_trigger=16)), len(TELEMETRY_SENSORS), config.WINDOW_SIZE)
    out = shared.scratch(v.spark, "rolling-state")
    jobs.run_bounded(vectors.writeStream.format("parquet").option("path", out), shared.scratch(v.spark, "checkpoint"))
    return _vectors(v.spark.read.parquet(out))


@query("stream_restart", _LATE_VECTORS)
def stream_restart(v: Fleet) -> DataFrame:
    """Run over the first half of the events, stop, add the second half, go on with a new query object."""
    source, checkpoint = shared.scratch(v.spark, "events"), shared.scratch(v.spark, "checkpoint")
    events = v.table("events")
    before = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    job = _rolling(v, config.WINDOW_SIZE)
    for half in (events.where(before), events.where(~before)):
        half.write.mode("append").parquet(source)
        again = jobs.RollingFeatures(v.spark, job.path, job.width, job.size)
        jobs.run_bounded(again.writer(late(v, event_stream(v, source))), checkpoint)
    return _vectors(job.vectors())


@query(
    "stream_counters",
    f"""SELECT (SELECT count(*) FROM telemetry) AS processed, CAST(sum(n) AS BIGINT) AS accepted,
               CAST(sum(greatest(0, n - 29)) AS BIGINT) AS emitted, count(*) AS engines
        FROM (SELECT unit, count(*) AS n FROM ({_KEPT}) GROUP BY unit)""",
)
def stream_counters(v: Fleet) -> DataFrame:
    """Counted as the rows pass, without jobs of their own."""
    job = _rolling(v, config.WINDOW_SIZE)
    with jobs.Counters(v.spark) as counters:
        jobs.run_bounded(job.writer(late(v, event_stream(v))), shared.scratch(v.spark, "checkpoint"))
    return counters.table(*job.COUNTERS)


# Messages in a poll of the log that is read to its end, for small tables, and partitions of the other one.
POLL = 2_000
PARTITIONS = 8
# What one poll of a large table may hold at most: without state, and with state, where each poll goes through its engines once.
MOST_PULLED, MOST_ROLLED = 500_000, 5_000_000


def poll_rows(messages: int, polls: int, least: int, most: int) -> int:
    """So many messages in a poll that ``polls`` of them take all, within bounds: a poll costs the same however few it takes."""
    return max(least, min(most, -(-messages // polls)))


@query("stream_pull", "SELECT event_id, user_id, event_type, value FROM events")
def stream_pull(v: Fleet) -> DataFrame:
    """Poll a log for a bounded number of messages at a time, stop half-way, and go on from the position kept."""
    path, out, checkpoint = (shared.scratch(v.spark, name) for name in ("log", "pulled", "checkpoint"))
    events = v.table("events")
    names = ("event_id", "user_id", "event_type", "value")
    size = poll_rows(events.count(), 16, POLL, MOST_PULLED)
    for half in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1):
        log.append(events.where(half), path, 1, "user_id", ["event_id"])
        rows = log.polled(v.spark, path, events.select(*names).schema, size)
        jobs.run_until_done(rows.writeStream.format("parquet").option("path", out), checkpoint)
    return v.spark.read.parquet(out)


@query(
    "stream_log_resume",
    f"""SELECT engine_id, cycle, event_time, {HUNDREDTHS.format('f')} AS features
        FROM (SELECT engine_id, arrival AS cycle, event_time_ms AS event_time,
                     list([value, k]) OVER (PARTITION BY unit ORDER BY arrival ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS f
              FROM telemetry)
        WHERE len(f) = 30""",
)
def stream_log_resume(v: Fleet) -> DataFrame:
    """Rolling windows over a log of eight partitions. The order of an engine's messages is that of the offsets in its
    partition; the run is stopped after the first half and resumed by new objects."""
    path, out, checkpoint = (shared.scratch(v.spark, name) for name in ("log", "rolling", "checkpoint"))
    events = v.table("events")
    schema = T.StructType([*events.schema, T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType())])
    middle, total = events.agg((F.max("event_id") / 2).cast("long"), F.count(F.lit(1))).first()
    before = F.col("event_id") < F.lit(middle)
    size = poll_rows(total, 2, PARTITIONS * POLL, MOST_ROLLED)
    for half in (before, ~before):
        log.append(events.where(half), path, PARTITIONS, "user_id", ["event_id"])
        messages = log.polled(v.spark, path, schema, size)
        rows = reading_rows(v.base(messages, "offset").withColumns({"cycle": F.col("arrival"), "arrival": F.col("offset")}))
        job = jobs.RollingFeatures(v.spark, out, len(TELEMETRY_SENSORS))
        jobs.run_until_done(job.writer(rows), checkpoint)
    return _vectors(job.vectors())


# An engine that sends nothing for so many seconds is silent.
SILENT = 43_200


@query(
    "stream_absence",
    f"""SELECT engine_id, event_time_ms AS last_ms, event_time_ms + {SILENT}000 AS silent_ms
        FROM (SELECT *, lead(event_time_ms) OVER (PARTITION BY engine_id ORDER BY event_time_ms) AS next FROM telemetry), latest_time
        WHERE coalesce(next, now_ms) > event_time_ms + {SILENT}000""",
)
def stream_absence(v: Fleet) -> DataFrame:
    """Engines told silent by a timer each time that twelve hours of the stream's time pass without an event."""
    events = v.base(event_stream(v)).select("engine_id", F.timestamp_millis("event_time_ms").alias("event_time"))
    out = shared.scratch(v.spark, "silences")
    silent = state.silences(events, SILENT)
    jobs.run_bounded(silent.writeStream.format("parquet").option("path", out), shared.scratch(v.spark, "checkpoint"))
    return v.spark.read.parquet(out)


@query(
    "stream_sustained",
    f"""SELECT step, CAST(n AS BIGINT) AS n FROM (
          SELECT step, n, min(CAST(n > 10 AS INTEGER)) OVER w AS held, count(*) OVER w AS seen FROM ({grid_sql(3600)})
          WINDOW w AS (ORDER BY step RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)), latest_time
        WHERE held = 1 AND seen = 3 AND step * 1000 < now_ms""",
)
def stream_sustained(v: Fleet) -> DataFrame:
    """The rule of ``sustained_alert`` as a live state: hours at which it fires, each as soon as it has passed."""
    events = v.base(event_stream(v)).select(F.lit("all").alias("label"), F.col("ts").cast("timestamp").alias("event_time"))
    out = shared.scratch(v.spark, "rule")
    states = state.rule_states(events, step=3600, span=3600, limit=10, hold=7200)
    jobs.run_bounded(states.writeStream.format("parquet").option("path", out), shared.scratch(v.spark, "checkpoint"))
    return v.spark.read.parquet(out).where("state = 'firing'").select("step", "n")


_LAST_VECTORS = f"""
  SELECT engine_id, arrival AS cycle, event_time_ms AS event_time, {HUNDREDTHS.format('f')} AS features
  FROM (SELECT *, list([value, k]) OVER (PARTITION BY unit ORDER BY arrival ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS f,
               row_number() OVER (PARTITION BY unit ORDER BY arrival DESC) AS r FROM telemetry)
  WHERE len(f) = 30"""


@query("online_upsert", f"SELECT engine_id, cycle, event_time, features FROM ({_LAST_VECTORS} AND r = 1)")
def online_upsert(v: Fleet) -> DataFrame:
    store = jobs.OnlineStore(v.spark, shared.scratch(v.spark, "online"))
    job = _rolling(v, config.WINDOW_SIZE, on_vectors=store)
    jobs.run_bounded(job.writer(in_order(v, event_stream(v))), shared.scratch(v.spark, "checkpoint"))
    return _vectors(store.read())


@query(
    "offline_sink",
    f"""SELECT engine_id, cycle, strftime(make_timestamp(event_time * 1000), '%Y-%m-%d') AS date,
               strftime(make_timestamp(event_time * 1000), '%H') AS hour, features FROM ({_LAST_VECTORS})""",
)
def offline_sink(v: Fleet) -> DataFrame:
    out = shared.scratch(v.spark, "offline")
    job = _rolling(v, config.WINDOW_SIZE, on_vectors=lambda rows, batch: sinks.write_offline(rows, out, batch))
    jobs.run_bounded(job.writer(in_order(v, event_stream(v))), shared.scratch(v.spark, "checkpoint"))
    schema = job.VECTORS + ", date string, hour string, batch long"
    rows = v.spark.read.schema(schema).parquet(out)
    return rows.select("engine_id", "cycle", "date", "hour", hundredths(F.col("features")).alias("features"))


@query(
    "stream_fanout",
    f"""SELECT engine_id, count(*) AS offline_vectors, CAST(sum(cycle) AS BIGINT) AS offline_cycles, max(cycle) AS online_cycle,
               arg_max(features, cycle) AS online_features FROM ({_LAST_VECTORS}) GROUP BY engine_id""",
)
def stream_fanout(v: Fleet) -> DataFrame:
    """Each batch of vectors goes whole to the online and to the offline table, there under its date and hour."""
    out = shared.scratch(v.spark, "offline")
    store = jobs.OnlineStore(v.spark, shared.scratch(v.spark, "online"))
    both = jobs.fan_out(store, lambda rows, batch: sinks.write_offline(rows, out, batch))
    job = _rolling(v, config.WINDOW_SIZE, on_vectors=both)
    jobs.run_bounded(job.writer(in_order(v, event_stream(v))), shared.scratch(v.spark, "checkpoint"))
    offline = sinks.read_or_empty(v.spark, out, job.VECTORS + ", date string, hour string, batch long")
    per_engine = offline.groupBy("engine_id").agg(
        F.count(F.lit(1)).alias("offline_vectors"), F.sum("cycle").alias("offline_cycles")
    )
    features = hundredths(F.col("features")).alias("online_features")
    online = store.read().select("engine_id", F.col("cycle").alias("online_cycle"), features)
    return per_engine.join(online, "engine_id")


@query(
    "stream_predictions",
    """SELECT 'prediction' AS kind, engine_id, remaining_cycles, failure_risk, risk_level FROM graded
       WHERE unit IN (SELECT unit FROM telemetry GROUP BY unit HAVING count(*) >= 30)
       UNION ALL SELECT 'alert', engine_id, remaining_cycles, failure_risk, risk_level FROM graded
       WHERE unit IN (SELECT unit FROM telemetry GROUP BY unit HAVING count(*) >= 30) AND risk_level IN ('HIGH', 'CRITICAL')""",
)
def stream_predictions(v: Fleet) -> DataFrame:
    """Vectors to the online store, then predictions and alerts of the fleet; the last reading is the score."""
    store = jobs.OnlineStore(v.spark, shared.scratch(v.spark, "online"))
    path = shared.scratch(v.spark, "fleet")
    snapshots = jobs.FleetSnapshots(store, path, lambda x: F.element_at(x, -1).cast("int") % 101 / F.lit(100.0))
    job = _rolling(v, config.WINDOW_SIZE, on_vectors=snapshots)
    jobs.run_bounded(job.writer(in_order(v, event_stream(v))), shared.scratch(v.spark, "checkpoint"))
    columns = ("engine_id", "remaining_cycles", "failure_risk", "risk_level")
    newest = {}
    for kind in ("prediction", "alert"):
        rows = v.spark.read.parquet(f"{path}/{kind}s").withColumn("kind", F.lit(kind))
        last = rows.agg(F.max("batch").alias("b")).scalar()
        newest[kind] = rows.where(F.col("batch") == last).select("kind", *columns)
    return newest["prediction"].unionAll(newest["alert"])


def _graded_stream(v: Fleet, path: str | None = None) -> DataFrame:
    return scoring.grade(v.base(event_stream(v, path)), v.score())


@query("stream_alerts", "SELECT arrival, engine_id, risk_level, failure_risk FROM risky")
def stream_alerts(v: Fleet) -> DataFrame:
    """Each batch's risky predictions as one alert snapshot."""
    out = shared.scratch(v.spark, "alerts")
    job = jobs.each_batch(_graded_stream(v), lambda rows, batch: sinks.write_batch(fleet.at_or_above(rows, "HIGH"), out, batch))
    jobs.run_bounded(job, shared.scratch(v.spark, "checkpoint"))
    return v.spark.read.parquet(f"{out}/batch=*").select("arrival", "engine_id", "risk_level", "failure_risk")


@query(
    "stream_alert_dedup",
    """SELECT engine_id, risk_level, failure_risk, remaining_cycles, event_time_ms, false AS acknowledged FROM risky
       QUALIFY row_number() OVER (PARTITION BY engine_id ORDER BY arrival) = 1""",
)
def stream_alert_dedup(v: Fleet) -> DataFrame:
    """Two runs over the two halves of the events; the second raises nothing for engines that are open."""
    source, checkpoint = shared.scratch(v.spark, "events"), shared.scratch(v.spark, "checkpoint")
    events = v.table("events")
    before = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    book = jobs.AlertBook(v.spark, shared.scratch(v.spark, "alert-book"))
    for half in (events.where(before), events.where(~before)):
        half.write.mode("append").parquet(source)
        jobs.run_bounded(book.writer(_graded_stream(v, source)), checkpoint)
    return book.read()


@query(
    "stream_expiry",
    """SELECT engine_id, remaining_cycles, risk_level FROM graded, latest_time
       WHERE unit IN (SELECT unit FROM telemetry GROUP BY unit HAVING count(*) >= 30) AND event_time_ms >= now_ms - 43200000""",
)
def stream_expiry(v: Fleet) -> DataFrame:
    """Predictions of the engines that were heard of in the last twelve hours; here the readings' time is the clock."""
    store = jobs.OnlineStore(v.spark, shared.scratch(v.spark, "online"), clock=F.col("event_time"), ttl=43_200)
    path = shared.scratch(v.spark, "fleet")
    score = lambda x: F.element_at(x, -1).cast("int") % 101 / F.lit(100.0)
    snapshots = jobs.FleetSnapshots(store, path, score, now_ms=v.now_ms())
    job = _rolling(v, config.WINDOW_SIZE, on_vectors=snapshots)
    jobs.run_bounded(job.writer(in_order(v, event_stream(v))), shared.scratch(v.spark, "checkpoint"))
    rows = v.spark.read.parquet(f"{path}/predictions")
    newest = rows.agg(F.max("batch").alias("b")).scalar()
    return rows.where(F.col("batch") == newest).select("engine_id", "remaining_cycles", "risk_level")


@query(
    "stream_ack",
    """SELECT engine_id, risk_level, failure_risk, event_time_ms, half = 1 AND unit % 2 = 0 AS acknowledged FROM (
         SELECT * FROM firsts WHERE half = 1
         UNION ALL SELECT * FROM firsts f WHERE half = 2
           AND (unit % 2 = 0 OR NOT EXISTS (SELECT 1 FROM firsts g WHERE g.half = 1 AND g.unit = f.unit)))""".replace(
        "firsts",
        """(SELECT *, 1 + CAST(ts >= TIMESTAMP '2024-01-16' AS INTEGER) AS half FROM risky
            QUALIFY row_number() OVER (PARTITION BY engine_id, ts >= TIMESTAMP '2024-01-16' ORDER BY arrival) = 1)""",
    ),
)
def stream_ack(v: Fleet) -> DataFrame:
    """Between the two halves of the events, engines with an even number acknowledge: these alert again."""
    source, checkpoint = shared.scratch(v.spark, "events"), shared.scratch(v.spark, "checkpoint")
    events = v.table("events")
    before = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    book = jobs.AlertBook(v.spark, shared.scratch(v.spark, "alert-book"))
    for half in (before, ~before):
        events.where(half).write.mode("append").parquet(source)
        if half is not before:
            book.acknowledge(book.read().where(F.substring_index("engine_id", "-", -1).cast("int") % 2 == 0))
        jobs.run_bounded(book.writer(_graded_stream(v, source)), checkpoint)
    return book.read().select("engine_id", "risk_level", "failure_risk", "event_time_ms", "acknowledged")


@query(
    "stream_quarantine",
    """SELECT CASE WHEN arrival % 100 = 0 THEN 'malformed' WHEN arrival % 100 = 50 THEN 'incomplete' ELSE 'good' END AS kind, arrival
       FROM telemetry""",
)
def stream_quarantine(v: Fleet) -> DataFrame:
    """Every message of the stream is either handed on or kept with the reason why not."""
    rows = v.readings(v.base(event_stream(v)).withColumn("cycle", F.col("arrival")))
    cut = F.concat(F.lit("{bad "), F.col("engine_id"))
    lacking = F.to_json(F.struct("engine_id", "event_time_ms", "sensors"))
    slot = F.col("arrival") % 100
    messages = rows.select("arrival", F.when(slot == 0, cut).when(slot == 50, lacking).otherwise(E.encode(rows)).alias("value"))
    kept, good = shared.scratch(v.spark, "quarantine"), shared.scratch(v.spark, "good")
    job = jobs.Quarantine(kept, BOUNDS, lambda df, batch: sinks.write_batch(df, good, batch), READING_SENSORS)
    jobs.run_bounded(jobs.each_batch(messages, job), shared.scratch(v.spark, "checkpoint"))
    bad = v.spark.read.parquet(f"{kept}/batch=*").select(F.col("reason").alias("kind"), "arrival")
    return bad.unionAll(v.spark.read.parquet(f"{good}/batch=*").select(F.lit("good"), "arrival"))
