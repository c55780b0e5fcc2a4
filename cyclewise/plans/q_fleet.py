"""Registered queries: scoring, alerts, engine status, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewise import config
from cyclewise.functions import scalars as S
from cyclewise.operators import chunked, fleet, scoring, transform, windows
from cyclewise.plans.registry import query
from cyclewise.plans.views import READING_SENSORS, TELEMETRY_SENSORS, VERSION, Fleet
from cyclewise.sources import tables

HALF_DAY = 43_200


@query(
    "normalize",
    """SELECT arrival, least(greatest((CAST(value AS FLOAT) - v0) / CASE WHEN v1 = v0 THEN 1 ELSE v1 - v0 END, 0), 1) AS n_value,
              least(greatest((CAST(k AS FLOAT) - k0) / CASE WHEN k1 = k0 THEN 1 ELSE k1 - k0 END, 0), 1) AS n_k
       FROM telemetry, (SELECT CAST(min(value) AS FLOAT) AS v0, CAST(max(value) AS FLOAT) AS v1,
                               CAST(min(k) AS FLOAT) AS k0, CAST(max(k) AS FLOAT) AS k1
                        FROM telemetry WHERE ts < TIMESTAMP '2024-01-16')""",
)
def normalize(v: Fleet) -> DataFrame:
    """Bounds from the first half only, so later readings outside them are clamped."""
    bounds = transform.bounds_to_dict(transform.fit_scaler(v.reference_rows(), TELEMETRY_SENSORS))
    scaled = S.normalize_stream(F.array("value", F.col("k").cast("double")), bounds, TELEMETRY_SENSORS)
    return v.base().withColumn("n", scaled).select("arrival", F.col("n")[0].alias("n_value"), F.col("n")[1].alias("n_k"))


@query("risk_score", "SELECT arrival, remaining_cycles, failure_risk, risk_level FROM graded_rows")
def risk_score(v: Fleet) -> DataFrame:
    return v.graded_rows.select("arrival", "remaining_cycles", "failure_risk", "risk_level")


@query(
    "risk_score_live",
    """SELECT arrival, remaining_cycles, failure_risk,
              CASE WHEN failure_risk >= 0.8e0 THEN 'CRITICAL' WHEN failure_risk >= 0.6e0 THEN 'HIGH'
                   WHEN failure_risk >= 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, 1e0 AS confidence
       FROM (SELECT arrival, CAST(round_even(rul, 0) AS INTEGER) AS remaining_cycles,
                    round_even(greatest(0e0, least(1e0, 1e0 - rul / 125e0)), 3) AS failure_risk
             FROM (SELECT arrival, greatest(0e0, (k % 101) / 997e0 * 125e0) AS rul FROM telemetry))""",
)
def risk_score_live(v: Fleet) -> DataFrame:
    live = scoring.grade(v.base(), (F.col("k") % 101) / F.lit(997.0), round_first=True)
    return live.select("arrival", "remaining_cycles", "failure_risk", "risk_level", F.lit(1.0).alias("confidence"))


@query(
    "mc_confidence",
    """SELECT unit, round(avg(sample), 6) AS mean_score,
              round_even(greatest(0e0, least(1e0, 1e0 - 10e0 * stddev_pop(sample))), 3) AS confidence
       FROM (SELECT unit, 0.5e0 + k / 2000e0 AS sample, row_number() OVER (PARTITION BY unit ORDER BY cycle DESC) AS r
             FROM telemetry) WHERE r <= 30 GROUP BY unit""",
)
def mc_confidence(v: Fleet) -> DataFrame:
    """The last 30 rows of an engine stand for 30 sampled predictions."""
    last = chunked.last_n_per_key(v.base(), ["unit"], [F.desc("ts"), F.desc("arrival")], 30)
    samples = last.withColumn("sample", F.lit(0.5) + F.col("k") / F.lit(2000.0))
    return scoring.confidence(samples, "unit", "sample").withColumn("mean_score", F.round("mean_score", 6))


@query(
    "prediction_records",
    """SELECT engine_id, remaining_cycles, failure_risk, risk_level, 1e0 AS confidence,
              strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", 'v1' AS model_version FROM graded""",
)
def prediction_records(v: Fleet) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return scoring.prediction_records(v.latest, v.score(), F.lit(1.0), at, VERSION)


@query(
    "batch_predict_errors",
    """SELECT unit, CASE WHEN n >= 60 THEN remaining_cycles END AS remaining_cycles,
              CASE WHEN n >= 60 THEN failure_risk END AS failure_risk, CASE WHEN n >= 60 THEN risk_level END AS risk_level,
              CASE WHEN n < 60 THEN 'Expected shape (60, 2), got (' || n || ', 2)' END AS error
       FROM graded JOIN (SELECT unit, least(count(*), 60) AS n FROM telemetry GROUP BY unit) USING (unit)""",
)
def batch_predict_errors(v: Fleet) -> DataFrame:
    """Engines with fewer than 60 rows have a window of the wrong shape; they keep their row, with an error."""
    kept = chunked.last_n_per_key(v.base(), ["unit"], [F.desc("ts"), F.desc("arrival")], 60)
    row = F.struct("ts", "arrival", windows.sensor_row(TELEMETRY_SENSORS).alias("x"))
    window = F.transform(F.sort_array(F.collect_list(row)), lambda r: r["x"])
    requests = kept.groupBy("unit").agg(window.alias("window"), F.max_by("k", F.struct("ts", "arrival")).alias("k"))
    answers = scoring.with_shape_errors(requests, "window", v.score(), rows=60, width=2)
    return answers.select("unit", "remaining_cycles", "failure_risk", "risk_level", "error")


@query(
    "raw_window_scale",
    """SELECT unit, CASE WHEN bad = 0 THEN n_readings END AS n_readings, CASE WHEN bad = 0 THEN total END AS total,
              CASE WHEN bad > 0 THEN 'Missing required sensor keys: s4' END AS problem
       FROM (SELECT unit, CAST(count(*) AS INTEGER) AS n_readings, count(*) FILTER (s4 IS NULL) AS bad,
                    round(sum(CAST(CAST((CAST(CAST(s2 AS FLOAT) AS DOUBLE) - 10) / 90 AS FLOAT) AS DOUBLE)
                            + CAST(CAST((CAST(CAST(s3 AS FLOAT) AS DOUBLE) - 0) / 50 AS FLOAT) AS DOUBLE)
                            + CAST(CAST(CAST(CAST(s4 AS FLOAT) AS DOUBLE) - 7 AS FLOAT) AS DOUBLE)), 3) AS total
             FROM (SELECT r.*, CAST(substr(engine_id, 5) AS BIGINT) AS unit,
                          row_number() OVER (PARTITION BY engine_id ORDER BY cycle DESC) AS r
                   FROM (SELECT * REPLACE (CASE WHEN substr(engine_id, 5)::BIGINT % 3 = 0 THEN s4
                                           ELSE coalesce(s4, CAST(event_time_ms // 3600000 % 24 AS DOUBLE)) END AS s4) FROM readings) r)
             WHERE r <= 30 GROUP BY unit HAVING count(*) = 30)""",
)
def raw_window_scale(v: Fleet) -> DataFrame:
    """Raw windows of 30 readings: check the keys, scale without clamping; s4 has no spread (divisor 1). Only every third
    engine has readings that lack s4."""
    bounds = {"s2": (10.0, 100.0), "s3": (0.0, 50.0), "s4": (7.0, 7.0)}
    lacking = (F.col("unit") % 3 == 0) & (F.col("event_type") == "error")
    base = v.base().withColumns({"cycle": F.lit(0), "event_type": F.when(lacking, "error").otherwise("other")})
    kept = chunked.last_n_per_key(v.readings(base), ["engine_id"], [F.desc("arrival")], config.WINDOW_SIZE)
    window = F.transform(F.array_sort(F.collect_list(F.struct("arrival", F.map_entries("sensors").alias("m")))),
                         lambda r: F.map_from_entries(r["m"]))
    raw = kept.groupBy("engine_id").agg(window.alias("raw")).where(F.size("raw") == config.WINDOW_SIZE)
    problem = scoring.raw_window_problem(F.col("raw"), config.WINDOW_SIZE, READING_SENSORS)
    scaled = raw.withColumn("problem", problem).withColumn(
        "scaled",
        F.when(F.col("problem").isNull(), scoring.scale_raw_window(F.col("raw"), bounds, READING_SENSORS)),
    )
    total = F.aggregate(F.flatten("scaled"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return scaled.select(
        S.unit_of(F.col("engine_id")).cast("long").alias("unit"),
        F.size("scaled").alias("n_readings"),
        F.round(total, 3).alias("total"),
        "problem",
    ).withColumn("n_readings", F.when(F.col("problem").isNull(), F.col("n_readings")))


@query(
    "alerts",
    "SELECT engine_id, remaining_cycles, failure_risk, risk_level FROM graded WHERE risk_level IN ('HIGH', 'CRITICAL')",
)
def alerts(v: Fleet) -> DataFrame:
    return fleet.alerts(v.graded).select("engine_id", "remaining_cycles", "failure_risk", "risk_level")


@query(
    "top_at_risk",
    "SELECT engine_id, failure_risk, remaining_cycles FROM graded ORDER BY failure_risk DESC, engine_id LIMIT 15",
)
def top_at_risk(v: Fleet) -> DataFrame:
    return fleet.top_at_risk(v.graded.select("engine_id", "failure_risk", "remaining_cycles"))


@query(
    "fleet_search",
    "SELECT engine_id, risk_level FROM graded WHERE contains(lower(engine_id), 'eng-1') AND risk_level = 'MEDIUM'",
)
def fleet_search(v: Fleet) -> DataFrame:
    return fleet.search(v.graded, "Eng-1", "MEDIUM").select("engine_id", "risk_level")


@query(
    "risk_distribution",
    """SELECT risk_level, count(unit) AS engines
       FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) AS levels(risk_level) LEFT JOIN graded USING (risk_level)
       GROUP BY risk_level""",
)
def risk_distribution(v: Fleet) -> DataFrame:
    return fleet.risk_distribution(v.graded)


@query(
    "fleet_kpis",
    """SELECT count(*) AS active, count(*) FILTER (risk_level = 'CRITICAL') AS critical,
              count(*) FILTER (risk_level = 'HIGH') AS high,
              coalesce(CAST(floor(avg(remaining_cycles) + 0.5e0) AS BIGINT), 0) AS avg_rul,
              coalesce(CAST(floor(avg(cycle) + 0.5e0) AS BIGINT), 0) AS avg_cycle FROM graded""",
)
def fleet_kpis(v: Fleet) -> DataFrame:
    return fleet.kpis(v.graded)


def _meta(v: Fleet) -> DataFrame:
    return v.latest.select("engine_id", "cycle", "event_time_ms")


# Days for which an engine's row in the stand-in of the online store counts.
STORE_DAYS = 180


def _store(v: Fleet) -> DataFrame:
    """The orders as what a stream has written of each customer's engine; a row expires half a year after the newest of all."""
    times = S.epoch_millis(F.col("o_orderdate"))
    orders = v.table("orders").select(S.engine_id(F.col("o_custkey")).alias("engine_id"), times.alias("event_time_ms"))
    rows = orders.groupBy("engine_id").agg(F.count(F.lit(1)).alias("cycle"), F.max("event_time_ms").alias("event_time_ms"))
    now = orders.agg(F.max("event_time_ms").alias("now")).scalar()
    return fleet.active(rows.withColumn("updated_at_ms", F.col("event_time_ms")), now, STORE_DAYS * 86_400)


def _buffers(v: Fleet) -> DataFrame:
    """The events as readings pushed by the engines themselves."""
    pushed = F.least(F.count(F.lit(1)), F.lit(config.WINDOW_SIZE)).cast("int").alias("buffer_size")
    return v.base().groupBy("engine_id").agg(pushed)


@query(
    "telemetry_snapshot",
    """SELECT b.engine_id, coalesce(s.cycle, 0) AS cycle, coalesce(s.event_time_ms, 0) AS event_time_ms,
              CAST(30 AS INTEGER) AS window_size FROM buffers b LEFT JOIN order_store s USING (engine_id)""",
)
def telemetry_snapshot(v: Fleet) -> DataFrame:
    meta = _store(v).select("engine_id", "cycle", "event_time_ms", F.lit(config.WINDOW_SIZE).alias("window_size"))
    return fleet.telemetry_snapshot(_buffers(v).select("engine_id"), meta)


@query(
    "engine_status",
    """SELECT engine_id, CASE WHEN s.engine_id IS NOT NULL THEN 'redis_stream' ELSE 'push_buffer' END AS source,
              s.engine_id IS NOT NULL OR coalesce(b.buffer_size, 0) >= 30 AS ready,
              g.remaining_cycles AS last_remaining_cycles, g.risk_level AS last_risk_level
       FROM buffers b FULL JOIN order_store s USING (engine_id) LEFT JOIN graded g USING (engine_id)""",
)
def engine_status(v: Fleet) -> DataFrame:
    """Engines that only the store knows have no prediction, those that never pushed no buffer."""
    return fleet.engine_status(_buffers(v), _store(v), v.graded).orderBy("engine_id")


@query("engine_union", "SELECT engine_id FROM buffers UNION SELECT engine_id FROM order_store")
def engine_union(v: Fleet) -> DataFrame:
    return fleet.engine_union(_buffers(v), _store(v))


@query("engines_semi", "SELECT engine_id, buffer_size FROM buffers WHERE engine_id IN (SELECT engine_id FROM order_store)")
def engines_semi(v: Fleet) -> DataFrame:
    return _buffers(v).join(_store(v), "engine_id", "left_semi")


@query("engines_anti", "SELECT engine_id, buffer_size FROM buffers WHERE engine_id NOT IN (SELECT engine_id FROM order_store)")
def engines_anti(v: Fleet) -> DataFrame:
    return _buffers(v).join(_store(v), "engine_id", "left_anti")


@query(
    "active_engines_ttl",
    "SELECT engine_id, event_time_ms AS updated_at_ms FROM engine_meta, latest_time WHERE event_time_ms >= now_ms - 3600000",
)
def active_engines_ttl(v: Fleet) -> DataFrame:
    rows = _meta(v).select("engine_id", F.col("event_time_ms").alias("updated_at_ms"))
    return fleet.active(rows, v.now_ms())


@query(
    "online_read",
    """SELECT engine_id, max(cycle) AS cycle, CAST(60 AS INTEGER) AS n_values,
              round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE) + k), 3) AS total
       FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY cycle DESC) AS r FROM telemetry)
       WHERE r <= 30 AND engine_id IN (SELECT engine_id FROM store) GROUP BY engine_id HAVING count(*) = 30""",
)
def online_read(v: Fleet) -> DataFrame:
    """Engines with a full, unexpired feature vector."""
    kept = chunked.last_n_per_key(v.base(), ["engine_id"], [F.desc("ts"), F.desc("arrival")], config.WINDOW_SIZE)
    row = F.struct("ts", "arrival", windows.sensor_row(TELEMETRY_SENSORS).alias("x"))
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["x"]))
    vectors = kept.groupBy("engine_id").agg(flat.alias("features"))
    store = _meta(v).join(vectors, "engine_id").withColumn("updated_at_ms", F.col("event_time_ms"))
    found = tables.online_features(store, config.WINDOW_SIZE, len(TELEMETRY_SENSORS), v.now_ms(), HALF_DAY)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select("engine_id", "cycle", F.size("features").alias("n_values"), F.round(total, 3).alias("total"))


@query(
    "alert_dedup",
    """SELECT engine_id, risk_level, failure_risk, remaining_cycles, event_time_ms, false AS acknowledged
       FROM risky WHERE ts >= TIMESTAMP '2024-01-16'
         AND engine_id NOT IN (SELECT engine_id FROM raised WHERE NOT acknowledged)
       QUALIFY row_number() OVER (PARTITION BY engine_id ORDER BY arrival) = 1""",
)
def alert_dedup(v: Fleet) -> DataFrame:
    batch = fleet.at_or_above(scoring.grade(v.current_rows(), v.score())).select(
        "engine_id", "risk_level", "failure_risk", "remaining_cycles", "event_time_ms", "arrival"
    )
    return fleet.new_alerts(batch, v.raised).drop("arrival")


@query(
    "open_alerts",
    """SELECT id, engine_id, acknowledged, NOT acknowledged
                AND row_number() OVER (PARTITION BY acknowledged ORDER BY event_time_ms DESC, engine_id) <= 8 AS shown
       FROM (SELECT engine_id || '-' || CAST(event_time_ms AS VARCHAR) AS id, * FROM raised
             ORDER BY event_time_ms DESC, engine_id LIMIT 50)""",
)
def open_alerts(v: Fleet) -> DataFrame:
    """The newest 50 alerts, with a mark on the 8 that the panel shows."""
    rows = v.raised.withColumn("timestamp", F.col("event_time_ms")).withColumn(
        "id", fleet.alert_id(F.col("engine_id"), F.col("event_time_ms").cast("string"))
    )
    shown = fleet.unacknowledged(rows).select(F.col("id").alias("shown_id"))
    newest = fleet.keep_newest(rows).join(shown, F.col("id") == F.col("shown_id"), "left")
    return newest.select("id", "engine_id", "acknowledged", F.col("shown_id").isNotNull().alias("shown"))


@query(
    "key_strings",
    """SELECT arrival, 'engine:' || engine_id || ':features' AS feature_key, 'engine:' || engine_id || ':meta' AS meta_key,
              engine_id AS parsed, CAST(unit AS VARCHAR) AS label, engine_id || '-' || CAST(event_time_ms AS VARCHAR) AS alert_id,
              printf('%.1f%%', failure_risk * 100) AS risk_text
       FROM graded_rows""",
)
def key_strings(v: Fleet) -> DataFrame:
    engine = F.col("engine_id")
    return v.graded_rows.select(
        "arrival",
        S.store_key(engine, "features").alias("feature_key"),
        S.store_key(engine, "meta").alias("meta_key"),
        S.engine_of_key(S.store_key(engine, "buffer")).alias("parsed"),
        S.unit_of(engine).alias("label"),
        fleet.alert_id(engine, F.col("event_time_ms").cast("string")).alias("alert_id"),
        F.format_string("%.1f%%", F.col("failure_risk") * 100).alias("risk_text"),
    )
