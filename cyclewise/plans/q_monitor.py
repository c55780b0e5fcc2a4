"""Registered queries: sensor drift, metric series and alert rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cyclewise import config
from cyclewise.operators import drift, metrics, transform
from cyclewise.plans.registry import query
from cyclewise.plans.views import TELEMETRY_SENSORS, Fleet

_KS = """
  SELECT sensor, n_ref, n_cur, max(abs(fa / n_ref - fb / n_cur)) AS d
  FROM (SELECT DISTINCT sensor, x, n_ref, n_cur,
               CAST(sum(a) OVER upto AS DOUBLE) AS fa, CAST(sum(b) OVER upto AS DOUBLE) AS fb
        FROM (SELECT *, CAST(sum(a) OVER (PARTITION BY sensor) AS BIGINT) AS n_ref,
                     CAST(sum(b) OVER (PARTITION BY sensor) AS BIGINT) AS n_cur
              FROM (SELECT sensor, x, CAST(ts < TIMESTAMP '2024-01-16' AS INTEGER) AS a,
                           CAST(ts >= TIMESTAMP '2024-01-16' AS INTEGER) AS b
                    FROM (SELECT 'value' AS sensor, value AS x, ts FROM telemetry
                          UNION ALL SELECT 'k', CAST(k AS DOUBLE), ts FROM telemetry) WHERE x IS NOT NULL))
        WINDOW upto AS (PARTITION BY sensor ORDER BY x RANGE UNBOUNDED PRECEDING))
  GROUP BY sensor, n_ref, n_cur"""
_KS_P = f"""
  SELECT sensor, d, CASE WHEN l < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101),
           lambda i: CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2e0 * i * i * l * l))))) END AS p
  FROM (SELECT *, sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) * d AS l FROM ({_KS}))"""


@query("drift_ks", f"SELECT sensor, n_ref, n_cur, round(d, 9) AS d FROM ({_KS})")
def drift_ks(v: Fleet) -> DataFrame:
    return drift.ks_of(v.drift_halves(), TELEMETRY_SENSORS).withColumn("d", F.round("d", 9))


@query("drift_pvalue", f"SELECT sensor, round(d, 9) AS d, round(p, 6) AS p_value, p < 0.05 AS drifted FROM ({_KS_P})")
def drift_pvalue(v: Fleet) -> DataFrame:
    table = drift.judged(drift.ks_of(v.drift_halves(), TELEMETRY_SENSORS))
    return table.select("sensor", F.round("d", 9).alias("d"), F.round("p_value", 6).alias("p_value"), "drifted")


@query(
    "drift_summary",
    f"""SELECT share > 0.3 AS drift_detected, round_even(share, 4) AS drift_share, names AS drifted_features,
               CAST(2 AS INTEGER) AS total_features, '' AS missing_features,
               CASE WHEN share > 0.5 THEN 'CRITICAL' WHEN share > 0.3 THEN 'WARNING' ELSE 'OK' END AS alert_level
        FROM (SELECT count(*) FILTER (p < 0.05) / 2e0 AS share,
                     coalesce(string_agg(sensor, ',' ORDER BY sensor) FILTER (p < 0.05), '') AS names FROM ({_KS_P}))
        WHERE (SELECT count(*) FROM telemetry WHERE ts >= TIMESTAMP '2024-01-16') >= 100""",
)
def drift_summary(v: Fleet) -> DataFrame:
    return drift.summary_of(v.drift_halves(), TELEMETRY_SENSORS)


_BOUNDS = ", ".join(f"('{b}')" for b in (*config.RUL_BUCKETS, "inf"))
_HIST = f"""
  SELECT event_type, le, count(*) FILTER (value <= le) AS cum_count
  FROM events, (SELECT CAST(b AS DOUBLE) AS le FROM (VALUES {_BOUNDS}) AS t(b)) GROUP BY event_type, le"""


def _histogram(v: Fleet) -> DataFrame:
    found = metrics.bucket_counts(v.table("events"), F.col("value"), config.RUL_BUCKETS, F.col("event_type"))
    return found.withColumnRenamed("_by0", "event_type")


@query("metric_histogram", f"SELECT event_type, CAST(le AS VARCHAR) AS le, cum_count FROM ({_HIST})")
def metric_histogram(v: Fleet) -> DataFrame:
    le = F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string"))
    return _histogram(v).withColumn("le", le)


@query(
    "risk_histogram",
    f"""SELECT b AS le, count(*) FILTER (failure_risk <= CAST(b AS DOUBLE)) AS cum_count
        FROM graded_rows CROSS JOIN (VALUES {", ".join(f"('{b}')" for b in (*config.SHARE_BUCKETS, "inf"))}) AS t(b) GROUP BY b""",
)
def risk_histogram(v: Fleet) -> DataFrame:
    found = metrics.bucket_counts(v.graded_rows, F.col("failure_risk"), config.SHARE_BUCKETS)
    return found.withColumn("le", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")))


def _quantile_sql(q: float) -> str:
    return f"""
  SELECT event_type, {q} AS q, arg_min(CASE WHEN le = 'inf'::DOUBLE THEN top
           ELSE lo + (le - lo) * CASE WHEN cum_count = lo_count THEN 1 ELSE ({q}e0 * total - lo_count) / (cum_count - lo_count) END END, le) AS quantile
  FROM (SELECT *, max(cum_count) OVER (PARTITION BY event_type) AS total,
               max(le) FILTER (le <> 'inf'::DOUBLE) OVER (PARTITION BY event_type) AS top,
               coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), CASE WHEN le > 0 THEN 0 ELSE le END) AS lo,
               coalesce(lag(cum_count) OVER (PARTITION BY event_type ORDER BY le), 0) AS lo_count FROM ({_HIST}))
  WHERE cum_count >= {q}e0 * total AND total > 0 GROUP BY event_type"""


@query(
    "histogram_quantile",
    f"""SELECT event_type, CAST(q AS DOUBLE) AS q, round(quantile, 6) AS quantile
        FROM ({" UNION ALL ".join(_quantile_sql(q) for q in (0.5, 0.9, 0.95, 0.99))})""",
)
def histogram_quantile(v: Fleet) -> DataFrame:
    found = metrics.quantiles(_histogram(v), (0.5, 0.9, 0.95, 0.99), "event_type")
    return found.withColumn("quantile", F.round("quantile", 6))


@query(
    "metric_counters",
    """SELECT engine_id, risk_level, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors
       FROM graded_rows GROUP BY engine_id, risk_level""",
)
def metric_counters(v: Fleet) -> DataFrame:
    return v.graded_rows.groupBy("engine_id", "risk_level").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors")
    )


def grid_sql(step: int, label: str = "'all'") -> str:
    end = f"CAST(ceil(epoch_us(ts) / {step}e6) * {step} AS BIGINT)"
    return f"""
  SELECT label, step, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT {label} AS label FROM events)
       CROSS JOIN (SELECT unnest(generate_series(min({end}), max({end}), {step})) AS step FROM events)
  LEFT JOIN (SELECT {label} AS label, {end} AS step, count(*) AS n FROM events GROUP BY 1, 2) USING (label, step)"""


@query(
    "metric_rate",
    f"""SELECT step, round(sum(n) OVER (ORDER BY step RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) / 3600e0, 9) AS rate
        FROM ({grid_sql(300)})""",
)
def metric_rate(v: Fleet) -> DataFrame:
    """Events per second over the last hour, every five minutes."""
    grid = metrics.counts_on_grid(v.table("events"), F.col("ts"), 300)
    return metrics.range_rate(grid, 3600).select("step", F.round("rate", 9).alias("rate"))


@query(
    "metric_irate",
    f"""SELECT step, round(n / 300e0, 9) AS irate FROM ({grid_sql(300)})
        WHERE step > (SELECT min(step) FROM ({grid_sql(300)}))""",
)
def metric_irate(v: Fleet) -> DataFrame:
    grid = metrics.counts_on_grid(v.table("events"), F.col("ts"), 300)
    rates = metrics.instant_rate(grid).where(F.col("irate").isNotNull())
    return rates.select("step", F.round("irate", 9).alias("irate"))


@query(
    "rate_by_label",
    f"""SELECT label, step, round(sum(n) OVER (PARTITION BY label ORDER BY step RANGE BETWEEN 7199 PRECEDING AND CURRENT ROW)
               / 7200e0, 9) AS rate FROM ({grid_sql(1800, 'event_type')})""",
)
def rate_by_label(v: Fleet) -> DataFrame:
    grid = metrics.counts_on_grid(v.table("events"), F.col("ts"), 1800, F.col("event_type"))
    return metrics.range_rate(grid, 7200).select("label", "step", F.round("rate", 9).alias("rate"))


@query(
    "rate_total",
    f"""SELECT step, round(sum(n) OVER (ORDER BY step RANGE BETWEEN 7199 PRECEDING AND CURRENT ROW) / 7200e0, 9) AS rate
        FROM ({grid_sql(1800)})""",
)
def rate_total(v: Fleet) -> DataFrame:
    grid = metrics.counts_on_grid(v.table("events"), F.col("ts"), 1800, F.col("event_type"))
    return metrics.rate_over_all(grid, 7200).select("step", F.round("rate", 9).alias("rate"))


@query("ratio_rule", "SELECT arrival, value / k AS ratio FROM telemetry WHERE k <> 0 AND value / k > 0.85")
def ratio_rule(v: Fleet) -> DataFrame:
    return metrics.ratio_rule(v.base(), F.col("value"), F.col("k"), 0.85).select("arrival", "ratio")


@query(
    "sustained_alert",
    f"""SELECT step, n FROM (
          SELECT step, n, min(CAST(n > 10 AS INTEGER)) OVER w AS held, count(*) OVER w AS seen FROM ({grid_sql(3600)})
          WINDOW w AS (ORDER BY step RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW))
        WHERE held = 1 AND seen = 3""",
)
def sustained_alert(v: Fleet) -> DataFrame:
    """Hours at which more than 10 events per hour were seen for two hours without a break."""
    grid = metrics.counts_on_grid(v.table("events"), F.col("ts"), 3600)
    return metrics.sustained(grid, F.col("n") > 10, 7200, 3600).select("step", "n")


@query(
    "absence_rule",
    f"""SELECT step FROM (SELECT step, sum(n) OVER (ORDER BY step RANGE BETWEEN 599 PRECEDING AND CURRENT ROW) AS n
                          FROM ({grid_sql(300)})) WHERE n = 0""",
)
def absence_rule(v: Fleet) -> DataFrame:
    """Five-minute steps that follow ten minutes without an event."""
    grid = metrics.counts_on_grid(v.table("events"), F.col("ts"), 300)
    return metrics.absent(grid, 600).select("step")


@query(
    "rate_alert",
    f"""SELECT label, step, round(rate, 9) AS rate FROM (
          SELECT label, step, rate, min(CAST(rate > 0.0006 AS INTEGER)) OVER w AS held, count(*) OVER w AS seen
          FROM (SELECT label, step, sum(n) OVER (PARTITION BY label ORDER BY step RANGE BETWEEN 7199 PRECEDING AND CURRENT ROW)
                                    / 7200e0 AS rate FROM ({grid_sql(1800, 'event_type')}))
          WINDOW w AS (PARTITION BY label ORDER BY step RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))
        WHERE held = 1 AND seen = 3""",
)
def rate_alert(v: Fleet) -> DataFrame:
    """Per event type: a two-hour rate above the limit, held for an hour."""
    grid = metrics.counts_on_grid(v.table("events"), F.col("ts"), 1800, F.col("event_type"))
    found = metrics.rate_alert(grid, 7200, 0.0006, 3600, 1800)
    return found.select("label", "step", F.round("rate", 9).alias("rate"))


@query(
    "silence_alert",
    f"""SELECT label, step FROM (
          SELECT label, step, min(CAST(total = 0 AS INTEGER)) OVER w AS held, count(*) OVER w AS seen
          FROM (SELECT label, step, sum(n) OVER (PARTITION BY label ORDER BY step RANGE BETWEEN 599 PRECEDING AND CURRENT ROW) AS total
                FROM ({grid_sql(300, 'event_type')}))
          WINDOW w AS (PARTITION BY label ORDER BY step RANGE BETWEEN 600 PRECEDING AND CURRENT ROW))
        WHERE held = 1 AND seen = 3""",
)
def silence_alert(v: Fleet) -> DataFrame:
    """Per event type: nothing in ten minutes, for ten minutes."""
    grid = metrics.counts_on_grid(v.table("events"), F.col("ts"), 300, F.col("event_type"))
    return metrics.silence_alert(grid, 600, 600, 300).select("label", "step")


def _step_sql(step: int) -> str:
    return f"CAST(ceil(epoch_us(ts) / {step}e6) * {step} AS BIGINT)"


@query(
    "quantile_alert",
    f"""SELECT step, round(quantile, 6) AS quantile FROM (
          WITH h AS (
          SELECT step, le, count(*) FILTER (value <= le) AS c
          FROM (SELECT {_step_sql(7200)} AS step, value FROM events)
          CROSS JOIN (SELECT CAST(b AS DOUBLE) AS le FROM (VALUES {_BOUNDS}) AS t(b)) GROUP BY step, le),
        r AS (
          SELECT *, max(c) OVER (PARTITION BY step) AS total, coalesce(lag(le) OVER (PARTITION BY step ORDER BY le), 0) AS lo,
                 coalesce(lag(c) OVER (PARTITION BY step ORDER BY le), 0) AS lo_c FROM h),
        p AS (
          SELECT step, arg_min(CASE WHEN le = 'inf'::DOUBLE THEN 125 WHEN le = 0 OR c = lo_c THEN le
                                    ELSE lo + (le - lo) * (0.5e0 * total - lo_c) / (c - lo_c) END, le) AS quantile
          FROM r WHERE c >= 0.5e0 * total GROUP BY step)
          SELECT *, min(CAST(quantile > 12 AS INTEGER)) OVER w AS held, count(*) OVER w AS seen FROM p
          WINDOW w AS (ORDER BY step RANGE BETWEEN 14400 PRECEDING AND CURRENT ROW))
        WHERE held = 1 AND seen = 3""",
)
def quantile_alert(v: Fleet) -> DataFrame:
    """A two-hour median above the limit, held for four hours."""
    found = metrics.quantile_alert(v.table("events"), F.col("ts"), F.col("value"), config.RUL_BUCKETS, 0.5, 12.0, 14400, 7200)
    return found.select("step", F.round("quantile", 6).alias("quantile"))


@query(
    "ratio_alert",
    f"""SELECT label, step, round(ratio, 6) AS ratio FROM (
          SELECT *, min(CAST(coalesce(ratio > 0.4, false) AS INTEGER)) OVER w AS held, count(*) OVER w AS seen
          FROM (SELECT event_type AS label, {_step_sql(21600)} AS step, sum(value) / nullif(sum(k), 0) AS ratio
                FROM telemetry GROUP BY 1, 2)
          WINDOW w AS (PARTITION BY label ORDER BY step RANGE BETWEEN 43200 PRECEDING AND CURRENT ROW))
        WHERE held = 1 AND seen = 3""",
)
def ratio_alert(v: Fleet) -> DataFrame:
    """Per event type: value to k above the limit, held for half a day."""
    found = metrics.ratio_alert(
        v.base(), F.col("ts"), F.col("event_type"), F.col("value"), F.col("k"), 0.4, 43200, 21600
    )
    return found.select("label", "step", F.round("ratio", 6).alias("ratio"))


_STEP_SQL = "CAST(ceil(epoch_us(ts) / 3600e6) * 3600 AS BIGINT)"
_GROWN_SQL = f"""
  SELECT event_type, instance, ts, event_id, {_STEP_SQL} AS step,
         CASE WHEN value >= before THEN value - before ELSE value END AS increase,
         (epoch_us(ts) - epoch_us(ts_before)) / 1e6 AS since
  FROM (SELECT *, user_id % 5 AS instance, lag(value) OVER w AS before, lag(ts) OVER w AS ts_before FROM events
        WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type, user_id % 5 ORDER BY ts, event_id))
  WHERE before IS NOT NULL"""
_COUNTER_SQL = f"""
  SELECT event_type, instance, step,
         sum(total) OVER (PARTITION BY event_type, instance ORDER BY step RANGE BETWEEN 7199 PRECEDING AND CURRENT ROW) / 7200e0 AS rate
  FROM (SELECT event_type, instance, step, sum(increase) AS total FROM ({_GROWN_SQL}) GROUP BY ALL)"""
_SERIES = ["event_type", "instance"]


def _grown(v: Fleet) -> DataFrame:
    """The readings as samples of a counter for each type and instance; every fall is a reset."""
    samples = v.table("events").select("event_type", (F.col("user_id") % 5).alias("instance"), "ts", "event_id", "value")
    return metrics.increases(samples, _SERIES, ["ts", "event_id"])


@query("counter_rate", f"SELECT event_type, instance, step, round(rate * 7200, 3) AS two_hours FROM ({_COUNTER_SQL})")
def counter_rate(v: Fleet) -> DataFrame:
    """Rate over two hours, by the hour; told for the two hours, as the readings have two decimals."""
    rates = metrics.counter_rate(_grown(v), _SERIES, 3600, 7200)
    return rates.select(*_SERIES, "step", F.round(F.col("rate") * 7200, 3).alias("two_hours"))


@query(
    "counter_irate",
    f"""SELECT event_type, instance, step, round(arg_max(increase / since, (ts, event_id)), 6) AS irate
        FROM ({_GROWN_SQL}) WHERE since > 0 GROUP BY ALL""",
)
def counter_irate(v: Fleet) -> DataFrame:
    """Rate between the last two samples of each hour that are apart in time."""
    apart = _grown(v).where("since > 0")
    return metrics.counter_irate(apart, _SERIES, ["ts", "event_id"], 3600).withColumn("irate", F.round("irate", 6))


@query("avg_rate_by_label", f"SELECT event_type, step, round(avg(rate * 7200), 6) AS two_hours FROM ({_COUNTER_SQL}) GROUP BY ALL")
def avg_rate_by_label(v: Fleet) -> DataFrame:
    """Mean over the instances that have samples."""
    rates = metrics.counter_rate(_grown(v), _SERIES, 3600, 7200)
    return rates.groupBy("event_type", "step").agg(F.round(F.avg(F.col("rate") * 7200), 6).alias("two_hours"))


_DAY = 86_400


@query(
    "bucket_quantile",
    f"""SELECT step, q, round(arg_min(CASE WHEN le = 'inf'::DOUBLE THEN 125
                   ELSE lo + (le - lo) * CASE WHEN c = lo_c THEN 1 ELSE (q * total - lo_c) / (c - lo_c) END END, le), 6) AS quantile
        FROM (SELECT *, max(c) OVER (PARTITION BY step) AS total,
                     coalesce(lag(le) OVER by_le, CASE WHEN le > 0 THEN 0 ELSE le END) AS lo, coalesce(lag(c) OVER by_le, 0) AS lo_c
              FROM (SELECT step, le, max(r) OVER (PARTITION BY step ORDER BY le) AS c
                    FROM (SELECT step, le, sum(grown) OVER (PARTITION BY le ORDER BY step RANGE BETWEEN 7199 PRECEDING AND CURRENT ROW) / 7200e0 AS r
                          FROM (SELECT step, le, sum(CASE WHEN v >= before THEN v - before ELSE v END) AS grown
                                FROM (SELECT *, lag(v) OVER (PARTITION BY event_type, instance, le ORDER BY step) AS before
                                      FROM (SELECT *, sum(n) OVER (PARTITION BY event_type, instance, le, (step - 1) // {_DAY} ORDER BY step) AS v
                                            FROM (SELECT event_type, user_id % 5 AS instance, {_STEP_SQL} AS step, le, count(*) FILTER (value <= le) AS n
                                                  FROM events, (SELECT CAST(b AS DOUBLE) AS le FROM (VALUES {_BOUNDS}) AS t(b)) GROUP BY ALL)))
                                WHERE before IS NOT NULL GROUP BY step, le)))
              WINDOW by_le AS (PARTITION BY step ORDER BY le)),
             (VALUES (0.5e0), (0.95e0)) AS t(q)
        WHERE c >= q * total AND total > 0 GROUP BY step, q""",
)
def bucket_quantile(v: Fleet) -> DataFrame:
    """Median and 95th percentile of the last two hours, from bucket counters of each type and instance that begin anew every day."""
    series = [*_SERIES, "le"]
    rows = v.table("events").withColumn("instance", F.col("user_id") % 5)
    hours = metrics.bucket_counts(rows, F.col("value"), config.RUL_BUCKETS, F.col("event_type"), F.col("instance"), metrics.step_of(F.col("ts"), 3600))
    hours = hours.withColumnsRenamed({"_by0": "event_type", "_by1": "instance", "_by2": "step"})
    day = F.floor((F.col("step") - 1) / _DAY)
    counter = F.sum("cum_count").over(W.partitionBy(*series, day).orderBy("step"))
    samples = hours.withColumns({"value": counter, "ts": F.timestamp_seconds("step")})
    grown = metrics.increases(samples, series, ["ts"])
    found = metrics.quantiles(metrics.bucket_rates(grown, config.RUL_BUCKETS, 3600, 7200), (0.5, 0.95), "step")
    return found.withColumn("quantile", F.round("quantile", 6))


_HOLES_SQL = """(
  SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type, ts,
         CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value END AS value,
         CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS unit, event_id AS cycle FROM events)"""


def _holes(v: Fleet) -> DataFrame:
    """Events of which some lack the type, the value or the unit."""
    value = F.when(F.col("event_id") % 5 != 0, F.when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value")))
    return v.table("events").select(
        F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"),
        "ts",
        value.alias("value"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("unit"),
        F.col("event_id").alias("cycle"),
    )


@query(
    "nulls_histogram",
    f"""SELECT event_type, CAST(le AS VARCHAR) AS le, count(*) FILTER (value <= le) AS cum_count
        FROM (SELECT * FROM {_HOLES_SQL} WHERE value IS NOT NULL AND NOT isnan(value)), (SELECT CAST(b AS DOUBLE) AS le FROM (VALUES {_BOUNDS}) AS t(b))
        GROUP BY event_type, le""",
)
def nulls_histogram(v: Fleet) -> DataFrame:
    """Null and NaN aren't observed; a null label is one."""
    found = metrics.bucket_counts(_holes(v), F.col("value"), config.RUL_BUCKETS, F.col("event_type"))
    le = F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string"))
    return found.withColumnRenamed("_by0", "event_type").withColumn("le", le)


@query(
    "nulls_grid",
    f"""SELECT event_type AS label, CAST(count(*) AS BIGINT) AS n FROM {_HOLES_SQL} GROUP BY event_type""",
)
def nulls_grid(v: Fleet) -> DataFrame:
    """All events are found again on the grid, those without a label too."""
    grid = metrics.counts_on_grid(_holes(v), F.col("ts"), 3600, F.col("event_type"))
    return grid.groupBy("label").agg(F.sum("n").alias("n"))


@query(
    "nulls_rul",
    f"""SELECT unit, cycle, least(max(cycle) OVER (PARTITION BY unit) - cycle, 125) AS RUL FROM {_HOLES_SQL}""",
)
def nulls_rul(v: Fleet) -> DataFrame:
    """Rows without a unit are labelled as one unit."""
    return transform.add_rul(_holes(v).select("unit", "cycle"))


@query(
    "nulls_split",
    f"""SELECT unit, CASE WHEN row_number() OVER (ORDER BY md5('42:' || coalesce(CAST(unit AS VARCHAR), '')))
                               <= ceil(0.2e0 * count(*) OVER ()) THEN 'val' ELSE 'train' END AS split
        FROM (SELECT DISTINCT unit FROM {_HOLES_SQL})""",
)
def nulls_split(v: Fleet) -> DataFrame:
    """The exact share, with a null among the units."""
    return transform.group_split(_holes(v))
