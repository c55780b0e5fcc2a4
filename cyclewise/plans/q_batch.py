"""Registered queries: columns, labels, scaling, splits, data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewise import config, shared
from cyclewise.functions import scalars as S
from cyclewise.operators import evaluate, models, quality, transform
from cyclewise.plans.registry import query
from cyclewise.plans.views import READING_SENSORS, WIDE_SENSORS, Fleet
from cyclewise.sources import tables


@query("scan_parquet", "SELECT l_suppkey, l_quantity, l_tax FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def scan_parquet(v: Fleet) -> DataFrame:
    rows = tables.read_parquet(v.spark, f"{v.dir}/lineitem.parquet")
    return rows.where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        "l_suppkey", "l_quantity", "l_tax"
    )


@query("drop_keep_columns", "SELECT unit, cycle, s2, s3, s4 FROM wide")
def drop_keep_columns(v: Fleet) -> DataFrame:
    kept = transform.drop_columns(v.wide, ["s7", "condition"])
    return kept.select("unit", "cycle", *transform.sensor_columns(kept))


@query(
    "column_coverage",
    """SELECT sensor, CASE WHEN sensor IN (SELECT 's2' FROM readings UNION ALL SELECT 's3' FROM readings
              UNION ALL SELECT 's4' FROM readings WHERE s4 IS NOT NULL) THEN 'available' ELSE 'missing' END AS status
       FROM (VALUES ('s2'), ('s3'), ('s4'), ('s7')) AS wanted(sensor)""",
)
def column_coverage(v: Fleet) -> DataFrame:
    wanted = v.spark.createDataFrame([(s,) for s in WIDE_SENSORS], "sensor string")
    seen = v.readings(v.base().withColumn("cycle", F.lit(0))).select(F.explode(F.map_keys("sensors")).alias("sensor"))
    seen = seen.distinct()
    available = wanted.intersect(seen).withColumn("status", F.lit("available"))
    missing = wanted.subtract(seen).withColumn("status", F.lit("missing"))
    return available.unionAll(missing)


@query(
    "required_keys",
    """SELECT arrival, engine_id, s4 IS NOT NULL AS accepted, CASE WHEN s4 IS NULL THEN 's4' ELSE '' END AS missing
       FROM readings""",
)
def required_keys(v: Fleet) -> DataFrame:
    lacking = S.missing_keys(F.col("sensors"), READING_SENSORS)
    return (
        v.readings(v.base().withColumn("cycle", F.lit(0)))
        .withColumn("lacking", lacking)
        .select(
            "arrival",
            "engine_id",
            (F.size("lacking") == 0).alias("accepted"),
            F.array_join("lacking", ",").alias("missing"),
        )
    )


@query("sensor_array", "SELECT arrival, s2 AS v0, s3 AS v1, coalesce(s4, 0) AS v2 FROM readings")
def sensor_array(v: Fleet) -> DataFrame:
    values = S.sensor_array(F.col("sensors"), READING_SENSORS)
    rows = v.readings(v.base().withColumn("cycle", F.lit(0))).withColumn("x", values)
    return rows.select("arrival", *[F.col("x")[i].alias(f"v{i}") for i in range(3)])


@query(
    "shape_check",
    "SELECT vec_id, len(embedding) = 64 AND vec_id % 3 <> 0 AS ok FROM embeddings",
)
def shape_check(v: Fleet) -> DataFrame:
    square = S.reshape(F.col("embedding"), 8, 8)
    torn = F.concat(square, F.array(F.slice("embedding", 1, 3)))
    window = F.when(F.col("vec_id") % 3 != 0, square).otherwise(torn)
    return v.table("embeddings").select("vec_id", S.has_shape(window, 8, 8).alias("ok"))


@query(
    "scaler_params",
    """SELECT sensor, CAST(pos AS INTEGER) AS pos, round(lo, 8) AS min, round(hi, 8) AS max, round(hi - lo, 8) AS range
       FROM (SELECT 's2' AS sensor, 0 AS pos, min(s2) AS lo, max(s2) AS hi FROM wide
             UNION ALL SELECT 's3', 1, min(s3), max(s3) FROM wide
             UNION ALL SELECT 's4', 2, min(s4), max(s4) FROM wide
             UNION ALL SELECT 's7', 3, min(s7), max(s7) FROM wide)""",
)
def scaler_params(v: Fleet) -> DataFrame:
    """Fit, export as the two-line parameter file, load it again."""
    fitted = transform.check_bounds(transform.fit_scaler(v.lines, WIDE_SENSORS), WIDE_SENSORS)
    path = shared.scratch(v.spark, "scaler")
    tables.write_bounds(fitted, path)
    loaded = tables.read_bounds(v.spark, path, WIDE_SENSORS)
    return loaded.withColumn("range", F.round("range", 8))


@query(
    "engine_life",
    """SELECT count(*) AS units, min(life) AS min_life, max(life) AS max_life, round(avg(life), 6) AS mean_life
       FROM wide_life""",
)
def engine_life(v: Fleet) -> DataFrame:
    return v.wide_life.agg(
        F.count(F.lit(1)).alias("units"),
        F.min("life").alias("min_life"),
        F.max("life").alias("max_life"),
        F.round(F.avg("life"), 6).alias("mean_life"),
    )


@query(
    "engine_counts",
    """SELECT engine_id, count(*) AS n FROM telemetry GROUP BY engine_id
       UNION ALL SELECT 'engines', count(DISTINCT engine_id) FROM telemetry""",
)
def engine_counts(v: Fleet) -> DataFrame:
    per_engine = v.base().groupBy("engine_id").agg(F.count(F.lit(1)).alias("n"))
    return per_engine.unionAll(per_engine.agg(F.lit("engines"), F.count(F.lit(1))))


@query("rul_label", "SELECT unit, cycle, RUL FROM wide_rul")
def rul_label(v: Fleet) -> DataFrame:
    return transform.add_rul(v.wide, life=v.wide_life).select("unit", "cycle", "RUL")


@query(
    "group_split",
    "SELECT unit, split FROM unit_split",
)
def group_split(v: Fleet) -> DataFrame:
    return transform.group_split(v.table("lineitem").select(F.col("l_suppkey").alias("unit")))


@query(
    "scale_batch",
    """SELECT unit, cycle, (s2 - a2) / CASE WHEN b2 = a2 THEN 1 ELSE b2 - a2 END AS s2,
              (s3 - a3) / CASE WHEN b3 = a3 THEN 1 ELSE b3 - a3 END AS s3,
              (s4 - a4) / CASE WHEN b4 = a4 THEN 1 ELSE b4 - a4 END AS s4,
              (s7 - a7) / CASE WHEN b7 = a7 THEN 1 ELSE b7 - a7 END AS s7
       FROM wide, (SELECT min(s2) AS a2, max(s2) AS b2, min(s3) AS a3, max(s3) AS b3, min(s4) AS a4, max(s4) AS b4,
                          min(s7) AS a7, max(s7) AS b7
                   FROM wide JOIN unit_split USING (unit) WHERE split = 'train')""",
)
def scale_batch(v: Fleet) -> DataFrame:
    """Bounds come from the train units only, so other units may leave [0, 1]. One read for the bounds and row counts of every
    unit, one for the rows."""
    per_unit = transform.fit_scaler_by_unit(v.lines, WIDE_SENSORS)
    train = transform.group_split(per_unit, units=per_unit).where(F.col("split") == "train")
    bounds = transform.bounds_of_units(per_unit, train, WIDE_SENSORS)
    return transform.scale(v.wide_counted(per_unit), bounds, WIDE_SENSORS).select("unit", "cycle", *WIDE_SENSORS)


@query("positional_join", "SELECT unit, RUL FROM unit_rul")
def positional_join(v: Fleet) -> DataFrame:
    return transform.truth_by_position(v.table("lineitem").select(F.col("l_suppkey").alias("unit")), v.units_truth)


@query("attach_test_rul", "SELECT unit, cycle, RUL FROM wide LEFT JOIN unit_rul USING (unit)")
def attach_test_rul(v: Fleet) -> DataFrame:
    """The units are the keys of the counts that the numbering needs anyway."""
    truth = transform.truth_by_position(v.line_counts, v.units_truth, distinct=True)
    return transform.attach_truth(v.wide.select("unit", "cycle"), truth)


@query(
    "target_scaling",
    """SELECT unit, cycle, round(CAST(CAST(CAST(RUL AS FLOAT) / 125e0 AS FLOAT) AS DOUBLE), 6) AS y_train,
              CAST(CAST(greatest(0, least(125, RUL)) AS FLOAT) AS DOUBLE) AS y_test
       FROM wide_rul""",
)
def target_scaling(v: Fleet) -> DataFrame:
    labelled = transform.add_rul(v.wide, life=v.wide_life)
    clipped = S.clamp(F.col("RUL"), 0, config.RUL_CLIP).cast("float")
    return labelled.select(
        "unit",
        "cycle",
        F.round(transform.target_scaled(F.col("RUL")).cast("double"), 6).alias("y_train"),
        clipped.cast("double").alias("y_test"),
    )


@query(
    "sample_weight",
    "SELECT unit, cycle, round(1 + 1.5e0 * CAST(CAST(RUL / 125e0 AS FLOAT) AS DOUBLE), 6) AS weight FROM wide_rul",
)
def sample_weight(v: Fleet) -> DataFrame:
    labelled = transform.add_rul(v.wide, life=v.wide_life)
    y = transform.target_scaled(F.col("RUL")).cast("double")
    return labelled.select("unit", "cycle", F.round(transform.sample_weight(y), 6).alias("weight"))


@query(
    "sensor_variance",
    """SELECT sensor, round(std, 6) AS std, std < 0.01 AS "drop"
       FROM (SELECT 's2' AS sensor, stddev_samp(s2) AS std FROM wide UNION ALL SELECT 's3', stddev_samp(s3) FROM wide
             UNION ALL SELECT 's4', stddev_samp(s4) FROM wide UNION ALL SELECT 's7', stddev_samp(s7) FROM wide)""",
)
def sensor_variance(v: Fleet) -> DataFrame:
    return evaluate.deviations(v.lines, list(WIDE_SENSORS)).withColumn("std", F.round("std", 6))


_CONDITION_SQL = f"""
  SELECT unit, cycle, {{}}{", ".join(f"({s} - lo_{s}) / CASE WHEN hi_{s} = lo_{s} THEN 1 ELSE hi_{s} - lo_{s} END AS {s}" for s in WIDE_SENSORS)}
  FROM wide JOIN (SELECT condition, {", ".join(f"min({s}) AS lo_{s}, max({s}) AS hi_{s}" for s in WIDE_SENSORS)}
                  FROM wide GROUP BY condition) USING (condition)"""


@query("per_condition_scale", _CONDITION_SQL.format("condition, "))
def per_condition_scale(v: Fleet) -> DataFrame:
    """Scaled within a given condition. One read for row counts and bounds, one for the rows."""
    per_unit = transform.fit_scaler_by_unit(v.lines, WIDE_SENSORS, "unit", "condition")
    rows = v.wide_counted(per_unit.groupBy("unit").agg(F.sum("n").alias("n")))
    scaled = transform.scale_per_group(rows, "condition", WIDE_SENSORS, transform.bounds_by(per_unit, "condition", WIDE_SENSORS))
    return scaled.select("unit", "cycle", "condition", *WIDE_SENSORS)


# Settings of the three regimes that the line items are run in, by their flag.
REGIMES = {"A": (0.0, 0.0), "N": (20.0, 0.7), "R": (42.0, 0.84)}


def _with_settings(rows: DataFrame) -> DataFrame:
    """Two setting columns around their regime's, no two alike by chance alone."""
    jitter = F.col("s7") / 10
    middle = [F.create_map(*[F.lit(x) for flag, at in REGIMES.items() for x in (flag, at[i])])[F.col("condition")] for i in (0, 1)]
    return rows.withColumns({"os1": middle[0] + jitter, "os2": middle[1] - jitter})


@query("cluster_scale", _CONDITION_SQL.format(""))
def cluster_scale(v: Fleet) -> DataFrame:
    """Scaled within conditions that k-means finds in the settings alone; here the regimes are known, so SQL can tell."""
    settings = ("os1", "os2")
    per_unit = transform.fit_scaler_by_unit(_with_settings(v.lines), WIDE_SENSORS, "unit", *settings)
    rows = _with_settings(v.wide_counted(per_unit.groupBy("unit").agg(F.sum("n").alias("n")))).drop("condition")
    return models.scale_by_conditions(rows, settings, WIDE_SENSORS, len(REGIMES), per_unit).select("unit", "cycle", *WIDE_SENSORS)


@query(
    "time_parts",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, epoch_us(ts) // 1000 AS event_time_ms,
              strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso FROM events""",
)
def time_parts(v: Fleet) -> DataFrame:
    ms = S.epoch_millis(F.col("ts"))
    date, hour = S.partition_parts(ms)
    iso = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return v.table("events").select(
        "event_id", date.alias("date"), hour.alias("hour"), ms.alias("event_time_ms"), iso.alias("iso")
    )


def _event_lines(v: Fleet) -> DataFrame:
    """Four-token lines made from the events; some have a token too many, some a token that is no number."""
    value = F.when((F.col("event_type") == "click") & (F.col("k") == 3), "x").otherwise(F.col("value").cast("string"))
    line = F.concat_ws(" ", F.col("unit").cast("string"), F.col("arrival").cast("string"), value, F.col("k").cast("string"))
    line = F.when((F.col("event_type") == "signup") & (F.col("k") == 7), F.concat(line, F.lit(" 1"))).otherwise(line)
    return v.base().select(F.split(line, " ").alias("tokens"))


def _truth_lines(v: Fleet) -> DataFrame:
    return v.table("supplier").select(F.array(F.col("s_acctbal").cast("string")).alias("tokens"))


_CHECKS = """
  SELECT 'column_count' AS "check", count(*) FILTER (event_type = 'signup' AND k = 7) AS violations FROM telemetry
  UNION ALL SELECT 'numeric', count(*) FILTER (event_type = 'click' AND k = 3) FROM telemetry
  UNION ALL SELECT 'not_empty', CAST(count(*) = 0 AS BIGINT) FROM telemetry
  UNION ALL SELECT 'truth_column_count', CAST(0 AS BIGINT)
  UNION ALL SELECT 'truth_numeric', count(*) FILTER (s_acctbal IS NULL) FROM supplier
  UNION ALL SELECT 'truth_negative', count(*) FILTER (s_acctbal < 0) FROM supplier
  UNION ALL SELECT 'truth_not_empty', CAST(count(*) = 0 AS BIGINT) FROM supplier"""


def _checks(v: Fleet) -> DataFrame:
    columns = ("unit", "arrival", "value", "k")
    return quality.main_checks(_event_lines(v), columns).unionAll(quality.truth_checks(_truth_lines(v)))


@query("dq_report", _CHECKS)
def dq_report(v: Fleet) -> DataFrame:
    return _checks(v)


@query(
    "dq_monotonic",
    """SELECT unit, count(*) FILTER (cycle < previous) AS violations, count(*) AS "rows"
       FROM (SELECT unit, cycle, lag(cycle) OVER (PARTITION BY unit ORDER BY arrival) AS previous FROM late_telemetry)
       GROUP BY unit""",
)
def dq_monotonic(v: Fleet) -> DataFrame:
    return quality.cycle_order_violations(v.late(), ["arrival"], F.floor(F.col("arrival") / 1_000_000))


@query(
    "dq_verdict",
    f"""SELECT CASE WHEN count(*) FILTER (violations > 0) = 0 THEN 'passed' ELSE 'failed' END AS status,
               coalesce(string_agg("check", ',' ORDER BY "check") FILTER (violations > 0), '') AS error
        FROM ({_CHECKS})""",
)
def dq_verdict(v: Fleet) -> DataFrame:
    return quality.verdict(_checks(v))
