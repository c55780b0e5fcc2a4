"""Registered queries: text and JSON sources, sinks read back, event forms, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewise import config, shared
from cyclewise.functions import scalars as S
from cyclewise.operators import evaluate, scoring, transform, windows
from cyclewise.plans.q_evaluate import errors
from cyclewise.plans.registry import query
from cyclewise.plans.views import READING_SENSORS, TELEMETRY_SENSORS, WIDE_SENSORS, Fleet, hundredths
from cyclewise.sources import events as E
from cyclewise.sources import tables, text

COLUMNS = ("unit", "cycle", *WIDE_SENSORS)


def _cycle_text(v: Fleet, path: str) -> str:
    """The wide table as lines with uneven blanks between and after the values."""
    text.write_cycles(v.wide.withColumn("end", F.lit(" ")), path, (*COLUMNS, "end"), gap="  ")
    return path


def _truth_text(v: Fleet, path: str) -> str:
    v.units_truth.orderBy("pos").select(F.concat(F.col("rul").cast("string"), F.lit("  ")).alias("value")).write.text(path)
    return path


@query(
    "scan_ws_text",
    "SELECT CAST(unit AS INTEGER) AS unit, CAST(cycle AS INTEGER) AS cycle, s2, s3, s4, s7 FROM wide",
)
def scan_ws_text(v: Fleet) -> DataFrame:
    return text.scan_cycles(v.spark, _cycle_text(v, shared.scratch(v.spark, "train")), COLUMNS)


@query("scan_rul_file", "SELECT pos, rul FROM units_truth")
def scan_rul_file(v: Fleet) -> DataFrame:
    return text.scan_truth(v.spark, _truth_text(v, shared.scratch(v.spark, "RUL")))


@query(
    "ingest_bronze",
    """SELECT 'train' AS name, count(*) AS lines FROM wide UNION ALL SELECT 'truth', count(*) FROM units_truth""",
)
def ingest_bronze(v: Fleet) -> DataFrame:
    """Ingest twice; the second run finds everything in place and copies nothing."""
    sources = {
        "train": _cycle_text(v, shared.scratch(v.spark, "train")),
        "truth": _truth_text(v, shared.scratch(v.spark, "RUL")),
    }
    bronze = shared.scratch(v.spark, "bronze")
    tables.ingest_bronze(v.spark, sources, bronze)
    copied = tables.ingest_bronze(v.spark, sources, bronze)
    counts = [
        tables.read_parquet(v.spark, path).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("lines"))
        for name, path in copied.items()
    ]
    return counts[0].unionAll(counts[1])


@query(
    "route_files",
    """SELECT 'main' AS kind, count(*) AS lines, CAST(6 AS INTEGER) AS width, CAST(sum(unit) AS BIGINT) AS first_tokens FROM wide
       UNION ALL SELECT 'truth', count(*), CAST(1 AS INTEGER), CAST(sum(rul) AS BIGINT) FROM units_truth""",
)
def route_files(v: Fleet) -> DataFrame:
    root = shared.scratch(v.spark, "inputs")
    _cycle_text(v, f"{root}/train_lines")
    _truth_text(v, f"{root}/RUL_lines")
    routed = text.route(text.token_lines(v.spark, f"{root}/*"))
    first = F.sum(F.get("tokens", F.lit(0)).cast("bigint")).alias("first_tokens")
    return routed.groupBy("kind").agg(F.count(F.lit(1)).alias("lines"), F.max(F.size("tokens")).alias("width"), first)


@query(
    "sink_silver",
    """SELECT unit, cycle, (s2 - a) / (b - a) AS s2, RUL
       FROM wide_rul, (SELECT max(s2) AS b, min(s2) AS a FROM wide)""",
)
def sink_silver(v: Fleet) -> DataFrame:
    """Labelled and scaled rows, written and read back."""
    wide = v.wide
    scaled = transform.scale(transform.add_rul(wide, life=v.wide_life), transform.fit_scaler(v.lines, WIDE_SENSORS), WIDE_SENSORS)
    path = shared.scratch(v.spark, "silver")
    tables.write_silver(scaled.drop("condition"), path)
    return tables.read_parquet(v.spark, path).select("unit", "cycle", "s2", "RUL")


@query(
    "sink_gold",
    """SELECT unit, cycle, split, round(CAST(y AS DOUBLE), 6) AS y, array_to_string(list_transform(flatten(f),
              lambda x: CAST(CAST(round_even(CAST(x AS FLOAT) * 100e0, 0) AS BIGINT) AS VARCHAR)), ',') AS features
       FROM (SELECT unit, cycle, CAST(least(max(cycle) OVER (PARTITION BY unit) - cycle, 125) / 125e0 AS FLOAT) AS y,
                    list([value, k]) OVER (PARTITION BY unit ORDER BY cycle ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS f
             FROM telemetry)
       JOIN (SELECT unit, CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(unit AS VARCHAR)))
                                    <= ceil(0.2e0 * count(*) OVER ()) THEN 'val' ELSE 'train' END AS split
             FROM (SELECT DISTINCT unit FROM telemetry)) USING (unit)
       WHERE len(f) = 30""",
)
def sink_gold(v: Fleet) -> DataFrame:
    """Windows of train and validation units, written by split and read back."""
    labelled = transform.add_rul(v.telemetry, life=v.telemetry_life)
    found = windows.sliding_windows(labelled, TELEMETRY_SENSORS, ordinal="cycle")
    split = transform.group_split(v.base())
    path = shared.scratch(v.spark, "gold")
    tables.write_gold(found.join(shared.settle(split, "split"), "unit").withColumn("y", transform.target_scaled(F.col("label"))), path)
    back = tables.read_parquet(v.spark, path)
    flat = hundredths(F.flatten("features"))
    return back.select("unit", "cycle", "split", F.round(F.col("y").cast("double"), 6).alias("y"), flat.alias("features"))


@query("sink_metadata", "SELECT * FROM summary")
def sink_metadata(v: Fleet) -> DataFrame:
    """The evaluation report as JSON, written and read back."""
    report = evaluate.summary(evaluate.metrics_row(errors(v)))
    path = shared.scratch(v.spark, "metrics")
    tables.write_metadata(report, path)
    return tables.read_metadata(v.spark, path, report.schema)


@query(
    "audit_log",
    """SELECT engine_id, 'Prediction completed' AS message, remaining_cycles AS rul, failure_risk AS risk, risk_level,
              round_even(greatest(0e0, least(1e0, 1e0 - k / 1e3)), 3) AS confidence,
              risk_level <> 'CRITICAL' AS has_latency FROM graded""",
)
def audit_log(v: Fleet) -> DataFrame:
    """One JSON line per prediction; a prediction without a latency has no such field."""
    latency = F.when(F.col("risk_level") != "CRITICAL", F.col("k") / 10)
    path = shared.scratch(v.spark, "audit")
    # Two sampled scores that lie k / 10,000 above and below the prediction.
    _, confidence = scoring.confidence_of(F.array(v.score() - F.col("k") / 10_000, v.score() + F.col("k") / 10_000))
    tables.write_audit(scoring.audit_records(v.graded.withColumn("confidence", confidence), F.col("ts"), latency), path)
    schema = "engine_id string, message string, rul int, risk double, risk_level string, confidence double"
    raw = v.spark.read.text(path)
    parsed = raw.select(F.from_json("value", schema).alias("r"), F.col("value").contains("latency_ms").alias("has_latency"))
    return parsed.select("r.*", "has_latency")


def _messages(v: Fleet) -> DataFrame:
    """Events as JSON; one line in a hundred is cut short, another one lacks its cycle."""
    rows = v.readings(v.base().withColumn("cycle", F.col("k")))
    whole = E.encode(rows)
    no_cycle = F.to_json(F.struct("engine_id", "event_time_ms", "sensors"))
    slot = F.col("arrival") % 100
    value = F.when(slot == 0, F.concat(F.lit("{bad "), F.col("engine_id"))).when(slot == 50, no_cycle).otherwise(whole)
    return rows.select("arrival", value.alias("value"))


@query(
    "event_json",
    """SELECT r.arrival, r.engine_id, t.k AS cycle, r.event_time_ms, s2, s3, s4
       FROM readings r JOIN telemetry t USING (arrival)""",
)
def event_json(v: Fleet) -> DataFrame:
    rows = v.readings(v.base().withColumn("cycle", F.col("k")))
    back = E.good_events(E.decode(rows.select("arrival", E.encode(rows).alias("value"))))
    readings = [F.try_element_at("sensors", F.lit(s)).alias(s) for s in READING_SENSORS]
    return back.select("arrival", "engine_id", "cycle", "event_time_ms", *readings)


@query(
    "quarantine",
    """SELECT arrival, CASE WHEN arrival % 100 = 0 THEN 'malformed' ELSE 'incomplete' END AS reason,
              CASE WHEN arrival % 100 = 0 THEN '{bad ' || engine_id END AS raw
       FROM telemetry WHERE arrival % 100 IN (0, 50)
       UNION ALL SELECT -1, 'good', CAST(count(*) AS VARCHAR) FROM telemetry WHERE arrival % 100 NOT IN (0, 50)""",
)
def quarantine(v: Fleet) -> DataFrame:
    """The rejected messages with their reason, and the number of good ones."""
    decoded = E.decode(_messages(v))
    raw = F.when(F.col("reason") == "malformed", F.col("raw"))
    bad = E.quarantined(decoded).select("arrival", "reason", raw.alias("raw"))
    good = E.good_events(decoded).agg(F.count(F.lit(1)).cast("string").alias("n"))
    return bad.unionAll(good.select(F.lit(-1).cast("long"), F.lit("good"), "n"))


# Which column of the wide table stands in for each sensor of a raw line.
_STAND_INS = {name: WIDE_SENSORS[i % len(WIDE_SENSORS)] for i, name in enumerate(config.SENSORS)}


@query(
    "row_to_event",
    f"""SELECT 'ENG-' || CAST(unit AS VARCHAR) AS engine_id, CAST(cycle AS INTEGER) AS cycle,
               {", ".join(f"{c} AS {s}" for s, c in _STAND_INS.items())} FROM wide WHERE condition <> 'R'""",
)
def row_to_event(v: Fleet) -> DataFrame:
    """Lines of 26 tokens; those of condition R are one token short and are left out."""
    at = {0: "unit", 1: "cycle"} | dict(zip(config.SENSOR_POSITIONS, _STAND_INS.values()))
    tokens = [F.col(at[i]).cast("string") if i in at else F.lit("0") for i in range(config.RAW_TOKENS)]
    full = F.array(*tokens)
    cut = F.slice(full, 1, config.RAW_TOKENS - 1)
    lines = v.wide.select(F.when(F.col("condition") == "R", cut).otherwise(full).alias("tokens"))
    found = E.event_from_tokens(lines, F.unix_millis(F.current_timestamp()))
    return found.select("engine_id", "cycle", *[F.element_at("sensors", s).alias(s) for s in config.SENSORS])


@query("retain_last_n", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 5000")
def retain_last_n(v: Fleet) -> DataFrame:
    return E.retain_newest(v.table("events").select("event_id", "event_type"), "event_id", 5000)


@query(
    "topic_route",
    """SELECT arrival, 'aircraft/engine/' || engine_id || '/telemetry/cycle' AS topic FROM telemetry
       WHERE event_type <> 'error'""",
)
def topic_route(v: Fleet) -> DataFrame:
    status = F.concat(F.lit("aircraft/engine/"), F.col("engine_id"), F.lit("/status"))
    routed = F.when(F.col("event_type") == "error", status).otherwise(S.topic(F.col("engine_id")))
    return E.subscribe(v.base().select("arrival", routed.alias("topic")))
