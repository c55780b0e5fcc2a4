"""The given tables seen as fleet telemetry, in Spark and as the same definitions in SQL.

events    -> telemetry of one engine per user, two readings (value, k); sensor maps; late arrivals
lineitem  -> wide cycle table of one engine per supplier, four sensors
supplier  -> positional truth
orders    -> what a stream has last written of each engine (one for each customer)
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclewise.functions import scalars as S
from cyclewise.operators import chunked, drift, scoring

CUTOFF = "2024-01-16"
WIDE_SENSORS = ("s2", "s3", "s4", "s7")
READING_SENSORS = ("s2", "s3", "s4")
TELEMETRY_SENSORS = ("value", "k")
VERSION = "v1"

SQL = """
telemetry AS (
  SELECT 'ENG-' || CAST(user_id AS VARCHAR) AS engine_id, user_id AS unit,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS cycle,
         event_id AS arrival, epoch_us(ts) // 1000 AS event_time_ms, ts, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
late_telemetry AS (
  SELECT engine_id, unit, CAST(floor(value) AS BIGINT) AS cycle, arrival, event_time_ms, value, k FROM telemetry),
readings AS (
  SELECT engine_id, cycle, arrival, event_time_ms, event_type, value AS s2, CAST(k AS DOUBLE) AS s3,
         CASE WHEN event_type = 'error' THEN NULL ELSE CAST(hour(ts) AS DOUBLE) END AS s4
  FROM telemetry),
wide AS (
  SELECT l_suppkey AS unit,
         CAST(row_number() OVER (PARTITION BY l_suppkey
              ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS BIGINT) AS cycle,
         l_quantity AS s2, l_extendedprice AS s3, l_discount AS s4, l_tax AS s7, l_returnflag AS condition
  FROM lineitem),
wide_life AS (SELECT unit, max(cycle) AS life FROM wide GROUP BY unit),
wide_rul AS (SELECT w.*, least(life - cycle, 125) AS RUL FROM wide w JOIN wide_life USING (unit)),
units_truth AS (
  SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS pos, CAST(s_suppkey % 146 AS INTEGER) AS rul
  FROM supplier),
unit_rul AS (
  SELECT u.unit, t.rul AS RUL
  FROM (SELECT unit, row_number() OVER (ORDER BY unit) AS pos FROM (SELECT DISTINCT unit FROM wide)) u
  JOIN units_truth t USING (pos)),
unit_split AS (
  SELECT unit, CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(unit AS VARCHAR)))
                         <= ceil(0.2e0 * count(*) OVER ()) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT DISTINCT unit FROM wide)),
scored AS (
  SELECT *, (k % 101) / 100e0 AS pred_norm, greatest(0e0, (k % 101) / 100e0 * 125e0) AS pred_rul_raw
  FROM telemetry),
risked AS (
  SELECT *, greatest(0e0, least(1e0, 1e0 - pred_rul_raw / 125e0)) AS risk FROM scored),
graded_rows AS (
  SELECT *, CAST(round_even(pred_rul_raw, 0) AS INTEGER) AS remaining_cycles, round_even(risk, 3) AS failure_risk,
         CASE WHEN risk >= 0.8e0 THEN 'CRITICAL' WHEN risk >= 0.6e0 THEN 'HIGH'
              WHEN risk >= 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
  FROM risked),
graded AS (
  SELECT * FROM graded_rows QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cycle DESC) = 1),
pred AS (
  SELECT *, CAST(least(125, (unit * 7) % 146) AS DOUBLE) AS true_rul FROM graded),
errors AS (
  SELECT unit, true_rul, greatest(0e0, least(125e0, pred_norm * 125e0)) AS pred_rul,
         greatest(0e0, least(125e0, pred_norm * 125e0)) - true_rul AS error,
         abs(greatest(0e0, least(125e0, pred_norm * 125e0)) - true_rul) AS abs_error
  FROM pred),
cells AS (
  SELECT count(*) FILTER (true_rul < 30 AND pred_rul < 30) AS tp, count(*) FILTER (true_rul >= 30 AND pred_rul < 30) AS fp,
         count(*) FILTER (true_rul < 30 AND pred_rul >= 30) AS fn, count(*) FILTER (true_rul >= 30 AND pred_rul >= 30) AS tn,
         sqrt(avg(error * error)) AS rmse,
         sum(CASE WHEN error < 0 THEN exp(-error / 13) - 1 ELSE exp(error / 10) - 1 END) AS nasa_score
  FROM errors),
class_scores AS (
  SELECT *, CASE WHEN p1 + r1 = 0 THEN 0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1_1,
         CASE WHEN p0 + r0 = 0 THEN 0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f1_0
  FROM (SELECT *, tp + fp + fn + tn AS n, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
               CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p1,
               CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r1,
               CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS p0,
               CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS r0
        FROM cells)),
summary AS (
  SELECT round_even(CAST(rmse AS DOUBLE), 2) AS rmse, round_even(CAST(nasa_score AS DOUBLE), 1) AS nasa_score,
         round_even(CAST(p1 AS DOUBLE), 3) AS precision_critical, round_even(CAST(r1 AS DOUBLE), 3) AS recall_critical,
         round_even(CAST(f1_1 AS DOUBLE), 3) AS f1_critical, round_even(CAST(accuracy AS DOUBLE), 3) AS accuracy,
         round_even(CAST((f1_1 * (tp + fn) + f1_0 * (tn + fp)) / n AS DOUBLE), 3) AS f1_weighted
  FROM class_scores),
latest_time AS (SELECT max(event_time_ms) AS now_ms FROM telemetry),
engine_meta AS (
  SELECT engine_id, cycle, event_time_ms FROM telemetry
  QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cycle DESC) = 1),
store AS (
  SELECT engine_id, cycle, event_time_ms FROM engine_meta, latest_time WHERE event_time_ms >= now_ms - 43200000),
buffers AS (
  SELECT engine_id, CAST(least(30, count(*)) AS INTEGER) AS buffer_size FROM telemetry GROUP BY engine_id),
order_store AS (
  SELECT 'ENG-' || CAST(o_custkey AS VARCHAR) AS engine_id, count(*) AS cycle, max(epoch_us(o_orderdate) // 1000) AS event_time_ms
  FROM orders GROUP BY o_custkey
  QUALIFY max(epoch_us(o_orderdate) // 1000) >= max(max(epoch_us(o_orderdate) // 1000)) OVER () - 180 * 86400000::BIGINT),
risky AS (SELECT * FROM graded_rows WHERE risk_level IN ('HIGH', 'CRITICAL')),
raised AS (
  SELECT engine_id, risk_level, failure_risk, remaining_cycles, event_time_ms, unit % 2 = 0 AS acknowledged
  FROM risky WHERE ts < TIMESTAMP '2024-01-16'
  QUALIFY row_number() OVER (PARTITION BY engine_id ORDER BY arrival) = 1)
"""


# The same text in SQL, for a list of lists.
HUNDREDTHS = """array_to_string(list_transform(flatten({0}),
    lambda x: CAST(CAST(round_even(CAST(x AS FLOAT) * 100e0, 0) AS BIGINT) AS VARCHAR)), ',')"""


def hundredths(flat: Column) -> Column:
    """A flattened window as text: all readings in order, in hundredths (the readings have two decimals)."""
    return F.array_join(F.transform(flat, lambda x: F.bround(x * 100).cast("long").cast("string")), ",")


class Fleet:
    """Views over one folder of tables; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def base(self, events: DataFrame | None = None, *more: str) -> DataFrame:
        """Telemetry without cycle numbers, with the columns ``more`` as they are; works on a table and on a stream."""
        rows = self.table("events") if events is None else events
        return rows.select(
            S.engine_id(F.col("user_id")).alias("engine_id"),
            F.col("user_id").alias("unit"),
            F.col("event_id").alias("arrival"),
            S.epoch_millis(F.col("ts")).alias("event_time_ms"),
            "ts",
            "event_type",
            "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            *more,
        )

    @cached_property
    def unit_counts(self) -> DataFrame:
        """Rows per unit of the telemetry, counted once for the hot keys and the lives."""
        return chunked.key_counts(self.base(), ["unit"])

    @cached_property
    def line_counts(self) -> DataFrame:
        """Rows per unit of the wide table."""
        return chunked.key_counts(self._line_items(), ["unit"])

    @property
    def telemetry(self) -> DataFrame:
        minute = F.floor(F.col("event_time_ms") / 60_000)
        order = [F.col("ts"), F.col("arrival")]
        return chunked.with_ordinal(self.base(), ["unit"], order, minute, "cycle", counts=self.unit_counts)

    @property
    def telemetry_life(self) -> DataFrame:
        """Cycles are numbered from 1 without gaps, so a unit's life is its row count."""
        return self.unit_counts.select("unit", F.col("_n").alias("life"))

    def late(self, events: DataFrame | None = None) -> DataFrame:
        return self.base(events).withColumn("cycle", F.floor("value").cast("long"))

    def readings(self, telemetry: DataFrame | None = None) -> DataFrame:
        """Telemetry as sensor maps; readings of type 'error' lack s4."""
        rows = self.telemetry if telemetry is None else telemetry
        s4 = F.when(F.col("event_type") != "error", F.hour(F.col("ts")).cast("double"))
        values = F.array(F.col("value"), F.col("k").cast("double"), s4)
        full = F.map_from_arrays(F.array(*[F.lit(s) for s in READING_SENSORS]), values)
        return rows.select(
            "engine_id", "cycle", "arrival", "event_time_ms", F.map_filter(full, lambda _, v: v.isNotNull()).alias("sensors")
        )

    @property
    def lines(self) -> DataFrame:
        """The wide table without cycle numbers."""
        return self._line_items().select("unit", *WIDE_SENSORS, "condition")

    @property
    def wide(self) -> DataFrame:
        return self.wide_counted(self.line_counts)

    def wide_counted(self, per_unit: DataFrame) -> DataFrame:
        """The wide table; ``per_unit`` (unit, n or _n, ...) says how many rows each unit has."""
        counts = per_unit.select("unit", F.col("n" if "n" in per_unit.columns else "_n").alias("_n"))
        order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
        day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        # Within a day the order keys are cut further; both parts grow with the order of the rows.
        part = F.least(F.shiftright("l_orderkey", 28), F.lit(65_535).cast("long"))
        numbered = chunked.with_ordinal(
            self._line_items(), ["unit"], [F.col(c) for c in order], day * 65_536 + part, "cycle", counts=counts
        )
        return numbered.drop(*order)

    @property
    def wide_life(self) -> DataFrame:
        return self.line_counts.select("unit", F.col("_n").alias("life"))

    def _line_items(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("unit"),
            F.col("l_quantity").alias("s2"),
            F.col("l_extendedprice").alias("s3"),
            F.col("l_discount").alias("s4"),
            F.col("l_tax").alias("s7"),
            F.col("l_returnflag").alias("condition"),
            "l_shipdate",
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
        )

    @property
    def units_truth(self) -> DataFrame:
        suppliers = self.table("supplier").select("s_suppkey")
        ids = chunked.with_global_ordinal(suppliers, [F.col("s_suppkey")], F.floor(F.col("s_suppkey") / 65_536), "pos")
        return ids.select("pos", (F.col("s_suppkey") % 146).cast("int").alias("rul"))

    def score(self) -> Column:
        return (F.col("k") % 101) / F.lit(100.0)

    @property
    def latest(self) -> DataFrame:
        """Last telemetry row per engine, with what the queries on it need; its cycle is the engine's row count, so no
        numbering is needed."""
        rest = ["event_time_ms", "ts", "k"]
        return (
            self.base()
            .groupBy("engine_id", "unit")
            .agg(F.max_by(F.struct(*rest), F.struct("ts", "arrival")).alias("_r"), F.count(F.lit(1)).alias("cycle"))
            .select("engine_id", "unit", "cycle", "_r.*")
        )

    @property
    def graded(self) -> DataFrame:
        return scoring.grade(self.latest, self.score())

    @property
    def graded_rows(self) -> DataFrame:
        return scoring.grade(self.base(), self.score())

    @property
    def pred(self) -> DataFrame:
        truth = F.least(F.lit(125), (F.col("unit") * 7) % 146).cast("double")
        return self.latest.withColumns({"pred_norm": self.score(), "true_rul": truth})

    def now_ms(self) -> Column:
        return self.base().agg(F.max("event_time_ms").alias("now")).scalar()

    def reference_rows(self) -> DataFrame:
        return self.base().where(F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz"))

    def current_rows(self) -> DataFrame:
        return self.base().where(F.col("ts") >= F.lit(CUTOFF).cast("timestamp_ntz"))

    def drift_halves(self) -> DataFrame:
        """The readings before and after the cutoff, from one read of the events."""
        return drift.halves(self.base(), F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz"), TELEMETRY_SENSORS)

    @property
    def raised(self) -> DataFrame:
        """One alert per engine from the first half; engines with an even number have acknowledged it."""
        risky = scoring.grade(self.reference_rows(), self.score()).where(F.col("risk_level").isin("HIGH", "CRITICAL"))
        first = F.min_by(F.struct("risk_level", "failure_risk", "remaining_cycles", "event_time_ms"), F.col("arrival"))
        return (
            risky.groupBy("engine_id", "unit")
            .agg(first.alias("_a"))
            .select("engine_id", "_a.*", (F.col("unit") % 2 == 0).alias("acknowledged"))
        )
