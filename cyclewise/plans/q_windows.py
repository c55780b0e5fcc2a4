"""Registered queries: per-engine windows, latest rows, late data, tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewise.functions import codec
from cyclewise.functions import scalars as S
from cyclewise.operators import chunked, evaluate, transform, windows
from cyclewise.plans.registry import query
from cyclewise.plans.views import HUNDREDTHS, TELEMETRY_SENSORS, Fleet, hundredths


@query(
    "sliding_windows",
    f"""SELECT unit, cycle, label, {HUNDREDTHS.format('features')} AS features
        FROM (SELECT unit, cycle, least(max(cycle) OVER (PARTITION BY unit) - cycle, 125) AS label,
                     list([value, k]) OVER (PARTITION BY unit ORDER BY cycle ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
                       AS features
              FROM telemetry)
        WHERE len(features) = 30""",
)
def sliding_windows(v: Fleet) -> DataFrame:
    labelled = transform.add_rul(v.telemetry, life=v.telemetry_life)
    found = windows.sliding_windows(labelled, TELEMETRY_SENSORS, ordinal="cycle")
    return found.select("unit", "cycle", "label", hundredths(F.flatten("features")).alias("features"))


@query(
    "last_window",
    f"""SELECT unit, cycle, CAST(0 AS BIGINT) AS label, {HUNDREDTHS.format('list_concat(zeros, kept)')} AS features
        FROM (SELECT unit, max(cycle) AS cycle, list(CAST([value, k] AS DOUBLE[]) ORDER BY cycle) AS kept,
                     list_resize(CAST([] AS DOUBLE[][]), greatest(64 - count(*), 0), [0, 0]) AS zeros
              FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY cycle DESC) AS r FROM telemetry)
              WHERE r <= 64 GROUP BY unit)""",
)
def last_window(v: Fleet) -> DataFrame:
    """Windows of 64 rows: longer than some engines' history, so the zero padding is used."""
    labelled = transform.add_rul(v.telemetry, life=v.telemetry_life)
    found = windows.last_windows(labelled, TELEMETRY_SENSORS, size=64)
    return found.select("unit", "cycle", "label", hundredths(F.flatten("features")).alias("features"))


@query(
    "last_row_per_unit",
    """SELECT unit, cycle, s2, s3, s4, s7 FROM wide
       QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cycle DESC) = 1""",
)
def last_row_per_unit(v: Fleet) -> DataFrame:
    return chunked.latest_per_key(v.wide.drop("condition"), ["unit"], ["cycle"])


@query(
    "late_drop",
    """SELECT unit, cycle, arrival
       FROM (SELECT *, max(cycle) OVER (PARTITION BY unit ORDER BY arrival
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM late_telemetry)
       WHERE seen IS NULL OR cycle > seen""",
)
def late_drop(v: Fleet) -> DataFrame:
    return windows.drop_late(v.late()).select("unit", "cycle", "arrival")


@query(
    "push_buffer",
    """SELECT unit, CAST(count(*) AS INTEGER) AS buffer_size, string_agg(CAST(arrival AS VARCHAR), ',' ORDER BY arrival)
              AS arrivals, round(sum(value), 4) AS total
       FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY arrival DESC) AS r FROM telemetry)
       WHERE r <= 30 GROUP BY unit HAVING count(*) = 30""",
)
def push_buffer(v: Fleet) -> DataFrame:
    full = windows.full_buffers(windows.push_buffer(v.base(), ["value"]))
    return full.select(
        "unit",
        "buffer_size",
        F.array_join(F.transform("readings", lambda r: r["arrival"].cast("string")), ",").alias("arrivals"),
        F.round(F.aggregate("readings", F.lit(0.0), lambda a, r: a + r["value"]), 4).alias("total"),
    )


@query(
    "latest_per_engine",
    "SELECT engine_id, cycle, arrival, event_type, value, k FROM graded",
)
def latest_per_engine(v: Fleet) -> DataFrame:
    last = chunked.latest_per_key(v.telemetry, ["unit"], ["cycle"])
    return last.select("engine_id", "cycle", "arrival", "event_type", "value", "k")


@query(
    "lifecycle_stage",
    """SELECT unit, cycle, f AS life_fraction,
              CASE WHEN f < 0.4e0 THEN 'LOW' WHEN f < 0.6e0 THEN 'MEDIUM' WHEN f < 0.8e0 THEN 'HIGH' ELSE 'CRITICAL' END AS stage
       FROM (SELECT unit, cycle, CAST(cycle AS DOUBLE) / life AS f FROM wide JOIN wide_life USING (unit))""",
)
def lifecycle_stage(v: Fleet) -> DataFrame:
    return windows.lifecycle_stage(v.wide.select("unit", "cycle"), life=v.wide_life)


@query(
    "flatten_reshape",
    """SELECT vec_id, CAST(8 AS INTEGER) AS n_rows, CAST(embedding[27] AS DOUBLE) AS row3_col2, true AS same
       FROM embeddings""",
)
def flatten_reshape(v: Fleet) -> DataFrame:
    window = S.reshape(F.col("embedding"), 8, 8)
    return v.table("embeddings").select(
        "vec_id",
        F.size(window).alias("n_rows"),
        window[3][2].cast("double").alias("row3_col2"),
        (F.flatten(window) == F.col("embedding")).alias("same"),
    )


@query(
    "tensor_codec",
    """SELECT vec_id, CAST(256 AS INTEGER) AS n_bytes, CAST(embedding[1] AS DOUBLE) AS x_first,
              CAST(embedding[64] AS DOUBLE) AS x_last, true AS same FROM embeddings""",
)
def tensor_codec(v: Fleet) -> DataFrame:
    packed = v.table("embeddings").withColumn("blob", codec.pack_tensor("embedding"))
    back = packed.withColumn("x", codec.unpack_tensor("blob"))
    return back.select(
        "vec_id",
        F.octet_length("blob").alias("n_bytes"),
        F.col("x")[0].cast("double").alias("x_first"),
        F.element_at("x", -1).cast("double").alias("x_last"),
        (F.col("x") == F.col("embedding")).alias("same"),
    )


@query(
    "best_epoch",
    """SELECT unit, arg_min(cycle, value * 1000000 + cycle) AS best_epoch, min(value) AS best_val_loss,
              max(cycle) AS final_epoch, arg_max(value, cycle) AS final_val_loss
       FROM telemetry GROUP BY unit""",
)
def best_epoch(v: Fleet) -> DataFrame:
    """Each engine's rows stand for one training run: the cycle is the epoch, the value its loss."""
    return evaluate.best_epoch(v.telemetry, "unit", "cycle", "value")
