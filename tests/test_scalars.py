import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclewise.functions import codec
from cyclewise.functions import scalars as S
from cyclewise.operators import scoring, transform


def column(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_rounding(spark):
    assert column(spark, [0.5, 1.5, 2.5, 3.5], lambda x: S.half_even(x)) == [0, 2, 2, 4]
    assert column(spark, [0.5, 1.5, 2.5, 3.5], lambda x: S.half_up(x)) == [1, 2, 3, 4]


def test_risk_cuts(spark):
    risks = [0.0, 0.2999, 0.3, 0.5999, 0.6, 0.7999, 0.8, 1.0]
    want = ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]
    assert column(spark, risks, S.risk_level) == want


def test_grading_before_and_after_rounding(spark):
    """A risk of 0.7996 is HIGH, but its rounded value 0.8 is CRITICAL."""
    df = spark.createDataFrame([(1 - 0.7996,), (-0.2,), (1.7,)], "p double")
    before = [(r.failure_risk, r.risk_level) for r in scoring.grade(df, F.col("p")).collect()]
    after = [(r.failure_risk, r.risk_level) for r in scoring.grade(df, F.col("p"), round_first=True).collect()]
    assert before == [(0.8, "HIGH"), (1.0, "CRITICAL"), (0.0, "LOW")]
    assert after == [(0.8, "CRITICAL"), (1.0, "CRITICAL"), (0.0, "LOW")]


def test_remaining_cycles_half_even(spark):
    df = spark.createDataFrame([(0.5 / 125,), (1.5 / 125,), (2.5 / 125,)], "p double")
    assert [r.remaining_cycles for r in scoring.grade(df, F.col("p")).collect()] == [0, 2, 2]


def test_batch_scaling_is_not_clamped_stream_scaling_is(spark):
    values = [5.0, 10.0, 15.0, 20.0, 25.0]
    assert column(spark, values, lambda x: S.min_max(x, F.lit(10.0), F.lit(20.0))) == [-0.5, 0.0, 0.5, 1.0, 1.5]
    assert column(spark, values, lambda x: S.min_max_stream(x, 10.0, 20.0)) == [0.0, 0.0, 0.5, 1.0, 1.0]


def test_constant_sensor(spark):
    assert column(spark, [7.0, 8.0], lambda x: S.min_max(x, F.lit(7.0), F.lit(7.0))) == [0.0, 1.0]
    assert column(spark, [7.0, 7.25, 9.0], lambda x: S.min_max_stream(x, 7.0, 7.0)) == [0.0, 0.25, 1.0]


def test_stream_scaling_is_single_precision(spark):
    rng = np.random.default_rng(5)
    values = rng.uniform(640, 645, 500)
    lo, hi = np.float32(641.21), np.float32(644.53)
    want = np.clip((values.astype("f4") - lo) / (hi - lo), np.float32(0), np.float32(1))
    got = np.array(column(spark, values.tolist(), lambda x: S.min_max_stream(x, 641.21, 644.53)), dtype="f4")
    assert (got == want).all()


def test_sensor_array_and_missing_keys(spark):
    rows = [({"s2": 1.0, "s9": 9.0},), ({},), (None,)]
    df = spark.createDataFrame(rows, "m map<string,double>")
    got = df.select(S.sensor_array(F.col("m"), ["s2", "s3"]), S.missing_keys(F.col("m"), ["s2", "s3"])).collect()
    assert [tuple(r) for r in got] == [([1.0, 0.0], ["s3"]), ([0.0, 0.0], ["s2", "s3"]), ([0.0, 0.0], ["s2", "s3"])]


def test_shape(spark):
    df = spark.createDataFrame(
        [([[1.0, 2.0], [3.0, 4.0]],), ([[1.0, 2.0]],), ([[1.0, 2.0], [3.0]],), ([[1.0, 2.0], None],), (None,)],
        "w array<array<double>>",
    )
    assert [r[0] for r in df.select(S.has_shape(F.col("w"), 2, 2)).collect()] == [True, False, False, False, False]


def test_keys(spark):
    df = spark.createDataFrame([("ENG-7",)], "e string")
    row = df.select(
        S.store_key(F.col("e"), "meta"), S.engine_of_key(S.store_key(F.col("e"), "buffer")), S.unit_of(F.col("e"))
    ).first()
    assert tuple(row) == ("engine:ENG-7:meta", "ENG-7", "7")


def test_tensor_bytes_are_big_endian(spark):
    df = spark.createDataFrame([([1.0, -2.5],), (None,)], "x array<float>")
    blobs = [r[0] for r in df.select(codec.pack_tensor("x")).collect()]
    assert bytes(blobs[0]) == bytes.fromhex("3f800000c0200000") and blobs[1] is None
    assert [r[0] for r in df.select(codec.unpack_tensor(codec.pack_tensor("x"))).collect()] == [[1.0, -2.5], None]


def test_reshape(spark):
    df = spark.createDataFrame([(list(range(6)),)], "x array<int>")
    assert df.select(S.reshape(F.col("x"), 3, 2)).first()[0] == [[0, 1], [2, 3], [4, 5]]


def test_confidence(spark):
    rows = [("a", 0.5), ("a", 0.52), ("b", 0.1), ("b", 0.9), ("c", 0.3)]
    df = spark.createDataFrame(rows, "engine_id string, s double")
    got = {r.engine_id: (round(r.mean_score, 6), r.confidence) for r in scoring.confidence(df, "engine_id", "s").collect()}
    assert got == {"a": (0.51, 0.9), "b": (0.5, 0.0), "c": (0.3, 1.0)}


def test_sample_weight_and_target(spark):
    df = spark.createDataFrame([(125,), (0,), (50,)], "r int")
    got = df.select(transform.target_scaled(F.col("r")), transform.sample_weight(F.col("r") / 125)).collect()
    assert [(round(a, 6), b) for a, b in got] == [(1.0, 2.5), (0.0, 1.0), (0.4, 1.6)]


@pytest.mark.parametrize("readings, problem", [(2, "Expected 3 readings, got 2"), (3, None)])
def test_raw_window(spark, readings, problem):
    df = spark.createDataFrame([([{"s2": 5.0, "s3": 1.0}] * readings,)], "w array<map<string,double>>")
    bounds = {"s2": (0.0, 4.0), "s3": (1.0, 1.0)}
    row = df.select(
        scoring.raw_window_problem(F.col("w"), 3, ["s2", "s3"]), scoring.scale_raw_window(F.col("w"), bounds, ["s2", "s3"])
    ).first()
    assert row[0] == problem and row[1] == [[1.25, 0.0]] * readings


def test_raw_window_with_missing_sensor(spark):
    df = spark.createDataFrame([([{"s2": 5.0}, {"s3": 1.0}],)], "w array<map<string,double>>")
    got = df.select(scoring.raw_window_problem(F.col("w"), 2, ["s2", "s3"])).first()[0]
    assert got == "Missing required sensor keys: s3"


def test_batch_keeps_bad_rows(spark):
    good, short = [[1.0, 2.0]] * 3, [[1.0, 2.0]] * 2
    df = spark.createDataFrame([("a", good, 0.1), ("b", short, 0.1), ("c", None, 0.1)], "id string, w array<array<double>>, p double")
    rows = scoring.with_shape_errors(df, "w", F.col("p"), 3, 2).orderBy("id").collect()
    assert [(r.id, r.remaining_cycles, r.risk_level, r.error) for r in rows] == [
        ("a", 12, "CRITICAL", None),
        ("b", None, None, "Expected shape (3, 2), got (2, 2)"),
        ("c", None, None, "Expected shape (3, 2), got (0, 0)"),
    ]
