import pytest
from pyspark.sql import functions as F

from cyclewise import config
from cyclewise.operators import models, scoring
from cyclewise.service import FleetService


@pytest.fixture(scope="module")
def service():
    return FleetService(
        score=lambda flat: F.element_at(flat, -1).cast("double"),
        bounds={"s2": (0.0, 10.0), "s3": (0.0, 2.0)},
        sensors=("s2", "s3"),
        size=3,
        version="v7",
    )


def answers(df):
    return {r.engine_id: (r.remaining_cycles, r.risk_level, r.error) for r in df.collect()}


def test_predict(spark, service):
    rows = [("a", [[0.0, 0.25]] * 3), ("b", [[0.0, 0.9]] * 2)]
    df = spark.createDataFrame(rows, "engine_id string, sensor_data array<array<float>>")
    assert answers(service.predict(df)) == {
        "a": (31, "HIGH", None), "b": (None, None, "Expected shape (3, 2), got (2, 2)"),
    }


def test_predict_raw(spark, service):
    whole, lacking = {"s2": 1.0, "s3": 1.0}, {"s2": 1.0}
    rows = [("a", [whole] * 3), ("b", [whole, lacking, whole]), ("c", [whole])]
    df = spark.createDataFrame(rows, "engine_id string, sensor_data array<map<string,double>>")
    assert answers(service.predict_raw(df)) == {
        "a": (62, "MEDIUM", None),
        "b": (None, None, "Missing required sensor keys: s3"),
        "c": (None, None, "Expected 3 readings, got 1"),
    }


def test_predict_from_pushed_readings(spark, service):
    rows = [("a", i, {"s2": 1.0, "s3": float(i)}) for i in range(5)]
    rows += [("b", 10, {"s2": 1.0, "s3": 1.0}), ("b", 11, {"s2": 1.0}), ("b", 12, {"s2": 1.0, "s3": 1.0})]
    df = spark.createDataFrame(rows, "engine_id string, arrival long, sensors map<string,double>")
    accepted, rejected = service.push(df)
    assert accepted.count() == 7 and [(r.arrival, r.missing) for r in rejected.collect()] == [(11, ["s3"])]
    assert {r.engine_id: r.buffer_size for r in service.buffers(accepted).collect()} == {"a": 3, "b": 2}
    assert answers(service.predict_buffered(df)) == {"a": (250, "LOW", None)}


def test_predict_stored_engines(spark, service):
    rows = [("a", [0.5] * 6, 5000), ("b", [0.5] * 5, 5000), ("c", [0.5] * 6, 5000 - 3_600_001)]
    df = spark.createDataFrame(rows, "engine_id string, features array<float>, updated_at_ms long")
    assert answers(service.predict_engines(df, F.lit(5000))) == {"a": (62, "MEDIUM", None)}


def test_sampled_confidence_in_one_row(spark):
    df = spark.createDataFrame([("a", [0.5, 0.52]), ("b", [0.1, 0.9]), ("c", [0.3])], "engine_id string, s array<double>")
    mean, confidence = scoring.confidence_of(F.col("s"))
    got = {r.engine_id: (round(r.m, 6), r.c) for r in df.select("engine_id", mean.alias("m"), confidence.alias("c")).collect()}
    long = df.select("engine_id", F.explode("s").alias("x"))
    want = {r.engine_id: (round(r.mean_score, 6), r.confidence) for r in scoring.confidence(long, "engine_id", "x").collect()}
    assert got == want == {"a": (0.51, 0.9), "b": (0.5, 0.0), "c": (0.3, 1.0)}


def test_a_bad_row_does_not_reach_the_model(spark, service):
    """A Python model is called for every row of a batch, whatever a condition around it says."""

    def load():
        return lambda windows: windows[:, -1, -1]

    python_model = FleetService(lambda x: models.external_score(load, 3, 2)(x), service.bounds, service.sensors, 3)
    rows = [("a", [[0.0, 0.25]] * 3), ("b", [[0.0, 0.9]] * 2), ("c", None)]
    df = spark.createDataFrame(rows, "engine_id string, sensor_data array<array<float>>")
    got = answers(python_model.predict(df))
    assert got["a"] == (31, "HIGH", None) and got["b"][:2] == got["c"][:2] == (None, None)
    raw = spark.createDataFrame([("a", [{"s2": 1.0}] * 3)], "engine_id string, sensor_data array<map<string,double>>")
    assert answers(python_model.predict_raw(raw)) == {"a": (None, None, "Missing required sensor keys: s3")}


def test_defaults():
    service = FleetService(score=lambda x: x, bounds={})
    assert (len(service.sensors), service.size) == (11, config.WINDOW_SIZE)
