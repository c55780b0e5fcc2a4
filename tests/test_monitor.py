import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclewise.operators import drift, fleet, metrics


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{n} double" for n in names))


def brute_d(a, b):
    points = sorted(set(a) | set(b))
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points)


@pytest.mark.parametrize("slices", [2, 8, 1024])
def test_ks_equals_brute_force(spark, slices):
    """A third of all values are one and the same."""
    rng = random.Random(1)
    a = [rng.choice([4.0, rng.gauss(4, 2), round(rng.gauss(4, 2), 1)]) for _ in range(400)]
    b = [rng.choice([4.0, rng.gauss(4.4, 2), round(rng.gauss(5, 1), 1)]) for _ in range(250)]
    got = drift.ks_statistics(frame(spark, s2=a), frame(spark, s2=b), ["s2"], slices).first()
    assert (got.n_ref, got.n_cur) == (400, 250)
    assert math.isclose(got.d, brute_d(a, b), abs_tol=1e-12)


def test_ks_extremes_and_nulls(spark):
    a = frame(spark, s2=[1.0, 2.0, None], s3=[1.0, 2.0, 3.0], s4=[1.0, 1.0, 1.0])
    b = frame(spark, s2=[2.0, 1.0, float("nan")], s3=[4.0, 5.0, 6.0], s4=[None, None, None])
    got = {r.sensor: r.d for r in drift.ks_statistics(a, b, ["s2", "s3", "s4"]).collect()}
    assert got == {"s2": 0.0, "s3": 1.0}


@pytest.mark.parametrize("kind", ["shifted", "alike", "gap", "ties"])
def test_ks_counts_exactly_where_it_matters(spark, kind, monkeypatch):
    """Few parts are counted by value when the samples differ; what the sketches leave open is counted in another read."""
    rng = random.Random(kind)
    shift = {"shifted": 2.0, "alike": 0.0, "gap": 9.0, "ties": 0.3}[kind]
    draw = lambda off: [round(rng.gauss(4 + off, 2), 1 if kind == "ties" else 6) for _ in range(3000)]
    a, b = draw(0), draw(shift)
    rounds, seen = [], drift._part_gaps
    monkeypatch.setattr(drift, "_part_gaps", lambda *args: rounds.append(args[-1]["s2"]) or seen(*args))
    first, second = frame(spark, s2=a), frame(spark, s2=b)
    got = drift.ks_statistics(first, second, ["s2"]).first()
    assert math.isclose(got.d, brute_d(a, b), abs_tol=1e-12) and len(rounds) == 1
    if kind == "shifted":
        assert sum(last - start + 1 for start, last in rounds[0]) < 300  # of 511
    rounds.clear()
    monkeypatch.setattr(drift, "_promising", lambda p, cuts, points: np.zeros(len(cuts) + 1, bool))
    again = drift.ks_statistics(first, second, ["s2"]).first()
    assert again.d == got.d and (len(rounds) == 2 or kind == "gap")


def test_few_ranges():
    parts = [i % 3 == 0 for i in range(60)]
    found = drift._ranges(np.array(parts), 4)
    assert len(found) == 4 and all(any(a <= i <= b for a, b in found) for i in range(60) if parts[i])
    assert drift._ranges(np.zeros(5, bool)) == []


def test_p_value(spark):
    df = spark.createDataFrame([(0.0, 50, 50), (1.0, 50, 50), (0.2, 100, 100)], "d double, n long, m long")
    p = [r[0] for r in df.select(drift.p_value(F.col("d"), F.col("n"), F.col("m"))).collect()]
    lam = math.sqrt(50) * 0.2
    series = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    assert p[0] == 1.0 and p[1] < 1e-20 and math.isclose(p[2], series, abs_tol=1e-12)


def test_drift_summary(spark):
    n = 120
    ref = frame(spark, s2=[float(i) for i in range(n)], s3=[float(i) for i in range(n)], s4=[1.0] * n)
    cur = frame(spark, s2=[float(i) for i in range(n)], s3=[float(i + 500) for i in range(n)], s4=[None] * n)
    row = drift.drift_summary(ref, cur, ["s2", "s3", "s4", "s7"]).first()
    assert (row.drift_detected, row.drift_share, row.drifted_features) == (True, 0.3333, "s3")
    assert (row.total_features, row.missing_features, row.alert_level) == (3, "", "WARNING")
    row = drift.drift_summary(ref, cur.drop("s2"), ["s2", "s3", "s4"]).first()
    assert (row.drift_share, row.missing_features, row.alert_level) == (0.5, "s2", "WARNING")


@pytest.mark.parametrize("rows, results", [(99, 0), (100, 1)])
def test_drift_needs_enough_rows(spark, rows, results):
    ref = frame(spark, s2=[float(i) for i in range(200)])
    cur = frame(spark, s2=[float(i) for i in range(rows)])
    assert drift.drift_summary(ref, cur, ["s2"]).count() == results
    assert drift.drift_summary(ref, cur.withColumnRenamed("s2", "x"), ["s2"]).count() == results


def test_drift_without_columns_is_an_error_record(spark):
    ref = frame(spark, s2=[float(i) for i in range(200)])
    row = drift.drift_summary(ref, ref.withColumnRenamed("s2", "x"), ["s2"]).first()
    assert (row.alert_level, row.drift_detected, row.total_features) == ("ERROR", False, 0)


def test_bucket_rates(spark):
    """Two series, one of which is reset; a bucket that seems to have grown by less than the one inside it; a step without samples."""
    inf = float("inf")
    samples = [
        ("x", 1.0, 0, 5), ("x", 2.0, 0, 8), ("x", inf, 0, 9), ("x", 1.0, 60, 15), ("x", 2.0, 60, 28), ("x", inf, 60, 29),
        ("x", 1.0, 120, 4), ("x", 2.0, 120, 3), ("x", inf, 120, 6), ("y", 1.0, 60, 100), ("y", 1.0, 120, 101), ("y", 2.0, 120, 7),
        ("y", 9.0, 60, 1), ("y", 9.0, 120, 500), ("x", 1.0, 300, 6), ("x", 2.0, 300, 5), ("x", inf, 300, 8),
    ]
    rows = spark.createDataFrame([(s, le, t, v) for s, le, t, v in samples], "series string, le double, t long, value long")
    grown = metrics.increases(rows.withColumn("ts", F.timestamp_seconds("t")), ["series", "le"], ["ts"])
    got = {(r.step, r.le): round(r.cum_count * 120, 9) for r in metrics.bucket_rates(grown, [1.0, 2.0], 60, 120).collect()}
    assert got == {
        (60, 1.0): 10, (60, 2.0): 20, (60, inf): 20, (120, 1.0): 15, (120, 2.0): 23, (120, inf): 26, (300, 1.0): 2, (300, 2.0): 2, (300, inf): 2,
    }
    none = metrics.bucket_rates(grown.limit(0), [1.0, 2.0], 60, 120)
    assert none.count() == 0 and metrics.quantiles(none, (0.5,), "step").count() == 0


def grid(spark, counts, step=60):
    rows = [("all", step * (i + 1), n) for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "label string, step long, n long")


def test_grid_and_rate(spark):
    df = spark.sql("SELECT timestamp_seconds(s) AS ts, l FROM VALUES (60, 'a'), (61, 'a'), (120, 'b'), (300, 'a') AS t(s, l)")
    got = metrics.counts_on_grid(df, F.col("ts"), 60, F.col("l"))
    rows = {(r.label, r.step): r.n for r in got.collect()}
    assert len(rows) == 10 and rows[("a", 60)] == 1 and rows[("a", 120)] == 1 and rows[("b", 120)] == 1
    assert rows[("a", 300)] == 1 and rows[("b", 300)] == 0
    rates = {(r.label, r.step): r.rate for r in metrics.range_rate(got, 120).collect()}
    assert rates[("a", 120)] == 2 / 120 and rates[("a", 180)] == 1 / 120 and rates[("a", 240)] == 0
    total = {r.step: r.rate for r in metrics.rate_over_all(got, 120).collect()}
    assert math.isclose(total[120], 3 / 120)


def test_instant_rate(spark):
    got = [r.irate for r in metrics.instant_rate(grid(spark, [3, 0, 6])).orderBy("step").collect()]
    assert got == [None, 0.0, 0.1]


def test_buckets_and_quantile(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (15.0,), (99.0,)], "v double")
    cumulative = metrics.bucket_counts(df, F.col("v"), [0, 10, 20])
    assert [(r.le, r.cum_count) for r in cumulative.orderBy("le").collect()] == [
        (0.0, 1), (10.0, 3), (20.0, 4), (float("inf"), 5),
    ]
    value = {r.q: r.quantile for r in metrics.quantiles(cumulative, [0.1, 0.4, 0.7, 0.95]).collect()}
    assert (value[0.1], value[0.4], value[0.95]) == (0.0, 5.0, 20.0) and math.isclose(value[0.7], 15.0)


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([(1.0,)], "v double").where("v > 5")
    assert metrics.quantiles(metrics.bucket_counts(df, F.col("v"), [1, 2]), [0.5]).count() == 0


def test_ratio_with_zero_denominator(spark):
    df = spark.createDataFrame([(9, 10), (5, 10), (1, 0)], "a int, b int")
    assert [(r.a, r.ratio) for r in metrics.ratio_rule(df, F.col("a"), F.col("b"), 0.8).collect()] == [(9, 0.9)]


def test_sustained_needs_the_whole_span(spark):
    counts = grid(spark, [5, 5, 5, 0, 5, 5, 5, 5])
    got = [r.step for r in metrics.sustained(counts, F.col("n") > 1, 120, 60).orderBy("step").collect()]
    assert got == [180, 420, 480]


def test_absence(spark):
    assert [r.step for r in metrics.absent(grid(spark, [1, 0, 0, 0, 1]), 120).orderBy("step").collect()] == [180, 240]


def predictions(spark, *rows):
    return spark.createDataFrame(rows, "engine_id string, risk_level string, failure_risk double, remaining_cycles int")


def test_alert_levels(spark):
    rows = predictions(spark, ("a", "LOW", 0.1, 9), ("b", "HIGH", 0.7, 9), ("c", "CRITICAL", 0.9, 9), ("d", "??", 0.95, 9))
    ids = lambda level: [r.engine_id for r in fleet.alerts(rows, level).collect()]
    assert ids("HIGH") == ["c", "b"] and ids("critical") == ["c"] and ids("nonsense") == ["c", "b"]
    assert ids("LOW") == ["d", "c", "b", "a"]


def test_rollups_of_an_empty_fleet(spark):
    none = predictions(spark, ("a", "LOW", 0.1, 9)).where("failure_risk > 1").withColumn("cycle", F.lit(1))
    assert tuple(fleet.kpis(none).first()) == (0, 0, 0, 0, 0)
    assert {r.risk_level: r.engines for r in fleet.risk_distribution(none).collect()} == dict.fromkeys(
        ("LOW", "MEDIUM", "HIGH", "CRITICAL"), 0
    )


def test_rounding_of_the_mean(spark):
    rows = predictions(spark, ("a", "LOW", 0.1, 2), ("b", "LOW", 0.1, 3)).withColumn("cycle", F.lit(7))
    assert tuple(fleet.kpis(rows).first()) == (2, 0, 0, 3, 7)


def test_search(spark):
    rows = predictions(spark, ("ENG-1", "LOW", 0.1, 2), ("ENG-11", "HIGH", 0.7, 2), ("ENG-2", "LOW", 0.1, 2))
    assert fleet.search(rows, "g-1").count() == 2 and fleet.search(rows, "eng-1", "HIGH").count() == 1


def test_new_alerts(spark):
    batch = spark.createDataFrame(
        [("a", 0.9, 1), ("a", 0.95, 2), ("b", 0.9, 3), ("c", 0.9, 4)], "engine_id string, failure_risk double, arrival long"
    )
    known = spark.createDataFrame([("b", False), ("c", True)], "engine_id string, acknowledged boolean")
    got = fleet.new_alerts(batch, known).orderBy("engine_id").collect()
    assert [(r.engine_id, r.failure_risk, r.acknowledged) for r in got] == [("a", 0.9, False), ("c", 0.9, False)]


def test_alert_panel(spark):
    rows = spark.createDataFrame([(f"e{i:02}", i, i % 2 == 0) for i in range(51)], "engine_id string, timestamp long, acknowledged boolean")
    newest = fleet.keep_newest(rows).collect()
    assert len(newest) == 50 and min(r.timestamp for r in newest) == 1
    assert [r.timestamp for r in fleet.unacknowledged(rows).collect()] == [49, 47, 45, 43, 41, 39, 37, 35]


def test_engine_status(spark):
    buffers = spark.createDataFrame([("a", 30), ("b", 29), ("c", 1)], "engine_id string, buffer_size int")
    store = spark.createDataFrame([("c",), ("d",)], "engine_id string")
    seen = predictions(spark, ("a", "LOW", 0.1, 9))
    got = {r.engine_id: (r.source, r.ready, r.last_risk_level) for r in fleet.engine_status(buffers, store, seen).collect()}
    assert got == {
        "a": ("push_buffer", True, "LOW"), "b": ("push_buffer", False, None),
        "c": ("redis_stream", True, None), "d": ("redis_stream", True, None),
    }


def test_expiry(spark):
    store = spark.createDataFrame([("a", 1000), ("b", 1001)], "engine_id string, updated_at_ms long")
    assert [r.engine_id for r in fleet.active(store, F.lit(3_601_001).cast("long")).collect()] == ["b"]


def test_snapshot_defaults(spark):
    engines = spark.createDataFrame([("a",), ("b",)], "engine_id string")
    meta = spark.createDataFrame([("a", 5, 77, 40)], "engine_id string, cycle int, event_time_ms long, window_size int")
    got = {tuple(r) for r in fleet.telemetry_snapshot(engines, meta).collect()}
    assert got == {("a", 5, 77, 40), ("b", 0, 0, 30)}


def timed(spark, *rows):
    """(seconds, value, label)"""
    df = spark.createDataFrame(rows, "s long, v double, l string")
    return df.select(F.timestamp_seconds("s").alias("ts"), "v", "l")


def test_rate_and_silence_alerts(spark):
    counts = grid(spark, [0, 0, 0, 6, 6, 6, 0])
    assert [r.step for r in metrics.rate_alert(counts, 60, 0.05, 60, 60).orderBy("step").collect()] == [300, 360]
    assert [r.step for r in metrics.silence_alert(counts, 60, 120, 60).orderBy("step").collect()] == [180]


def test_quantile_alert_ends_at_an_empty_step(spark):
    high = [(60 * m + s, 9.0, "a") for m in (0, 1, 2, 4, 5) for s in (10, 20)]
    low = [(60 * 6 + 10, 1.0, "a")]
    found = metrics.quantile_alert(timed(spark, *high, *low), F.col("ts"), F.col("v"), [5, 10], 0.95, 8, 60, 60)
    assert [r.step for r in found.orderBy("step").collect()] == [120, 180, 360]


def test_ratio_alert_per_label(spark):
    rows = [(30, 9.0, "a"), (90, 9.0, "a"), (30, 9.0, "b"), (90, 1.0, "b"), (30, 0.0, "c"), (90, 0.0, "c")]
    df = timed(spark, *rows).withColumn("whole", F.when(F.col("l") == "c", 0.0).otherwise(10.0))
    found = metrics.ratio_alert(df, F.col("ts"), F.col("l"), F.col("v"), F.col("whole"), 0.8, 60, 60)
    assert [(r.label, r.step, r.ratio) for r in found.collect()] == [("a", 120, 0.9)]


def test_a_stray_time_is_an_error(spark):
    """A grid over times that are too far apart names them and isn't built."""
    rows = spark.createDataFrame([("a", 100), ("b", 200), ("a", 4_000_000_000)], "label string, t long")
    grid = metrics.counts_on_grid(rows, F.timestamp_seconds("t"), 60, F.col("label"))
    with pytest.raises(Exception, match="more than 5000000 steps of 60 s between 1970-01-01 00:02:00 and 2096"):
        grid.count()
    assert metrics.counts_on_grid(rows.where("t < 1000"), F.timestamp_seconds("t"), 60, F.col("label"), most=3).count() == 6
    assert metrics.counts_on_grid(rows.limit(0), F.timestamp_seconds("t"), 60).count() == 0
