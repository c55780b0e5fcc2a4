import pytest
from pyspark.sql import functions as F

from cyclewise.operators import evaluate, quality, transform, windows


def test_window_counts(spark):
    rows = [(n, c, float(c), 0) for n in (29, 30, 31) for c in range(1, n + 1)]
    df = spark.createDataFrame(rows, "unit int, cycle int, s2 double, RUL int")
    counts = {r["unit"]: r["count"] for r in windows.sliding_windows(df, ["s2"]).groupBy("unit").count().collect()}
    assert counts == {30: 1, 31: 2}


def test_last_window_is_padded_in_front(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 9), (1, 2, 6.0, 8), (2, 1, 1.0, 3)], "unit int, cycle int, s2 double, RUL int")
    got = {r.unit: (r.features, r.label) for r in windows.last_windows(df, ["s2"], 3).collect()}
    assert got == {1: ([[0.0], [5.0], [6.0]], 8), 2: ([[0.0], [0.0], [1.0]], 3)}


def test_late_and_duplicate_cycles(spark):
    rows = [(1, c, i) for i, c in enumerate([1, 2, 2, 1, 3])]
    df = spark.createDataFrame(rows, "unit int, cycle int, arrival long")
    assert [r.cycle for r in windows.drop_late(df).orderBy("arrival").collect()] == [1, 2, 3]


def test_negative_first_cycle_is_kept(spark):
    df = spark.createDataFrame([(1, -5, 0), (1, -6, 1), (1, 0, 2)], "unit int, cycle int, arrival long")
    assert [r.cycle for r in windows.drop_late(df).orderBy("arrival").collect()] == [-5, 0]


def test_window_features_equal_array_features(spark):
    rows = [(u, c, float((c * 7 + u) % 11), float(c * c % 5), 0) for u in (1, 2) for c in range(1, 14)]
    df = spark.createDataFrame(rows, "unit int, cycle int, s2 double, s3 double, RUL int")
    by_frame = windows.window_features(df, ["s2", "s3"], 5, chunk_rows=6)
    by_array = windows.array_features(windows.sliding_windows(df, ["s2", "s3"], 5), ["s2", "s3"], 5)
    columns = by_frame.columns
    a = sorted(tuple(round(float(x), 9) for x in r) for r in by_frame.select(columns).collect())
    b = sorted(tuple(round(float(x), 9) for x in r) for r in by_array.select(columns).collect())
    assert len(a) == 18 and a == b


def test_rul_clip(spark):
    df = spark.createDataFrame([(1, c) for c in range(1, 201)], "unit int, cycle int")
    got = {r.cycle: r.RUL for r in transform.add_rul(df).collect()}
    assert (got[1], got[75], got[76], got[200]) == (125, 125, 124, 0)


def test_scaler_fit_and_count_check(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "s2 double, s3 double")
    bounds = transform.fit_scaler(df, ["s2", "s3"])
    got = [tuple(r) for r in bounds.orderBy("pos").collect()]
    assert got == [("s2", 0, 1.0, 3.0, 2.0), ("s3", 1, 5.0, 5.0, 0.0)]
    other = spark.createDataFrame([(5.0, 7.0)], "s2 double, s3 double")
    assert tuple(transform.scale(other, bounds, ["s2", "s3"]).first()) == (2.0, 2.0)
    with pytest.raises(ValueError):
        transform.check_bounds(bounds, ["s2"])


def test_truth_by_position(spark):
    units = spark.createDataFrame([(30,), (7,), (7,), (1000,)], "unit int")
    truth = spark.createDataFrame([(1, 11), (2, 22), (3, 33)], "pos long, rul int")
    got = {r.unit: r.RUL for r in transform.truth_by_position(units, truth).collect()}
    assert got == {7: 11, 30: 22, 1000: 33}


@pytest.mark.parametrize("lines", [2, 4])
def test_truth_of_another_length_fails(spark, lines):
    units = spark.createDataFrame([(30,), (7,), (1000,)], "unit int")
    truth = spark.createDataFrame([(i + 1, i) for i in range(lines)], "pos long, rul int")
    with pytest.raises(Exception, match="differ in number"):
        transform.truth_by_position(units, truth).collect()


@pytest.mark.parametrize("units", [1, 10, 101])
def test_group_split(spark, units):
    df = spark.createDataFrame([(u,) for u in range(units) for _ in range(3)], "unit int")
    rows = transform.group_split(df).collect()
    val = [r.unit for r in rows if r.split == "val"]
    assert len(rows) == units and len(val) == -(-units // 5)
    again = [r.unit for r in transform.group_split(df.repartition(3)).collect() if r.split == "val"]
    assert sorted(val) == sorted(again)


def test_column_coverage():
    assert transform.column_coverage(["s2", "s3"], ["s3", "x"]) == (["s3"], ["s2"])
    with pytest.raises(ValueError):
        transform.column_coverage(["s2"], ["x"])


def report(spark, tp, fp, fn, tn):
    counts = spark.createDataFrame([(tp, fp, fn, tn)], "tp long, fp long, fn long, tn long")
    rows = evaluate.report_from_counts(counts).collect()
    return {r["class"]: (round(r.precision, 6), round(r.recall, 6), round(r.f1, 6), r.support) for r in rows}


def test_report_from_known_counts(spark):
    got = report(spark, 22, 2, 3, 73)
    assert got["Critical"] == (0.916667, 0.88, 0.897959, 25)
    assert got["Non-Critical"][3] == 75
    assert got["accuracy"][0] == 0.95
    assert round(got["macro avg"][2], 4) == 0.9324 and round(got["weighted avg"][2], 4) == 0.9497


def test_report_without_positives(spark):
    got = report(spark, 0, 0, 0, 4)
    assert got["Critical"] == (0.0, 0.0, 0.0, 0) and got["Non-Critical"] == (1.0, 1.0, 1.0, 4)
    assert report(spark, 0, 0, 0, 0)["accuracy"] == (0.0, 0.0, 0.0, 0)


def errors(spark, pairs):
    df = spark.createDataFrame([(i, float(t), float(p)) for i, (t, p) in enumerate(pairs)], "unit int, t double, p double")
    return evaluate.error_table(df, F.col("p") / 125, F.col("t"))


def test_scores(spark):
    got = errors(spark, [(10, 20), (30, 17), (125, 400), (5, -9)]).collect()
    assert [round(r.pred_rul, 9) for r in got] == [20, 17, 125, 0]
    row = errors(spark, [(10, 20), (30, 17)]).agg(evaluate.rmse().alias("r"), evaluate.nasa_score().alias("n")).first()
    assert round(row.r, 9) == round(((100 + 169) / 2) ** 0.5, 9)
    assert round(row.n, 9) == round(2 * (2.718281828459045 - 1), 9)


def test_critical_is_strictly_below(spark):
    rows = evaluate.confusion_matrix(errors(spark, [(29, 29), (30, 30), (29.5, 30), (30, 29)])).collect()
    assert {(r.critical_true, r.critical_pred): r.n for r in rows} == {
        (False, False): 1, (False, True): 1, (True, False): 1, (True, True): 1,
    }


def test_bins(spark):
    got = evaluate.error_by_bin(errors(spark, [(0, 5), (30, 31), (30.01, 33), (125, 120), (126, 100)])).collect()
    assert {r.bucket: (r.mean_abs_error, r.n) for r in got} == {
        "critical(0-30)": (1.0, 1), "degrading(30-60)": (2.99, 1), "healthy(90-125)": (5.0, 1),
    }


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 9, 10)] + [(None,)], "x double")
    got = [r.n for r in evaluate.histogram(df, "x", 5).orderBy("bin").collect()]
    assert got == [2, 2, 0, 0, 2]
    flat = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert [(r.low, r.n) for r in evaluate.histogram(flat, "x", 2).orderBy("bin").collect()] == [(3.5, 0), (4.0, 2)]
    assert evaluate.histogram(df.where("x > 99"), "x", 5).count() == 0


def test_summary_of_nothing(spark):
    empty = errors(spark, [(1, 1)]).where("unit < 0")
    row = evaluate.summary(evaluate.metrics_row(empty)).first()
    assert tuple(row) == (0.0,) * 7


def test_deviations(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    assert [(r.sensor, round(r.std, 4), r["drop"]) for r in evaluate.deviations(df, ["a", "b"]).collect()] == [
        ("b", 0.0, True), ("a", 0.7071, False),
    ]


def test_first_of_equal_epochs(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.2), (1, 3, 0.2), (1, 4, 0.4)], "run int, e int, l double")
    assert tuple(evaluate.best_epoch(df, "run", "e", "l").first()) == (1, 2, 0.2, 4, 0.4)


def lines(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return df.select(F.split("t", " ").alias("tokens"))


def test_checks(spark):
    got = {r.check: r.violations for r in quality.main_checks(lines(spark, "1 2 3", "1 2", "1 x 3"), ("a", "b", "c")).collect()}
    assert got == {"column_count": 1, "numeric": 1, "not_empty": 0}
    got = {r.check: r.violations for r in quality.truth_checks(lines(spark, "7", "-1", "x", "1 2")).collect()}
    assert got == {"truth_column_count": 1, "truth_numeric": 1, "truth_negative": 1, "truth_not_empty": 0}


def test_empty_input_fails(spark):
    checks = quality.main_checks(lines(spark, "1").where("false"), ("a",))
    assert tuple(quality.verdict(checks).first()) == ("failed", "not_empty")


def test_equal_cycles_are_in_order(spark):
    rows = [(1, c, i) for i, c in enumerate([1, 1, 2])] + [(2, c, 3 + i) for i, c in enumerate([5, 4, 4, 3])]
    df = spark.createDataFrame(rows, "unit int, cycle int, pos long")
    got = quality.cycle_order_violations(df, ["pos"], F.floor(F.col("pos") / 2), hot_rows=0).collect()
    assert {r.unit: r.violations for r in got} == {1: 0, 2: 2}
