"""Nothing is lost for a null or a wrong value."""

from pyspark.sql import functions as F

from cyclewise import shared
from cyclewise.operators import chunked, evaluate, metrics, models, transform
from cyclewise.service import FleetService
from cyclewise.sources import events, tables, text


def test_rows_without_a_unit_keep_their_place(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0), (None, 1, 1.0), (None, 4, 3.0)], "unit long, cycle long, s2 double")
    assert sorted(r.RUL for r in transform.add_rul(rows).collect()) == [0, 0, 1, 3]
    assert sorted(r.s2 for r in transform.scale_per_group(rows, "unit", ["s2"]).collect()) == [0.0, 0.0, 1.0, 1.0]
    features = rows.withColumn("label", F.lit(3))
    split = transform.group_split(rows)
    assert split.count() == 2 and models.training_rows(features, split).count() == 4


def test_share_is_exact_with_a_null_unit(spark):
    units = spark.createDataFrame([(i,) for i in [*range(9), None]], "unit long")
    assert transform.group_split(units).where("split = 'val'").count() == 2


def test_numbers_with_null_buckets(spark):
    rows = spark.createDataFrame([(3,), (None,), (1,), (None,), (2,)], "x long")
    got = chunked.with_global_ordinal(rows, [F.col("x").asc_nulls_first()], F.floor(F.col("x") / 2), "n").collect()
    assert sorted(r.n for r in got) == [1, 2, 3, 4, 5] and {r.x for r in got if r.n <= 2} == {None}


def test_null_keys_may_be_hot(spark):
    rows = spark.createDataFrame([(None, i) for i in range(50)] + [(1, i) for i in range(3)], "unit long, at long")
    for hot_rows in (10, 1000):
        got = chunked.with_ordinal(rows, ["unit"], [F.col("at")], F.floor(F.col("at") / 7), "n", hot_rows).collect()
        assert all(r.n == r.at + 1 for r in got) and len(got) == 53


def test_one_read_to_count_and_one_to_number(spark, tmp_path):
    """Without hot keys the input is read twice, the first time the key alone."""
    path = str(tmp_path / "rows")
    spark.range(1000).selectExpr("id % 10 AS unit", "id AS at", "id AS other").write.parquet(path)
    got = chunked.with_ordinal(spark.read.parquet(path), ["unit"], [F.col("at")], F.floor(F.col("at") / 7), "n")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_events_without_a_label(spark):
    rows = spark.createDataFrame([("a", 10), (None, 20), (None, None)], "label string, s long")
    grid = metrics.counts_on_grid(rows.withColumn("ts", F.timestamp_seconds("s")), F.col("ts"), 10, F.col("label"))
    assert sorted((r.label or "", r.step, r.n) for r in grid.collect()) == [("", 10, 0), ("", 20, 1), ("a", 10, 1), ("a", 20, 0)]


def test_only_values_are_observed(spark):
    rows = spark.createDataFrame([(1.0,), (5.0,), (None,), (float("nan"),)], "x double")
    found = {r.le: r.cum_count for r in metrics.bucket_counts(rows, F.col("x"), [2.0]).collect()}
    assert found == {2.0: 1, float("inf"): 2}
    bins = evaluate.histogram(spark.createDataFrame([(0.0,), (1.0,), (None,), (float("nan"),)], "x double"), "x", 2).collect()
    assert [(r.bin, r.low, r.n) for r in sorted(bins)] == [(0, 0.0, 1), (1, 0.5, 1)]


def test_one_bad_token_is_set_aside(spark):
    good = [str(i) for i in range(26)]
    rows = [(good,), ([*good[:6], "x", *good[7:]],), (good[:5],), ([good[0], "one", *good[2:]],), (None,)]
    lines = spark.createDataFrame(rows, "tokens array<string>")
    assert [r.cycle for r in events.event_from_tokens(lines, F.lit(5)).collect()] == [1]
    found = sorted((r.reason, r.raw) for r in events.rejected_tokens(lines).collect() if r.raw)
    assert [reason for reason, _ in found] == ["incomplete", "malformed", "malformed"]
    assert events.rejected_tokens(lines).count() == 4


def test_bronze_after_an_aborted_write(spark, tmp_path):
    (tmp_path / "raw.txt").write_text("1 2 3\n4 5 6\n")
    (tmp_path / "bronze" / "train").mkdir(parents=True)
    sources = {"train": str(tmp_path / "raw.txt")}
    path = tables.ingest_bronze(spark, sources, str(tmp_path / "bronze"))["train"]
    assert spark.read.parquet(path).count() == 2
    (tmp_path / "raw.txt").write_text("7 8 9\n")
    tables.ingest_bronze(spark, sources, str(tmp_path / "bronze"))
    assert spark.read.parquet(path).count() == 2  # complete, so left alone


def test_counter_with_a_reset(spark):
    rows = [("a", 0, 5.0), ("a", 10, 9.0), ("a", 20, 2.0), ("a", 30, None), ("a", 40, 4.0), (None, 10, 1.0), (None, 20, 3.0)]
    samples = spark.createDataFrame(rows, "label string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    grown = metrics.increases(samples, ["label"], ["ts"])
    assert sorted((r.label or "", r.s, r.increase, r.since) for r in grown.collect()) == [
        ("", 20, 2.0, 10.0), ("a", 10, 4.0, 10.0), ("a", 20, 2.0, 10.0), ("a", 40, 2.0, 20.0),
    ]
    rates = {(r.label, r.step): r.rate for r in metrics.counter_rate(grown, ["label"], 20, 40).collect()}
    assert rates == {("a", 20): 6 / 40, ("a", 40): 8 / 40, (None, 20): 2 / 40}
    last = {(r.label, r.step): r.irate for r in metrics.counter_irate(grown, ["label"], ["ts"], 20).collect()}
    assert last == {("a", 20): 0.2, ("a", 40): 0.1, (None, 20): 0.2}


def test_confidence_of_sampled_answers(spark):
    service = FleetService(
        score=None, bounds={"s2": (0.0, 1.0)}, sensors=("s2",), size=2,
        samples=lambda flat: F.array(F.get(flat, F.lit(0)).cast("double") - 0.02, F.get(flat, F.lit(0)).cast("double") + 0.02),
    )
    rows = [("a", [[0.5], [0.5]]), ("b", [[0.5]])]
    found = service.predict(spark.createDataFrame(rows, "engine_id string, sensor_data array<array<float>>"))
    assert {r.engine_id: (r.remaining_cycles, r.confidence) for r in found.collect()} == {"a": (62, 0.8), "b": (None, None)}
    store = spark.createDataFrame([("a", [0.5, 0.5], 5000), ("b", [0.1, 0.1], 5000)], "engine_id string, features array<float>, updated_at_ms long")
    one = service.predict_engine(store, F.lit(5000), "b").collect()
    assert [(r.engine_id, r.confidence) for r in one] == [("b", 0.8)]


def test_text_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\n2\n")
    assert text.read_lines(spark, str(tmp_path / "a.txt")).count() == 2
    assert shared.scratch(spark, "x") != shared.scratch(spark, "x")
