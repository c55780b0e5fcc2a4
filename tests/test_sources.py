import pytest
from pyspark.sql import functions as F

from cyclewise import config, shared
from cyclewise.functions import scalars as S
from cyclewise.operators import models, transform
from cyclewise.plans.batch import BatchRun, ValidationError
from cyclewise.sources import events as E
from cyclewise.sources import tables, text


def write_lines(spark, lines, pieces=1):
    path = shared.scratch(spark, "text")
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, value string")
    df.repartitionByRange(pieces, "i").sortWithinPartitions("i").select("value").write.text(path)
    return path


def test_uneven_blanks(spark):
    path = write_lines(spark, ["1  2   3.5 ", "  4 5\t6.5", "", "7 x 8"])
    got = [tuple(r) for r in text.scan_cycles(spark, path, ("unit", "cycle", "s2")).orderBy("unit").collect()]
    assert got == [(1, 2, 3.5), (4, 5, 6.5), (7, None, 8.0)]


@pytest.mark.parametrize("pieces", [1, 3])
def test_truth_keeps_line_order(spark, pieces):
    values = [112, 98, 7, 145, 7, 20, 82, 91]
    got = text.scan_truth(spark, write_lines(spark, [f"{v} " for v in values], pieces)).orderBy("pos").collect()
    assert [(r.pos, r.rul) for r in got] == [(i + 1, v) for i, v in enumerate(values)]


def test_truth_order_over_blocks_of_one_file(spark):
    """A file that is read in many blocks."""
    values = list(range(2000, 0, -1))
    path = write_lines(spark, [str(v) for v in values])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = text.scan_truth(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        assert [r.rul for r in lines.orderBy("pos").collect()] == values
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bronze_keeps_the_line_order(spark):
    """Pieces of different length: their copies are not in the order of their names."""
    values = list(range(500, 0, -1))
    path = write_lines(spark, [str(v) for v in values], 5)
    spark.createDataFrame([(str(v),) for v in range(3)], "value string").coalesce(1).write.mode("append").text(path)
    before = [(r.pos, r.rul) for r in text.scan_truth(spark, path).orderBy("pos").collect()]
    copy = tables.ingest_bronze(spark, {"RUL": path}, shared.scratch(spark, "bronze"))["RUL"]
    after = [(r.pos, r.rul) for r in text.truth(spark.read.parquet(copy)).orderBy("pos").collect()]
    assert before == after and len(after) == 503


def test_parameter_file(spark):
    bounds = spark.createDataFrame([("a", 0, 641.21, 644.53, 3.32), ("b", 1, 388.0, 400.0, 12.0)], "sensor string, pos int, min double, max double, range double")
    path = shared.scratch(spark, "bounds")
    tables.write_bounds(bounds, path)
    assert [r.value for r in spark.read.text(path).collect()] == ["641.21000000,388.00000000", "644.53000000,400.00000000"]
    back = [(r.sensor, r.pos, r.min, r.max) for r in tables.read_bounds(spark, path, ("a", "b")).orderBy("pos").collect()]
    assert back == [("a", 0, 641.21, 644.53), ("b", 1, 388.0, 400.0)]
    with pytest.raises(ValueError):
        tables.read_bounds(spark, path, ("a", "b", "c"))


def test_json_events(spark):
    good = '{"engine_id":"ENG-1","cycle":3,"event_time_ms":5,"sensors":{"s2":1.5,"zz":2}}'
    bad = ["{nonsense", '{"engine_id":"ENG-1","cycle":3,"event_time_ms":5}', '{"engine_id":"ENG-1","cycle":"x","event_time_ms":5,"sensors":{}}', ""]
    decoded = E.decode(spark.createDataFrame([(t,) for t in [good, *bad]], "value string"))
    row = E.good_events(decoded).collect()
    assert [(r.engine_id, r.cycle, r.event_time_ms, r.sensors) for r in row] == [("ENG-1", 3, 5, {"s2": 1.5, "zz": 2.0})]
    assert sorted(r.raw for r in E.quarantined(decoded).collect()) == sorted(bad)


def test_round_trip_through_json(spark):
    df = spark.createDataFrame([("ENG-1", 3, 5, {"s2": 1.5})], E.EVENT_SCHEMA)
    back = E.good_events(E.decode(df.select(E.encode(df).alias("value"))))
    assert back.collect() == df.collect()


def test_short_lines_are_no_events(spark):
    full = [str(i) for i in range(26)]
    df = spark.createDataFrame([(full,), (full[:25],), ([*full, "9"],)], "tokens array<string>")
    rows = E.event_from_tokens(df, F.lit(5)).collect()
    assert len(rows) == 2 and rows[0].engine_id == "ENG-0" and rows[0].cycle == 1
    assert rows[0].sensors == dict(zip(config.SENSORS, [float(p) for p in config.SENSOR_POSITIONS]))


def test_topics(spark):
    df = spark.createDataFrame([("aircraft/engine/ENG-1/telemetry/cycle",), ("aircraft/engine/a/b/telemetry/cycle",), ("aircraft/engine//telemetry/cycle",)], "topic string")
    assert E.subscribe(df).count() == 1
    made = spark.createDataFrame([("ENG-9",)], "e string").select(S.topic(F.col("e")).alias("topic"))
    assert E.subscribe(made).count() == 1


def test_audit_leaves_out_missing_fields(spark):
    path = shared.scratch(spark, "audit")
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "engine_id string, latency_ms double")
    tables.write_audit(df, path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ['{"engine_id":"a","latency_ms":0.5}', '{"engine_id":"b"}']


def test_expired_or_short_vectors(spark):
    df = spark.createDataFrame([("a", [1.0] * 4, 10_000), ("b", [1.0] * 3, 10_000), ("c", [1.0] * 4, 8_999)], "engine_id string, features array<double>, updated_at_ms long")
    assert [r.engine_id for r in tables.online_features(df, 2, 2, F.lit(10_000), ttl=1).collect()] == ["a"]


def test_external_model(spark):
    def load():
        return lambda windows: windows.mean(axis=(1, 2))

    df = spark.createDataFrame([([1.0, 2.0, 3.0, 6.0],), ([0.0] * 4,)], "x array<float>")
    assert [r[0] for r in df.select(models.external_score(load, 2, 2)("x")).collect()] == [3.0, 0.0]


def test_conditions(spark):
    df = spark.createDataFrame([(float(g * 100 + i % 3), 0.5 * g, float(i)) for i in range(30) for g in range(3)], "os1 double, os2 double, s2 double")
    found = models.cluster_conditions(df, ["os1", "os2"], 3)
    assert found.groupBy("os2").agg(F.count_distinct("condition").alias("n")).where("n > 1").count() == 0
    scaled = transform.scale_per_group(found, "condition", ["s2"])
    limits = scaled.groupBy("condition").agg(F.min("s2").alias("lo"), F.max("s2").alias("hi")).collect()
    assert len(limits) == 3 and all((r.lo, r.hi) == (0.0, 1.0) for r in limits)


def cycle_lines(units, start=0):
    """Sensors that rise towards the end of life; unit u lives 40 + u cycles."""
    lines = []
    for u in range(1, units + 1):
        life = 40 + u
        for c in range(1, life + 1 - start):
            wear = c / life
            values = [100 + i + 10 * wear * ((i % 5) + 1) + ((c * 7 + u + i) % 5) / 10 for i in range(21)]
            lines.append(" ".join(map(str, [u, c, 0.1, 0.2, 100.0, *values])) + "  ")
    return lines


def test_batch_run(spark):
    train = write_lines(spark, cycle_lines(12))
    test, truth = write_lines(spark, cycle_lines(8, start=15)), write_lines(spark, ["15 "] * 8)
    batch = BatchRun(spark, shared.scratch(spark, "run"), trees=3)
    assert batch.run(train, test, truth) is True
    results = spark.read.parquet(f"{batch.work}/results")
    assert results.count() == 8 and results.where("true_rul <> 15").count() == 0
    silver = spark.read.parquet(f"{batch.work}/silver/train")
    assert silver.columns == ["unit", "cycle", "os1", "os2", *config.SENSORS, "RUL"]
    low, high = silver.agg(F.min("s2"), F.max("s2")).first()
    assert (low, high) == (0.0, 1.0)
    known = spark.read.json(f"{batch.work}/feature_config").first()
    assert (known.sensors, known.window_size, known.rul_clip) == (list(config.SENSORS), 30, 125)
    assert known.n_sensors == len(known.data_min) == len(known.data_range) == 11
    gold = spark.read.parquet(f"{batch.work}/gold/train")
    assert {r.split: r.n for r in gold.groupBy("split").agg(F.count_distinct("unit").alias("n")).collect()} == {"val": 3, "train": 9}
    assert batch.ingest(test, test, test) and spark.read.parquet(f"{batch.work}/bronze/train").count() == len(cycle_lines(12))


@pytest.mark.parametrize("damage, failed", [("cut", "train_column_count"), ("text", "train_numeric"), ("order", "train_cycle_order"), ("truth", "truth_negative")])
def test_batch_run_stops_on_bad_input(spark, damage, failed):
    lines, truth = cycle_lines(2), ["15"] * 2
    if damage == "cut":
        lines[3] = lines[3].rsplit(None, 1)[0]
    if damage == "text":
        lines[3] = lines[3].replace("0.2", "abc")
    if damage == "order":
        lines[3], lines[4] = lines[4], lines[3]
    if damage == "truth":
        truth[1] = "-1"
    batch = BatchRun(spark, shared.scratch(spark, "run"))
    bronze = batch.ingest(write_lines(spark, lines), write_lines(spark, cycle_lines(2)), write_lines(spark, truth))
    batch.parse(bronze)
    with pytest.raises(ValidationError, match=failed):
        batch.validate(bronze)
    assert spark.read.json(f"{batch.work}/status").first().status == "failed"


@pytest.mark.parametrize("n", [0, 1, 7, 500, 4000, 9000])
def test_newest_rows(spark, n):
    """Offsets with gaps, nulls and repeats; more rows wanted than there are."""
    offset = F.when(F.col("id") % 400 == 0, None).otherwise(F.col("id") * F.col("id") - F.col("id") % 2 * 3).alias("offset")
    rows = spark.range(8000).select("id", offset)
    got = [r.offset for r in E.retain_newest(rows, "offset", n).collect()]
    want = sorted((r.offset for r in rows.collect()), key=lambda x: (x is not None, x or 0), reverse=True)[:n]
    assert got == want
    assert E.retain_newest(rows.limit(0), "offset", n).count() == 0


def test_retention_skips_row_groups(spark):
    """The bound reaches the scan as a plain value, and row groups below it aren't read."""
    path = shared.scratch(spark, "offsets")
    spark.range(200_000).coalesce(1).write.option("parquet.block.size", 64 * 1024).parquet(path)
    kept = E.retain_newest(spark.read.parquet(path), "id", 1000)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id," in plan
    assert sorted(r.id for r in kept.collect()) == list(range(199_000, 200_000))
