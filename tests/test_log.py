"""The polled log: bounded polls, positions by partition, and Kafka's options."""

import json

import pytest
from pyspark.sql import functions as F

from cyclewise import shared
from cyclewise.sources import log
from cyclewise.streaming import jobs

SCHEMA = "engine string, n long, at timestamp, partition int, offset long"


def messages(spark, first, last):
    engine = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("e"), F.col("id") % 7))
    return spark.range(first, last).select(engine.alias("engine"), F.col("id").alias("n"), F.timestamp_millis(F.col("id") * 1000).alias("at"))


def polls(spark, path, out, checkpoint, rows):
    """Sizes of the polls of one run to the end of the log."""
    stream = log.polled(spark, path, SCHEMA, rows)
    query = jobs.run_until_done(stream.writeStream.format("parquet").option("path", out), checkpoint)
    return [p.numInputRows for p in query.recentProgress if p.numInputRows]


@pytest.fixture
def paths(spark):
    return [shared.scratch(spark, name) for name in ("log", "out", "checkpoint")]


def test_at_most_two_hundred_rows_a_poll(spark, paths):
    log.append(messages(spark, 0, 1010), paths[0], 1, "engine", ["n"])
    taken = polls(spark, *paths, log.POLL_ROWS)
    assert taken == [200, 200, 200, 200, 200, 10]
    assert polls(spark, *paths, log.POLL_ROWS) == []  # a new reader goes on from the position kept
    log.append(messages(spark, 1010, 1300), paths[0], 1, "engine", ["n"])
    assert polls(spark, *paths, log.POLL_ROWS) == [200, 90]
    assert sorted(r.n for r in spark.read.parquet(paths[1]).collect()) == list(range(1300))


def test_partitions_and_order(spark, paths):
    """One partition for each key, offsets without gaps along the order of arrival, also over several appends."""
    for first in (0, 400, 500):
        log.append(messages(spark, first, first + 400 if first == 0 else first + 100), paths[0], 4, "engine", ["n"])
    taken = polls(spark, *paths, 90)
    assert sum(taken) == 600 and max(taken) <= 90
    rows = spark.read.parquet(paths[1]).collect()
    homes = {}
    for r in rows:
        homes.setdefault(r.engine, set()).add(r.partition)
        assert r["at"].timestamp() == r.n
    assert all(len(p) == 1 for p in homes.values()) and None in homes
    for p in {r.partition for r in rows}:
        mine = sorted((r.offset, r.n) for r in rows if r.partition == p)
        assert [o for o, _ in mine] == list(range(1, len(mine) + 1)) and [n for _, n in mine] == sorted(n for _, n in mine)


def test_a_failed_poll_is_repeated(spark, paths):
    log.append(messages(spark, 0, 500), paths[0], 2, "engine", ["n"])
    calls = []

    def fails_once(rows, batch):
        calls.append((batch, sorted(r.n for r in rows.collect())))
        if len(calls) == 2:
            raise RuntimeError("lost the sink")

    run = lambda: jobs.run_until_done(jobs.each_batch(log.polled(spark, paths[0], SCHEMA, 200), fails_once), paths[2])
    with pytest.raises(Exception, match="lost the sink"):
        run()
    run()
    assert [b for b, _ in calls] == [0, 1, 1, 2] and calls[1] == calls[2]
    assert sorted(n for b, ns in calls[2:] + calls[:1] for n in ns) == list(range(500))


def test_reading_begins_behind_a_start(spark, paths):
    log.append(messages(spark, 0, 300), paths[0], 1, "engine", ["n"])
    stream = log.polled(spark, paths[0], SCHEMA, 1000, start={"0": 250})
    jobs.run_until_done(stream.writeStream.format("parquet").option("path", paths[1]), paths[2])
    assert sorted(r.offset for r in spark.read.parquet(paths[1]).collect()) == list(range(251, 301))


def test_shares():
    assert log.shares({"0": 5, "1": 500, "2": 500}, 200) == {"0": 5, "1": 98, "2": 97}
    assert log.shares({"0": 0, "1": 3}, 200) == {"0": 0, "1": 3}
    assert sum(log.shares({str(p): 50 for p in range(7)}, 3).values()) == 3
    assert log.shares({}, 10) == {}


def test_tasks_are_bounded(monkeypatch):
    monkeypatch.setattr(log, "TASK_ROWS", 40)
    reader = log.LogReader("/nowhere", 200, None)
    parts = reader.partitions({"0": 10}, {"0": 100, "1": 30})
    assert [(p.partition, p.after, p.upto) for p in parts] == [(0, 10, 50), (0, 50, 90), (0, 90, 100), (1, 0, 30)]
    assert reader.position == {"0": 100, "1": 30}


def test_an_empty_log(spark, paths):
    assert log.LogReader(paths[0], 200, None).ends() == {} and log.LogReader(paths[0], 200, None).latestOffset() == {}


def test_kafka_options():
    plain = log.kafka_options("b1:9092,b2:9092", "telemetry.raw")
    assert plain == {
        "kafka.bootstrap.servers": "b1:9092,b2:9092", "subscribe": "telemetry.raw", "startingOffsets": "earliest", "failOnDataLoss": "true",
    }
    full = log.kafka_options("b:1", "t", 5000, {0: 41, 2: 0}, "group", {"security.protocol": "SSL", "kafka.client.id": "x"})
    assert json.loads(full["startingOffsets"]) == {"t": {"0": 42, "1": -2, "2": 1}}
    assert full["maxOffsetsPerTrigger"] == "5000" and full["kafka.group.id"] == "group"
    assert full["kafka.security.protocol"] == "SSL" and full["kafka.client.id"] == "x"
    with pytest.raises(ValueError):
        log.kafka_options("b:1", "t", start={-1: 0})


def test_messages_in_log_order(spark):
    rows = spark.createDataFrame([(bytearray(b"ENG-1"), bytearray(b"{}"), 3, 17, "t")], "key binary, value binary, partition int, offset long, topic string")
    assert log.in_log_order(rows).first().asDict() == {"key": "ENG-1", "value": "{}", "partition": 3, "arrival": 17}


def test_a_poll_opens_only_the_files_it_takes_from(spark, paths, monkeypatch):
    """Files are bounded, and a poll's work doesn't grow with the log behind and before it."""
    monkeypatch.setattr(log, "TASK_ROWS", 100)
    log.append(messages(spark, 0, 1000), paths[0], 1, "engine", ["n"])
    reader = log.LogReader(paths[0], 150, None)
    assert len(reader._spans()) == 10
    ranges = reader.partitions({"0": 250}, {"0": 400})
    assert [(r.after, r.upto) for r in ranges] == [(250, 350), (350, 400)]
    held = [sorted(reader._spans()[f][1:] for f in r.files) for r in ranges]
    assert held == [[(201, 300), (301, 400)], [(301, 400)]]
    assert sum(polls(spark, *paths, 150)) == 1000
    assert sorted(r.n for r in spark.read.parquet(paths[1]).collect()) == list(range(1000))


def test_a_poll_grows_with_the_table_within_bounds():
    from cyclewise.plans.q_stream import poll_rows

    assert [poll_rows(n, 16, 2_000, 500_000) for n in (0, 10_000, 100_000, 6_000_000, 36_000_000)] == [2_000, 2_000, 6_250, 375_000, 500_000]
