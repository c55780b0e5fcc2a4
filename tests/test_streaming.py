"""A stream must give what the batch operators give, however the input is cut into micro-batches."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclewise import config, shared
from cyclewise.operators import windows
from cyclewise.plans import catalog
from cyclewise.sources import events as E
from cyclewise.streaming import jobs, sinks, state

SCHEMA = "engine_id string, cycle long, event_time_ms long, arrival long, x array<float>"
SIZE = 4


def make_rows(n=300, engines=6):
    """Late and duplicate cycles; one engine owns a third of the rows."""
    rng = random.Random(8)
    clock = dict.fromkeys(range(engines), 0)
    rows = []
    for i in range(n):
        e = 0 if rng.random() < 0.34 else rng.randrange(1, engines)
        clock[e] += rng.choice([1, 1, 2])
        cycle = clock[e] if rng.random() < 0.75 else max(0, clock[e] - rng.randrange(0, 4))
        rows.append((f"ENG-{e}", cycle, 1_700_000_000_000 + i * 600_000, i, [float(i), float(e)]))
    return rows


def expected(rows):
    seen, kept, out = {}, {}, []
    for engine, cycle, ms, _, x in rows:
        if engine in seen and cycle <= seen[engine]:
            continue
        seen[engine] = cycle
        kept.setdefault(engine, []).append(x)
        if len(kept[engine]) >= SIZE:
            out.append((engine, cycle, ms, [v for r in kept[engine][-SIZE:] for v in r]))
    return sorted(out)


def write_in_order(spark, rows, pieces, path):
    step = -(-len(rows) // pieces)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, per_trigger=1):
    schema = T._parse_datatype_string(SCHEMA)
    return E.stream(spark, "parquet", schema=schema, path=path, per_trigger=per_trigger)


def result(df):
    return sorted((r.engine_id, r.cycle, r.event_time, r.features) for r in df.collect())


def rolled(spark, path, out=None, checkpoint=None, **more):
    job = jobs.RollingFeatures(spark, out or shared.scratch(spark, "out"), 2, SIZE, **more)
    jobs.run_bounded(job.writer(stream(spark, path)), checkpoint or shared.scratch(spark, "ckpt"))
    return job


@pytest.mark.parametrize("pieces, piece_rows", [(1, 256), (3, 256), (3, 7), (1, 1)])
def test_rolling(spark, pieces, piece_rows, monkeypatch):
    monkeypatch.setattr(state.Roller.__init__, "__defaults__", (None, piece_rows))
    rows, path = make_rows(), shared.scratch(spark, "in")
    write_in_order(spark, rows, pieces, path)
    with jobs.Counters(spark) as counters:
        job = rolled(spark, path)
    want = expected(rows)
    assert result(job.vectors()) == want
    counted = counters.totals()
    assert (counted["processed"], counted["emitted"], counted["engines"]) == (300, len(want), 6)
    assert counted["accepted"] == counters.table(*job.COUNTERS).first().accepted > counted["emitted"]


def test_counting_takes_no_jobs(spark):
    """A batch is one job for its rows and none for its counters."""
    rows, path = make_rows(), shared.scratch(spark, "in")
    write_in_order(spark, rows, 3, path)

    def jobs_of(stream_of):
        query = jobs.run_bounded(stream_of.writeStream.format("noop"), shared.scratch(spark, "ckpt"))
        assert len(query.recentProgress) >= 3
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId)))

    job = jobs.RollingFeatures(spark, shared.scratch(spark, "out"), 2, SIZE)
    plain = jobs_of(state.rolling_vectors(stream(spark, path), 2, SIZE))
    with jobs.Counters(spark) as counters:
        assert jobs_of(job.stream(stream(spark, path))) == plain
    assert counters.totals()["processed"] == 300


@pytest.mark.parametrize("pieces", [1, 3])
def test_rolling_state(spark, pieces):
    rows, path, out = make_rows(), shared.scratch(spark, "in"), shared.scratch(spark, "out")
    write_in_order(spark, rows, pieces, path)
    vectors = state.rolling_vectors(stream(spark, path), 2, SIZE)
    jobs.run_bounded(vectors.writeStream.format("parquet").option("path", out), shared.scratch(spark, "ckpt"))
    assert result(spark.read.parquet(out)) == expected(rows)


def test_a_hot_engine(spark):
    """One engine owns a third of a batch and comes in many Arrow batches: its accepted rows pass one task as pieces of
    a bounded size, and its windows are written by several tasks."""
    rows = [(f"ENG-{0 if i % 3 == 0 else i % 40}", i, i, i, [float(i), 0.0]) for i in range(9000)]
    path, out = shared.scratch(spark, "in"), shared.scratch(spark, "out")
    write_in_order(spark, rows, 1, path)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        pieces = state.accepted_pieces(stream(spark, path), 2, SIZE)
        told = state.windows_of(pieces, 2, SIZE).withColumn("task", F.spark_partition_id())
        jobs.run_bounded(told.writeStream.format("parquet").option("path", out), shared.scratch(spark, "ckpt"))
        kept = shared.scratch(spark, "pieces")
        jobs.run_bounded(pieces.writeStream.format("parquet").option("path", kept), shared.scratch(spark, "ckpt"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert result(spark.read.parquet(out)) == expected(rows)
    assert spark.read.parquet(out).where("engine_id = 'ENG-0'").select("task").distinct().count() > 1
    sizes = spark.read.parquet(kept).select("fresh", F.size("readings").alias("n")).collect()
    assert max(r.fresh for r in sizes) <= state.PIECE_ROWS and max(r.n for r in sizes) <= 2 * (state.PIECE_ROWS + SIZE - 1)


class Held:
    """What a processor sees of its state."""

    def __init__(self):
        self.values, self.timers = {}, set()

    def getValueState(self, name, schema, ttl=None):
        return self.getListState(name, schema, ttl)

    def getListState(self, name, schema, ttl=None):
        held = self

        class State:
            def get(self):
                return held.values.get(name, [] if name in ("tail", "counts", "runs") else None)

            def put(self, value):
                held.values[name] = value

            update = put

            def clear(self):
                held.values.pop(name, None)

        return State()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_state_of_an_engine():
    """The last rows and the last cycle, and nothing else, whatever the number of rows; a row with no news leaves them alone."""
    held, roller = Held(), state.Roller(SIZE, 2)
    roller.init(held)
    frame = lambda cycles: pd.DataFrame({"engine_id": "a", "cycle": cycles, "event_time_ms": cycles, "arrival": range(len(cycles)), "x": [[float(c), 0.0] for c in cycles]})
    assert sum(p["fresh"].iloc[0] for p in roller.handleInputRows(("a",), iter([frame([1, 5, 3]), frame([])]), None)) == 2
    assert held.values["last"] == (5,) and [x[0][0] for x in held.values["tail"]] == [1.0, 5.0]
    before = dict(held.values)
    assert list(roller.handleInputRows(("a",), iter([frame([5, 4])]), None)) == [] and held.values == before
    list(roller.handleInputRows(("a",), iter([frame(list(range(6, 60)))]), None))
    assert held.values["last"] == (59,) and [x[0][0] for x in held.values["tail"]] == [57.0, 58.0, 59.0]


def test_settings_of_the_session_stay(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with state.rocksdb(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before


def silences_by_hand(rows, span):
    out, newest = [], max(t for _, t in rows)
    for engine in {e for e, _ in rows}:
        times = sorted({t for e, t in rows if e == engine}) + [newest]
        out += [(engine, a, a + span) for a, b in zip(times, times[1:]) if b - a > span]
    return sorted(out)


@pytest.mark.parametrize("pieces", [1, 4, 11])
def test_silence_is_told_by_the_stream(spark, pieces):
    rng = random.Random(9)
    rows = sorted(((f"e{rng.randrange(5)}", rng.randrange(0, 400_000)) for _ in range(60)), key=lambda r: r[1])
    path, out = shared.scratch(spark, "in"), shared.scratch(spark, "out")
    step = -(-len(rows) // pieces)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], "engine_id string, t long").coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema("engine_id string, t long").option("maxFilesPerTrigger", 1).parquet(path)
    told = state.silences(events.select("engine_id", F.timestamp_millis("t").alias("event_time")), 20)
    jobs.run_bounded(told.writeStream.format("parquet").option("path", out), shared.scratch(spark, "ckpt"))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == silences_by_hand(rows, 20_000)


def test_silence_with_events_out_of_order():
    """Runs are joined whatever the order of the batches; only the end of a run waits on a timer."""
    held, watch = Held(), state.SilenceWatch(50)
    watch.init(held)
    for times in ([100], [0, 30], [60, 200], [5]):
        list(watch.handleInputRows(("a",), iter([pd.DataFrame({"event_time_ms": times})]), None))
    assert held.values["runs"] == [(0, 100), (200, 200)] and held.timers == {151, 251}

    class Expired:
        def getExpiryTimeInMs(self):
            return 151

    (row,) = watch.handleExpiredTimer(("a",), None, Expired())
    assert row.iloc[0].to_dict() == {"engine_id": "a", "last_ms": 100, "silent_ms": 150} and held.values["runs"] == [(200, 200)]


def test_runs_of_many_engines_are_joined_at_once():
    rng = random.Random(4)
    runs = [(rng.choice(["a", "b", "c", None]), t, t + rng.choice([0, 0, 40])) for t in (rng.randrange(2_000) for _ in range(150))]
    got = state.joined_runs(pd.DataFrame(runs, columns=["engine_id", "first", "last"]), 9)
    found = sorted(zip(got["engine_id"].fillna(""), got["first"].tolist(), got["last"].tolist()))
    want = [(e or "", *run) for e in ("a", "b", "c", None) for run in state.merged_runs([r[1:] for r in runs if r[0] == e], 9)]
    assert found == sorted(want) and len(found) < len(runs)


@pytest.mark.parametrize("join_rows", [1, 65_536])
def test_silence_of_a_group_waits_on_one_timer(monkeypatch, join_rows):
    """Timers are set at most once a batch, however many engines there are and however often they fall silent."""
    monkeypatch.setattr(state.SilenceGroups, "JOIN_ROWS", join_rows)
    engines = [f"e{i}" for i in range(300)]
    held, watch, registered = Held(), state.SilenceGroups(50), []
    monkeypatch.setattr(held, "registerTimer", lambda at: (registered.append(at), held.timers.add(at)))
    watch.init(held)
    for times in ([100], [0, 30], [60, 200], [5]):
        frames = [pd.DataFrame({"group": 3, "engine_id": some, "event_time_ms": t}) for t in times for some in (engines[:100], engines[100:])]
        assert list(watch.handleInputRows((3,), iter(frames), None)) == []
    assert held.timers == {151} and registered == [151, 81, 151]

    class Passed:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    def expired(at):
        held.timers.clear()
        return sorted(tuple(r) for told in watch.handleExpiredTimer((3,), Passed(at), None) for r in told.itertuples(index=False))

    assert expired(250) == sorted((e, 100, 150) for e in engines) and held.timers == {251}
    assert expired(251) == sorted((e, 200, 250) for e in engines) and not held.timers and not held.values


@pytest.mark.parametrize("groups", [1, 7, state.SILENCE_GROUPS])
def test_silence_with_events_that_lack_an_engine_or_a_time(spark, groups):
    """Events without an engine are those of one engine; those without a time say nothing."""
    rng = random.Random(3)
    rows = sorted(((rng.choice(["a", "b", None]), rng.randrange(0, 400_000)) for _ in range(60)), key=lambda r: r[1])
    path, out = shared.scratch(spark, "in"), shared.scratch(spark, "out")
    for i in range(0, 60, 20):
        part = [*rows[i : i + 20], ("a", None), (None, None)]
        spark.createDataFrame(part, "engine_id string, t long").coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema("engine_id string, t long").option("maxFilesPerTrigger", 1).parquet(path)
    told = state.silences(events.select("engine_id", F.timestamp_millis("t").alias("event_time")), 20, groups=groups)
    jobs.run_bounded(told.writeStream.format("parquet").option("path", out), shared.scratch(spark, "ckpt"))
    found = [(r.engine_id or "", r.last_ms, r.silent_ms) for r in spark.read.parquet(out).collect()]
    assert sorted(found) == silences_by_hand([(e or "", t) for e, t in rows], 20_000)


def rule_by_hand(rows, step, span, limit, hold):
    """(label, step, n, state) at each closed step."""
    newest, out = max(t for _, t in rows), []
    for label in {x for x, _ in rows}:
        ends = [-(-t // (step * 1000)) * step for x, t in rows if x == label]
        since = None
        for at in range(min(ends), newest // 1000 + 1, step):
            if at * 1000 >= newest:
                break
            n = sum(at - span < e <= at for e in ends)
            if n > limit:
                started, since = since is None, at if since is None else since
                if at - since >= hold:
                    out.append((label, at, n, "firing", since))
                elif started:
                    out.append((label, at, n, "pending", since))
            else:
                if since is not None and at - step - since >= hold:
                    out.append((label, at, n, "resolved", since))
                since = None
    return sorted(out)


@pytest.mark.parametrize("pieces", [1, 5, 17])
def test_rule_goes_through_its_states(spark, pieces):
    rng = random.Random(10)
    rows = sorted((rng.choice("ab"), int(rng.gauss(rng.choice([150_000, 600_000]), 40_000)) % 1_000_000) for _ in range(200))
    rows = sorted(rows + [("b", 30_000_000)], key=lambda r: r[1])
    path, out = shared.scratch(spark, "in"), shared.scratch(spark, "out")
    size = -(-len(rows) // pieces)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], "label string, t long").coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema("label string, t long").option("maxFilesPerTrigger", 1).parquet(path)
    told = state.rule_states(events.select("label", F.timestamp_millis("t").alias("event_time")), 10, 30, 5, 40)
    jobs.run_bounded(told.writeStream.format("parquet").option("path", out), shared.scratch(spark, "ckpt"))
    want = rule_by_hand(rows, 10, 30, 5, 40)
    assert {r[3] for r in want} == {"pending", "firing", "resolved"}
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want


def test_rule_for_labels_never_seen():
    with pytest.raises(ValueError, match="without events"):
        state.RuleWatch(10, 30, -1, 40)


def test_thirty_events_give_one_vector(spark):
    """30 events of 11 sensors: one vector of 330 numbers."""
    rows = [("DRY-RUN-1", i + 1, 1_700_000_000_000, i, [float(i)] * 11) for i in range(30)]
    path = shared.scratch(spark, "in")
    write_in_order(spark, rows, 1, path)
    job = jobs.RollingFeatures(spark, shared.scratch(spark, "out"), 11)
    jobs.run_bounded(job.writer(stream(spark, path)), shared.scratch(spark, "ckpt"))
    only = job.vectors().collect()
    assert len(only) == 1 and len(only[0].features) == 330
    assert (only[0].window_size, only[0].n_sensors, only[0].cycle) == (30, 11, 30)


def test_restart_and_new_files(spark):
    rows, path, checkpoint = make_rows(), shared.scratch(spark, "in"), shared.scratch(spark, "ckpt")
    out = shared.scratch(spark, "out")
    for part in (rows[:130], rows[130:]):
        write_in_order(spark, part, 2, path)
        job = rolled(spark, path, out, checkpoint)
    assert result(job.vectors()) == expected(rows)


def test_running_on_and_on(spark):
    rows, path, out = make_rows(), shared.scratch(spark, "in"), shared.scratch(spark, "out")
    write_in_order(spark, rows[:150], 1, path)
    job = jobs.RollingFeatures(spark, out, 2, SIZE)
    query = jobs.run_forever(job.writer(stream(spark, path)), shared.scratch(spark, "ckpt"), "0 seconds")
    try:
        query.processAllAvailable()
        write_in_order(spark, rows[150:], 1, path)
        query.processAllAvailable()
    finally:
        query.stop()
    assert result(job.vectors()) == expected(rows)


def test_a_failing_sink_leaves_the_batch_to_be_repeated(spark):
    rows, path, checkpoint = make_rows(), shared.scratch(spark, "in"), shared.scratch(spark, "ckpt")
    write_in_order(spark, rows, 3, path)
    out, calls = shared.scratch(spark, "out"), []

    def breaks_once(vectors, batch):
        sinks.write_batch(vectors, f"{out}/vectors", batch)
        calls.append(batch)
        if calls == [0, 1]:
            raise RuntimeError("lost the sink")

    with pytest.raises(Exception, match="lost the sink"):
        rolled(spark, path, out, checkpoint, on_vectors=breaks_once)
    job = rolled(spark, path, out, checkpoint, on_vectors=breaks_once)
    assert calls == [0, 1, 1, 2] and result(job.vectors()) == expected(rows)


def test_stream_equals_batch(spark):
    rows = make_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    kept = windows.drop_late(df, unit="engine_id")
    arrays = windows.rolling_arrays(kept, "x", SIZE, unit="engine_id", carry=["event_time_ms"])
    flat = arrays.select("engine_id", "cycle", F.col("event_time_ms").alias("event_time"), F.flatten("features").alias("features"))
    assert result(flat) == expected(rows)


def test_offline_and_online(spark):
    rows, path = make_rows(), shared.scratch(spark, "in")
    write_in_order(spark, rows, 3, path)
    offline = shared.scratch(spark, "offline")
    store = jobs.OnlineStore(spark, shared.scratch(spark, "online"))
    both = jobs.fan_out(store, lambda vectors, batch: sinks.write_offline(vectors, offline, batch))
    rolled(spark, path, on_vectors=both)
    want = expected(rows)
    filed = spark.read.parquet(offline)
    assert result(filed) == want
    wrong = filed.where(F.date_format(F.timestamp_millis("event_time"), "yyyy-MM-dd HH") != F.format_string("%s %02d", F.col("date").cast("string"), F.col("hour")))
    assert wrong.count() == 0
    newest = {}
    for engine, cycle, ms, x in want:
        newest[engine] = max(newest.get(engine, (0,)), (cycle, ms, x))
    assert {r.engine_id: (r.cycle, r.event_time, r.features) for r in store.read().collect()} == newest


def test_the_registered_fan_out_files_whole_vectors(spark, tmp_path, monkeypatch):
    """Both tables hold the readings of a window, not the offline one its cycle alone; that one is filed by hour."""
    made, scratch = {}, shared.scratch
    monkeypatch.setattr(shared, "scratch", lambda session, name: made.setdefault(name, scratch(session, name)))
    at = datetime.datetime(2024, 1, 1)
    events = [(i, at + datetime.timedelta(minutes=50 * i), i % 2, "view", i / 4, f'{{"k": {i % 7}}}') for i in range(80)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    told = {r.engine_id: r for r in catalog.queries()["stream_fanout"](spark, str(tmp_path)).collect()}
    want = []
    for unit in range(2):
        rows = [(i, ts, [value, float(i % 7)]) for i, ts, user, _, value, _ in events if user == unit]
        for n in range(30, len(rows) + 1):
            i, ts, _ = rows[n - 1]
            want.append((f"ENG-{unit}", i, ts.strftime("%Y-%m-%d"), f"{ts:%H}", [x for r in rows[n - 30 : n] for x in r[2]]))
    filed = spark.read.schema(jobs.RollingFeatures.VECTORS + ", date string, hour string").parquet(made["offline"])
    assert sorted((r.engine_id, r.cycle, r.date, r.hour, r.features) for r in filed.collect()) == sorted(want)
    assert {e: (r.offline_vectors, r.online_cycle) for e, r in told.items()} == {"ENG-0": (11, 78), "ENG-1": (11, 79)}


ALERTS = "engine_id string, risk_level string, failure_risk double, remaining_cycles int, event_time_ms long, arrival long"


class Alerts:
    """A book and its stream, to which batches of predictions are given one after the other."""

    def __init__(self, spark):
        self.spark, self.path, self.checkpoint = spark, shared.scratch(spark, "predictions"), shared.scratch(spark, "ckpt")
        self.book = jobs.AlertBook(spark, shared.scratch(spark, "book"))

    def give(self, *rows):
        self.spark.createDataFrame(rows, ALERTS).coalesce(1).write.mode("append").parquet(self.path)
        jobs.run_bounded(self.book.writer(self.spark.readStream.schema(ALERTS).parquet(self.path)), self.checkpoint)

    def told(self):
        return sorted((r.engine_id, r.event_time_ms, r.acknowledged) for r in self.book.read().collect())


def test_alert_book(spark):
    alerts = Alerts(spark)
    alerts.give(("a", "CRITICAL", 0.9, 9, 2, 2), ("a", "HIGH", 0.7, 30, 1, 1), ("b", "LOW", 0.1, 99, 3, 3))
    alerts.give(("a", "CRITICAL", 0.95, 5, 4, 4), ("b", "HIGH", 0.6, 50, 5, 5))
    got = sorted((r.engine_id, r.failure_risk, r.event_time_ms, r.acknowledged) for r in alerts.book.read().collect())
    assert got == [("a", 0.7, 1, False), ("b", 0.6, 5, False)]


def test_a_batch_rewrites_only_the_buckets_it_touches(spark):
    table = sinks.Snapshot(spark, shared.scratch(spark, "snapshot"), "engine_id string, x int")
    frame = lambda rows: spark.createDataFrame(rows, "engine_id string, x int")
    first = frame([(f"e{i}", i) for i in range(200)])
    table.replace(0, first)
    before = table._written()
    assert len(before) > 50 and {tuple(b) for b in before.values()} == {(0,)}
    for batch in (1, 2, 3):
        one = frame([("e7", 100 * batch)])
        (bucket,) = table.touched(one)
        rest = table.before(batch, [bucket]).where("engine_id != 'e7'")
        table.replace(batch, rest.union(one))
    after = table._written()
    assert {b for b in after if after[b] != [0]} == {bucket} and after[bucket] == [2, 3]  # older folders are gone
    rows = {r.engine_id: r.x for r in table.latest().collect()}
    assert rows == {f"e{i}": i for i in range(200)} | {"e7": 300}
    assert {r.x for r in table.before(3, [bucket]).where("engine_id = 'e7'").collect()} == {200}  # a repeat finds its input


def test_alerts_again_after_acknowledging(spark):
    alerts = Alerts(spark)
    batch = lambda n: [("a", "HIGH", 0.7, 30, n, n), ("b", "HIGH", 0.7, 30, n, n)]
    alerts.give(*batch(1))
    engines = spark.createDataFrame([("a",), ("unknown",)], "engine_id string")
    alerts.book.acknowledge(engines)
    alerts.book.acknowledge(engines)
    assert alerts.told() == [("a", 1, True), ("b", 1, False)]
    alerts.give(*batch(2))
    alerts.give(*batch(3))
    assert alerts.told() == [("a", 1, True), ("a", 2, False), ("b", 1, False)]


def test_an_acknowledgement_said_again_changes_nothing(spark):
    """One that names an alert closed before doesn't touch the next alert; engines without an open alert hold no state."""
    held, keeper = Held(), state.AlertKeeper()
    keeper.init(held)
    frame = lambda *rows: iter([pd.DataFrame(rows, columns=["engine_id", *keeper.FIELDS, "acknowledges"])])
    risky = lambda n: ("a", "HIGH", 0.7, 30, n, n, None)
    ack = lambda n: ("a", None, None, None, None, None, n)
    events = lambda rows: [tuple(r) for out in keeper.handleInputRows(("a",), rows, None) for r in out[["event", "arrival"]].values.tolist()]
    assert events(frame(risky(5), risky(4))) == [("raised", 4)]
    assert events(frame(ack(4), risky(6), ack(4))) == [("closed", 4), ("raised", 6)]
    assert events(frame(ack(4), risky(7))) == [] and held.values["open"] == (6,)
    assert events(frame(ack(6))) == [("closed", 6)] and held.values == {}


def test_expired_engines_are_not_scored(spark):
    store = jobs.OnlineStore(spark, shared.scratch(spark, "online"), clock=F.col("event_time"), ttl=10)
    path = shared.scratch(spark, "fleet")
    fleet = jobs.FleetSnapshots(store, path, lambda x: F.lit(0.0), now_ms=F.lit(20_000))
    rows = [("old", 1, 9_999, [0.0], 1, 1), ("new", 1, 10_000, [0.0], 1, 1)]
    fleet(spark.createDataFrame(rows, store.SCHEMA.replace(", updated_at_ms long", "")), 0)
    for kind in ("telemetry", "predictions", "alerts"):
        assert [r.engine_id for r in spark.read.parquet(f"{path}/{kind}").collect()] == ["new"]


def test_old_snapshots_go(spark):
    store = jobs.OnlineStore(spark, shared.scratch(spark, "online"), clock=F.col("event_time"), ttl=100, buckets=3)
    path = shared.scratch(spark, "fleet")
    snapshots = jobs.FleetSnapshots(store, path, lambda x: F.lit(0.0), now_ms=F.lit(0), keep=2)
    for batch in (0, 1, 2, 2, 3):
        rows = [(f"e{batch}", 1, 5, [0.0], 1, 1)]
        snapshots(spark.createDataFrame(rows, store.SCHEMA.replace(", updated_at_ms long", "")), batch)
    for kind in ("telemetry", "predictions", "alerts"):
        assert {r.batch for r in spark.read.parquet(f"{path}/{kind}").select("batch").distinct().collect()} == {2, 3}
    assert {r.engine_id for r in store.read().collect()} == {"e0", "e1", "e2", "e3"} and len(store.rows._written()) <= 3


@pytest.mark.parametrize("by", ["event_time", "ingest"])
def test_offline_folders(spark, by):
    """Filed under the vector's own hour, or under the hour of writing; a repeated batch replaces its files."""
    path = shared.scratch(spark, "offline")
    rows = spark.createDataFrame([("a", 1, 3_600_000 * 24 + 1, [0.0], 1, 1), ("b", 2, 3_600_000 * 30, [0.0], 1, 1)], jobs.RollingFeatures.VECTORS)
    start = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH")).first()[0]
    for _ in range(2):
        sinks.write_offline(rows, path, 7, by=by)
    end = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH")).first()[0]
    hour = F.format_string("%s %02d", F.col("date").cast("string"), F.col("hour"))
    filed = {r.engine_id: r.filed for r in spark.read.parquet(path).select("engine_id", hour.alias("filed")).collect()}
    assert spark.read.parquet(path).count() == 2
    if by == "event_time":
        assert filed == {"a": "1970-01-02 00", "b": "1970-01-02 06"}
    else:
        assert set(filed.values()) <= {start, end}


def test_snapshots_at_their_own_intervals(spark):
    """Telemetry every two seconds, predictions and alerts every five, on batches a second apart."""
    seconds = iter([0.0, 1.0, 2.0, 3.5, 4.0, 5.0, 11.0])
    store = jobs.OnlineStore(spark, shared.scratch(spark, "online"), clock=F.col("event_time"), ttl=100, buckets=2)
    path = shared.scratch(spark, "fleet")
    snapshots = jobs.FleetSnapshots(
        store, path, lambda x: F.lit(0.0), now_ms=F.lit(0), every=jobs.FleetSnapshots.INTERVALS, clock=lambda: next(seconds)
    )
    for batch in range(7):
        rows = [(f"e{batch}", 1, 5, [0.0], 1, 1)]
        snapshots(spark.createDataFrame(rows, store.SCHEMA.replace(", updated_at_ms long", "")), batch)
    told = {kind: sorted({r.batch for r in spark.read.parquet(f"{path}/{kind}").select("batch").distinct().collect()}) for kind in snapshots.KINDS}
    assert told == {"telemetry": [0, 2, 4, 6], "predictions": [0, 5, 6], "alerts": [0, 5, 6]}
    assert spark.read.parquet(f"{path}/alerts/batch=5").count() == 6


def test_a_batch_leaves_few_files_in_a_folder(spark):
    """A stream's own plan isn't adaptive, but its batches are: an hour's vectors aren't spread over all tasks that write."""
    rows = [(f"ENG-{i % 5}", i, 1_700_000_000_000 + i * 600_000, i, [float(i), 0.0]) for i in range(400)]
    path, out = shared.scratch(spark, "rows"), shared.scratch(spark, "offline")
    write_in_order(spark, rows, 1, path)
    rolled(spark, path, on_vectors=lambda vectors, batch: sinks.write_offline(vectors, out, batch))
    files = [r.f for r in spark.read.parquet(out).select(F.input_file_name().alias("f")).distinct().collect()]
    assert len({f.rsplit("/", 1)[0] for f in files}) > 60 and len(files) < 80
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_state_is_kept_in_a_few_parts_for_each_core(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "200")
    try:
        with state.rocksdb(spark):
            assert int(spark.conf.get(name)) == state.PARTS_A_CORE * spark.sparkContext.defaultParallelism < 200
        assert spark.conf.get(name) == "200"
    finally:
        spark.conf.set(name, before)
