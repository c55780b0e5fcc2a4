"""Streaming jobs built from the batch operators."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from cyclewise import config, shared
from cyclewise.functions import scalars as S
from cyclewise.operators import fleet, scoring
from cyclewise.sources import events as E
from cyclewise.streaming import sinks, state

TRIGGER = "30 seconds"


def _start(writer: DataStreamWriter, checkpoint: str, **trigger: bool | str) -> StreamingQuery:
    with state.rocksdb(SparkSession.active()):
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def run_bounded(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Work through everything that is there and stop; repeated on the same checkpoint it takes only what is new."""
    query = _start(writer, checkpoint, availableNow=True)
    query.awaitTermination()
    return query


def run_until_done(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """As ``run_bounded``, poll by poll, for a source that decides itself how much it gives (``sources.log``)."""
    query = _start(writer, checkpoint, processingTime="0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def run_forever(writer: DataStreamWriter, checkpoint: str, every: str = TRIGGER) -> StreamingQuery:
    return _start(writer, checkpoint, processingTime=every)


class Counters(StreamingQueryListener):
    """Sums of what queries observe in their batches (``DataFrame.observe``); the counts come with the batch's own job.

    A batch that runs again replaces its first counts. Use as a context; on leaving it, all queries started
    inside have reported.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.by_batch, self._open, self._news = spark, {}, set(), threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self._news:
            self._open.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self._news:
            for name, row in progress.observedMetrics.items():
                self.by_batch[str(progress.id), progress.batchId, name] = row.asDict()

    def onQueryTerminated(self, event) -> None:
        with self._news:
            self._open.discard(str(event.runId))
            self._news.notify_all()

    def __enter__(self) -> Counters:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *failure) -> None:
        with self._news:
            self._news.wait_for(lambda: not self._open, timeout=60)
        self.spark.streams.removeListener(self)

    def totals(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for row in self.by_batch.values():
            for name, n in row.items():
                out[name] = out.get(name, 0) + (n or 0)
        return out

    def table(self, *names: str) -> DataFrame:
        """The totals as one row."""
        sums = self.totals()
        return self.spark.createDataFrame([tuple(int(sums.get(n, 0)) for n in names)], ", ".join(f"{n} long" for n in names))


def each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], mode: str = "append") -> DataStreamWriter:
    """Hand each micro-batch to ``fn``, whose jobs run adaptively; the stream's own plan isn't touched."""

    def run(rows: DataFrame, batch: int) -> None:
        with sinks.adaptive(rows.sparkSession):
            fn(rows, batch)

    return stream.writeStream.outputMode(mode).foreachBatch(run)


def normalized(
    messages: DataFrame, bounds: Mapping[str, tuple[float, float]], names: Sequence[str] = config.SENSORS
) -> DataFrame:
    """Decode JSON messages and scale the readings; bounds are literals, so no Python worker is involved.

    Messages that can't be used are left out here; ``Quarantine`` keeps them.
    """
    return scaled(E.good_events(E.decode(messages)), bounds, names)


def scaled(good: DataFrame, bounds: Mapping[str, tuple[float, float]], names: Sequence[str] = config.SENSORS) -> DataFrame:
    values = S.sensor_array(F.col("sensors"), names)
    return good.withColumn("x", S.normalize_stream(values, bounds, names)).drop("sensors")


class Quarantine:
    """Keeps each batch's unusable messages with the reason, and hands the others, scaled, to the next step."""

    def __init__(
        self,
        path: str,
        bounds: Mapping[str, tuple[float, float]],
        then: Callable[[DataFrame, int], None],
        names: Sequence[str] = config.SENSORS,
    ):
        self.path, self.bounds, self.then, self.names = path, bounds, then, names

    def __call__(self, messages: DataFrame, batch: int) -> None:
        decoded = E.decode(messages).persist()
        try:
            sinks.write_batch(E.quarantined(decoded), self.path, batch)
            self.then(scaled(E.good_events(decoded), self.bounds, self.names), batch)
        finally:
            decoded.unpersist()


class RollingFeatures:
    """Rolling window per engine: the rows that are accepted, cut into windows, batch by batch to ``on_vectors``.

    The state is that of ``state.Roller``, in the engine's state store under the query's checkpoint. What a batch counts
    (``COUNTERS``) is observed as its rows pass; ``Counters`` sums it up.
    """

    VECTORS = (
        "engine_id string, cycle long, event_time long, features array<float>, window_size int, n_sensors int"
    )
    COUNTERS = ("processed", "accepted", "emitted", "engines")

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        width: int,
        size: int = config.WINDOW_SIZE,
        on_vectors: Callable[[DataFrame, int], None] | None = None,
    ):
        self.spark, self.path, self.width, self.size = spark, path, width, size
        self.on_vectors = on_vectors or (lambda rows, batch: sinks.write_batch(rows, f"{path}/vectors", batch))

    def stream(self, events: DataFrame) -> DataFrame:
        """The vectors of a stream ``(engine_id, cycle, event_time_ms, arrival, x array<float>)``."""
        seen = events.observe("input", F.count(F.lit(1)).alias("processed"))
        pieces = state.accepted_pieces(seen, self.width, self.size)
        rows = F.size("readings") / self.width
        ready = F.least(F.col("fresh"), F.greatest(F.lit(0), rows.cast("int") - (self.size - 1)))
        counts = {"accepted": F.sum("fresh"), "emitted": F.sum(ready), "engines": F.count_if("first")}
        pieces = pieces.observe("windows", *[F.coalesce(n, F.lit(0)).alias(c) for c, n in counts.items()])
        return state.windows_of(pieces, self.width, self.size)

    def writer(self, events: DataFrame) -> DataStreamWriter:
        return each_batch(self.stream(events), fan_out(self.on_vectors))

    def vectors(self) -> DataFrame:
        return sinks.read_batches(self.spark, f"{self.path}/vectors", self.VECTORS)


class OnlineStore:
    """Latest feature vector per engine, with the time it was written (``clock``) for the expiry check.

    Vectors that have been there for longer than ``ttl`` seconds are not given out, and leave the table when their
    bucket is next written.
    """

    SCHEMA = RollingFeatures.VECTORS + ", updated_at_ms long"

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        clock: Column | None = None,
        ttl: int = config.ONLINE_TTL_SECONDS,
        buckets: int = sinks.Snapshot.BUCKETS,
    ):
        self.rows, self.ttl = sinks.Snapshot(spark, path, self.SCHEMA, buckets=buckets), ttl
        self.clock = F.unix_millis(F.current_timestamp()) if clock is None else clock

    def __call__(self, vectors: DataFrame, batch: int) -> None:
        before = self.rows.before(batch, self.rows.touched(vectors))
        merged = sinks.upsert_latest(before, vectors.withColumn("updated_at_ms", self.clock), ["engine_id"], ["cycle"])
        newest = merged.agg(F.max("updated_at_ms").alias("t")).scalar()
        self.rows.replace(batch, merged.where(F.col("updated_at_ms") >= newest - self.ttl * 1000))

    def read(self) -> DataFrame:
        return self.rows.latest()

    def live(self, now_ms: Column) -> DataFrame:
        return self.read().where(F.col("updated_at_ms") >= now_ms - F.lit(self.ttl * 1000))


def fan_out(*targets: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Give one micro-batch to several sinks; it is computed once."""

    def write(rows: DataFrame, batch: int) -> None:
        held = rows.persist()
        try:
            for target in targets:
                target(held, batch)
        finally:
            held.unpersist()

    return write


class FleetSnapshots:
    """From batches of vectors: telemetry, predictions and alerts of all engines whose vectors haven't expired, one folder for
    each batch that writes them, of which the newest ``keep`` stay.

    ``now_ms`` is the time that expiry is judged by. ``score`` turns the feature vector column into a normalised score.
    ``every`` says how many seconds lie between two snapshots of a kind at least (``INTERVALS``); without it, each batch makes
    all three. Alerts come from the newest predictions written, so the model runs for predictions only.
    """

    KINDS = ("telemetry", "predictions", "alerts")
    INTERVALS = {"telemetry": 2.0, "predictions": 5.0, "alerts": 5.0}

    def __init__(
        self,
        store: OnlineStore,
        path: str,
        score: Callable[[Column], Column],
        min_risk: str = "HIGH",
        now_ms: Column | None = None,
        keep: int = 16,
        every: Mapping[str, float] | None = None,
        clock: Callable[[], float] = time.monotonic,
    ):
        self.store, self.path, self.score, self.min_risk, self.keep = store, path, score, min_risk, keep
        self.now_ms = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
        self.every, self.clock = dict(every or {}), clock
        self._last: dict[str, float] = {}
        self._predicted: int | None = None

    def __call__(self, vectors: DataFrame, batch: int) -> None:
        self.store(vectors, batch)
        now = self.clock()
        for kind in self.KINDS:
            if kind not in self._last or now - self._last[kind] >= self.every.get(kind, 0.0):
                if (rows := getattr(self, f"_{kind}")(batch)) is not None:
                    sinks.write_batch(rows, f"{self.path}/{kind}", batch)
                    self._last[kind] = now
                    sinks.drop_batches(vectors.sparkSession, f"{self.path}/{kind}", batch - self.keep + 1)

    def _telemetry(self, batch: int) -> DataFrame:
        rows = self.store.live(self.now_ms)
        return rows.select("engine_id", "cycle", F.col("event_time").alias("event_time_ms"), "window_size")

    def _predictions(self, batch: int) -> DataFrame:
        self._predicted = batch
        graded = scoring.grade(self.store.live(self.now_ms), self.score(F.col("features")), round_first=True)
        return graded.select(
            "engine_id", "cycle", "remaining_cycles", "failure_risk", "risk_level", F.lit(1.0).alias("confidence")
        )

    def _alerts(self, batch: int) -> DataFrame | None:
        if self._predicted is None:
            return None
        rows = self.store.rows.spark.read.parquet(f"{self.path}/predictions/batch={self._predicted}")
        return fleet.at_or_above(rows, self.min_risk)


class AlertBook:
    """Open alerts: an engine raises one alert until it is acknowledged; an open alert keeps its first values.

    ``state.AlertKeeper`` holds the open alerts. Raised and closed alerts are a log, written once each; acknowledgements are
    a table that the stream reads along with the predictions. An acknowledgement names an alert, so saying it twice
    changes nothing, also after the engine has raised the next one.
    """

    ACKS = "engine_id string, acknowledges long"

    def __init__(self, spark: SparkSession, path: str, min_risk: str = "HIGH"):
        self.spark, self.path, self.min_risk = spark, path, min_risk
        # A stream wants the folder to be there.
        spark.createDataFrame([], self.ACKS).write.mode("append").parquet(f"{path}/acknowledged")

    def writer(self, predictions: DataFrame) -> DataStreamWriter:
        risky = fleet.at_or_above(predictions, self.min_risk)
        acks = self.spark.readStream.schema(self.ACKS).parquet(f"{self.path}/acknowledged")
        return state.alert_log(risky, acks).writeStream.format("parquet").option("path", f"{self.path}/log")

    def acknowledge(self, engines: DataFrame) -> None:
        """Close the open alerts of the engines in ``engines`` (engine_id)."""
        told = self._raised().join(engines.select("engine_id").distinct(), "engine_id").where(~F.col("acknowledged"))
        acks = shared.settle(told.select("engine_id", F.col("arrival").alias("acknowledges")), "acknowledgements")
        if not acks.isEmpty():
            acks.write.mode("append").parquet(f"{self.path}/acknowledged")

    def _raised(self) -> DataFrame:
        said = sinks.read_or_empty(self.spark, f"{self.path}/acknowledged", self.ACKS).distinct()
        said = said.select("engine_id", F.col("acknowledges").alias("arrival"), F.lit(True).alias("said"))
        log = sinks.read_or_empty(self.spark, f"{self.path}/log", state.ALERT_LOG).where("event = 'raised'").drop("event")
        return log.join(said, ["engine_id", "arrival"], "left").withColumn("acknowledged", F.coalesce("said", F.lit(False))).drop("said")

    def read(self) -> DataFrame:
        return self._raised().drop("arrival")
