"""Keyed state of streams, kept by the engine's own state store (RocksDB): rolling windows, open alerts, silence, rules.

A processor sees the rows of one key in a micro-batch in no certain order, in Arrow batches. It turns each of them
into plain arrays, puts these in the order of arrival, and works through them in pieces. How many rows that can be is
bounded by the source's limit for each trigger.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cyclewise import config
from cyclewise.operators.metrics import step_of

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch writes what has changed, not the whole state.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# New rows of one engine that go out as one piece, with the rows before them that their windows need.
PIECE_ROWS = 256

# State is kept in so many parts for each core, at most as many as the session shuffles into: a part costs a second or so in
# each batch, for its worker and its store. The checkpoint keeps the number it began with.
PARTS_A_CORE = 3
# Groups of engines whose silence is watched together.
SILENCE_GROUPS = 512

PIECES = "engine_id string, first boolean, fresh int, cycles array<long>, times array<long>, readings array<float>"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, in a few parts for each core; the session's own settings are put back."""
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, PARTS_A_CORE * spark.sparkContext.defaultParallelism))
    settings = STORE | {"spark.sql.shuffle.partitions": str(parts)}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def in_order(frames: Iterator[pd.DataFrame], order: str, columns: Sequence[str]) -> list[np.ndarray]:
    """The named columns of a key's rows as arrays, sorted by ``order``; lists become the rows of a matrix."""
    taken = []
    for frame in frames:
        if len(frame):
            plain = [np.stack(frame[c]).astype("f4") if frame[c].dtype == object and isinstance(frame[c].iloc[0], (list, np.ndarray)) else frame[c].to_numpy() for c in columns]
            taken.append([frame[order].to_numpy(), *plain])
    if not taken:
        return []
    parts = [np.concatenate(column) for column in zip(*taken)]
    at = np.argsort(parts[0], kind="stable")
    return [p[at] for p in parts[1:]]


class Roller(StatefulProcessor):
    """Keeps an engine's last cycle (a value) and its last ``size - 1`` accepted rows (a list).

    A row is accepted when its cycle is above all that came before. Accepted rows go out in pieces, each with the rows
    before it that its windows reach back to; ``first`` marks the piece with which an engine is first heard of.
    With ``ttl_ms`` an engine that has been silent for that long (processing time) begins anew.
    """

    def __init__(self, size: int, width: int, ttl_ms: int | None = None, piece_rows: int = PIECE_ROWS):
        self.size, self.width, self.ttl_ms, self.piece_rows = size, width, ttl_ms, piece_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "cycle long", self.ttl_ms)
        self.tail = handle.getListState("tail", "x array<float>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = in_order(rows, "arrival", ["cycle", "event_time_ms", "x"])
        if not found:
            return
        cycles, times, readings = found
        known = self.last.get()
        # A row counts when it is above all cycles before it; the first of an engine always does.
        seen = np.maximum.accumulate(cycles if known is None else np.concatenate(([known[0]], cycles)))
        accepted = np.concatenate(([True], cycles[1:] > seen[:-1])) if known is None else cycles > seen[:-1]
        if not accepted.any():
            return
        cycles, times, readings = cycles[accepted], times[accepted], readings[accepted]
        held = np.array([x[0] for x in self.tail.get()], dtype="f4").reshape(-1, self.width) if known is not None else readings[:0]
        whole = np.concatenate([held, readings])
        yield from self.pieces(key[0], known is None, len(held), cycles, times, whole)
        self.last.update((int(cycles[-1]),))
        if self.size > 1:
            self.tail.put([(x,) for x in whole[-(self.size - 1) :].tolist()])

    def pieces(self, engine, first: bool, held: int, cycles, times, whole) -> Iterator[pd.DataFrame]:
        for start in range(0, len(cycles), self.piece_rows):
            upto = min(start + self.piece_rows, len(cycles))
            before = max(0, held + start - (self.size - 1))
            yield pd.DataFrame(
                {
                    "engine_id": [engine],
                    "first": [first and start == 0],
                    "fresh": [upto - start],
                    "cycles": [cycles[start:upto]],
                    "times": [times[start:upto]],
                    "readings": [whole[before : held + upto].ravel()],
                }
            )

    def close(self) -> None:
        pass


def accepted_pieces(events: DataFrame, width: int, size: int = config.WINDOW_SIZE, ttl_seconds: int | None = None) -> DataFrame:
    """A stream ``(engine_id, cycle, event_time_ms, arrival, x array<float>)`` as pieces of accepted rows (``PIECES``).

    ``ttl_seconds`` needs a stream that runs on (``jobs.run_forever``): its clock is checked in every batch.
    """
    ttl_ms = ttl_seconds * 1000 if ttl_seconds else None
    mode = "processingTime" if ttl_ms else "none"
    rows = events.select("engine_id", "cycle", "event_time_ms", "arrival", "x")
    return rows.groupBy("engine_id").transformWithStateInPandas(Roller(size, width, ttl_ms), PIECES, "append", mode)


def windows_of(pieces: DataFrame, width: int, size: int = config.WINDOW_SIZE) -> DataFrame:
    """One feature vector for each accepted row from an engine's ``size``-th on.

    Pieces are dealt out anew first: an engine that owns much of the stream has its windows written by many tasks, as only
    its accepted rows, once each, pass through one.
    """
    dealt = pieces.repartition(F.col("engine_id"), F.get("cycles", F.lit(0)))
    held = (F.size("readings") / width).cast("int") - F.col("fresh")
    from_row = F.greatest(F.lit(0), F.lit(size - 1) - held)
    row = F.explode(F.when(from_row < F.col("fresh"), F.sequence(from_row, F.col("fresh") - 1)))
    each = dealt.select("engine_id", "fresh", "cycles", "times", "readings", row.alias("row"))
    begin = (F.size("readings") / width).cast("int") - F.col("fresh") + F.col("row") - (size - 1)
    return each.select(
        "engine_id",
        F.get("cycles", F.col("row")).alias("cycle"),
        F.get("times", F.col("row")).alias("event_time"),
        F.slice("readings", begin * width + 1, size * width).alias("features"),
        F.lit(size).alias("window_size"),
        F.lit(width).alias("n_sensors"),
    )


def rolling_vectors(events: DataFrame, width: int, size: int = config.WINDOW_SIZE, ttl_seconds: int | None = None) -> DataFrame:
    """Feature vectors of a stream of readings; ``accepted_pieces`` says which columns it has."""
    return windows_of(accepted_pieces(events, width, size, ttl_seconds), width, size)


class AlertKeeper(StatefulProcessor):
    """The open alert of each engine: a risky prediction raises one if none is open, an acknowledgement that names it closes it.

    Acknowledgements in a batch go first: they speak of alerts that were raised before. One that names no open alert, as when it
    comes twice, changes nothing. Engines without an open alert hold no state.
    """

    FIELDS = ("risk_level", "failure_risk", "remaining_cycles", "event_time_ms", "arrival")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "arrival long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Of a batch, the earliest prediction and the names in acknowledgements are all that matters.
        first, said = None, set()
        for frame in rows:
            acks = frame["acknowledges"].notna()
            said.update(frame.loc[acks, "acknowledges"].astype("int64").tolist())
            risky = frame.loc[~acks]
            if len(risky):
                row = risky.loc[risky["arrival"].idxmin()]
                if first is None or row["arrival"] < first["arrival"]:
                    first = row
        if out := self.events(key[0], first, said):
            yield pd.DataFrame(out, columns=["engine_id", "event", *self.FIELDS]).astype({"remaining_cycles": "Int32", "event_time_ms": "Int64", "arrival": "Int64"})

    def events(self, engine: str, first, said: set[int]) -> list[tuple]:
        """What happens to an engine's alert, and the state after it."""
        known = self.open.get()
        out = []
        if known is not None and known[0] in said:
            out.append((engine, "closed", None, None, None, None, known[0]))
            if first is None:
                self.open.clear()
            known = None
        if known is None and first is not None:
            out.append((engine, "raised", *(first[c] for c in self.FIELDS)))
            self.open.update((int(first["arrival"]),))
        return out

    def close(self) -> None:
        pass


class AlertRows(AlertKeeper):
    """``AlertKeeper`` on plain rows. An engine has few in a batch, for which frames cost far more than the work on them."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, said = None, set()
        for row in rows:
            if row["acknowledges"] is not None:
                said.add(row["acknowledges"])
            elif first is None or row["arrival"] < first["arrival"]:
                first = row
        for event in self.events(key[0], first, said):
            yield Row(**dict(zip(("engine_id", "event", *self.FIELDS), event)))


ALERT_LOG = "engine_id string, event string, risk_level string, failure_risk double, remaining_cycles int, event_time_ms long, arrival long"


def alert_log(predictions: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Alerts as they are raised and closed (``ALERT_LOG``), from risky predictions and a stream (engine_id, acknowledges), where
    ``acknowledges`` is the arrival of the prediction that raised the alert."""
    told = predictions.select("engine_id", *AlertKeeper.FIELDS, F.lit(None).cast("long").alias("acknowledges"))
    both = told.unionByName(acknowledgements.select("engine_id", "acknowledges"), allowMissingColumns=True)
    return both.groupBy("engine_id").transformWithState(AlertRows(), ALERT_LOG, "append", "none")


def merged_runs(runs: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """Runs (first, last) of times, those joined between which less than ``span`` and one passes."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + span:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


class SilenceWatch(StatefulProcessor):
    """Tells, by a timer, when an engine has been silent for ``span_ms``.

    Kept are runs of events without such a silence between them, as first and last time: usually one run. A run is told as
    ended when the stream's time has passed its last event by the span, as all events that could continue it have come then.
    An engine that is told silent holds no state until it is heard of again.
    """

    def __init__(self, span_ms: int):
        self.span_ms = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "first long, last long")

    def _known(self) -> list[tuple[int, int]]:
        return [(int(first), int(last)) for first, last in self.runs.get()]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self._known()
        runs = before
        for frame in rows:
            runs = merged_runs(runs + [(t, t) for t in frame["event_time_ms"].unique().tolist()], self.span_ms)
        ends, known = {last for _, last in runs}, {last for _, last in before}
        for last in known - ends:
            self.handle.deleteTimer(last + self.span_ms + 1)
        for last in ends - known:
            self.handle.registerTimer(last + self.span_ms + 1)
        self.runs.put(runs)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expired = expiredTimerInfo.getExpiryTimeInMs() - self.span_ms - 1
        runs = self._known()
        left = [run for run in runs if run[1] != expired]
        if len(left) < len(runs):
            yield pd.DataFrame({"engine_id": [key[0]], "last_ms": [expired], "silent_ms": [expired + self.span_ms]})
            if left:
                self.runs.put(left)
            else:
                self.runs.clear()

    def close(self) -> None:
        pass


def joined_runs(runs: pd.DataFrame, span: int) -> pd.DataFrame:
    """``merged_runs`` of many engines at once, on a frame of their runs (``engine_id``, ``first``, ``last``)."""
    codes, engines = pd.factorize(runs["engine_id"], use_na_sentinel=False)
    firsts, lasts = runs["first"].to_numpy(), runs["last"].to_numpy()
    at = np.lexsort((firsts, codes))
    codes, firsts, lasts = codes[at], firsts[at], lasts[at]
    reached = pd.Series(lasts).groupby(codes).cummax().to_numpy()
    begins = np.ones(len(at), dtype=bool)
    begins[1:] = (codes[1:] != codes[:-1]) | (firsts[1:] > reached[:-1] + span)
    heads = np.flatnonzero(begins)
    return pd.DataFrame({"engine_id": engines[codes[heads]], "first": firsts[heads], "last": reached[np.append(heads[1:], len(at)) - 1]})


class SilenceGroups(SilenceWatch):
    """``SilenceWatch`` on groups of engines. An engine has few events in a batch, for which calls on its state and a timer for each
    of its runs cost far more than the work on them. A batch reads and writes the groups it has events of.

    The runs of a group are one table, kept as an Arrow stream and worked on as arrays. Its one timer is that of the run that ends
    first; when it expires, all runs whose time has passed are told.
    """

    RUNS = pa.schema({"engine_id": pa.string(), "first": pa.int64(), "last": pa.int64()})
    # New events that are joined to the runs at once, at least; more if there are more runs.
    JOIN_ROWS = 65_536

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("table", "runs binary")

    def _known(self) -> pd.DataFrame:
        held = self.runs.get()
        table = self.RUNS.empty_table() if held is None else pa.ipc.open_stream(held[0]).read_all()
        return table.to_pandas()

    def _keep(self, runs: pd.DataFrame) -> None:
        if len(runs):
            with pa.BufferOutputStream() as out:
                with pa.ipc.new_stream(out, self.RUNS) as stream:
                    stream.write_table(pa.Table.from_pandas(runs, self.RUNS, preserve_index=False))
                self.runs.update((out.getvalue().to_pybytes(),))
        else:
            self.runs.clear()

    def _due(self, runs: pd.DataFrame) -> int | None:
        """When the run that ends first is told."""
        return int(runs["last"].min()) + self.span_ms + 1 if len(runs) else None

    def _with(self, runs: pd.DataFrame, new: list[pd.DataFrame]) -> pd.DataFrame:
        events = pd.concat(new)
        alone = pd.DataFrame({"engine_id": events["engine_id"], "first": events["event_time_ms"], "last": events["event_time_ms"]})
        return joined_runs(pd.concat([runs, alone]) if len(runs) else alone, self.span_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs, new = self._known(), []
        due = self._due(runs)
        for frame in rows:
            new.append(frame[["engine_id", "event_time_ms"]])
            if sum(map(len, new)) >= max(self.JOIN_ROWS, len(runs)):
                runs, new = self._with(runs, new), []
        runs = self._with(runs, new) if new else runs
        if (first := self._due(runs)) != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
        self._keep(runs)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs = self._known()
        passed = runs["last"] + self.span_ms + 1 <= timerValues.getCurrentWatermarkInMs()
        told, left = runs[passed], runs[~passed]
        if len(left):
            self.handle.registerTimer(self._due(left))
        self._keep(left)
        if len(told):
            yield pd.DataFrame({"engine_id": told["engine_id"], "last_ms": told["last"], "silent_ms": told["last"] + self.span_ms})


def silences(events: DataFrame, span_seconds: int, late_by: str = "0 seconds", groups: int = SILENCE_GROUPS) -> DataFrame:
    """``engine_id``, ``last_ms`` (of its last event) and ``silent_ms`` for each time that an engine sends nothing for so long.

    ``events`` has engine_id and ``event_time`` (a timestamp, which the stream's time follows, ``late_by`` behind). Events that come
    later than that, and those without a time, are left out. Silence is told as the stream's time passes, not when someone asks.
    ``groups`` bounds the engines that pass one call, so it grows with their number (some ten thousand a group); a checkpoint is bound
    to the number it began with.
    """
    timed = events.withWatermark("event_time", late_by).where("event_time IS NOT NULL")
    group = F.pmod(F.xxhash64("engine_id"), F.lit(groups)).cast("int").alias("group")
    keyed = timed.select(group, "engine_id", "event_time", F.unix_millis("event_time").alias("event_time_ms")).groupBy("group")
    return keyed.transformWithStateInPandas(SilenceGroups(span_seconds * 1000), "engine_id string, last_ms long, silent_ms long", "append", "eventTime")


class RuleWatch(StatefulProcessor):
    """A rule's state for each label: inactive, pending since a step, firing, resolved.

    The count over the last ``span`` seconds is looked at whenever a step of the stream's time has passed, also one
    without events; above ``limit`` the rule is pending, and after it has been so for ``hold`` seconds it fires, until the count
    falls. Kept are the counts of the steps that still matter, the next step to look at, and since when the rule holds.
    """

    def __init__(self, step: int, span: int, limit: float, hold: int):
        if limit < 0:
            raise ValueError("a rule that holds without events would hold for labels that were never seen")
        self.step, self.span, self.limit, self.hold = step, span, limit, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getListState("counts", "step long, n long")
        self.rule = handle.getValueState("rule", "next long, since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts, new = dict(self.counts.get()), set()
        for frame in rows:
            for step, n in frame.groupby("step")["n"].sum().items():
                new.add(int(step))
                counts[int(step)] = counts.get(int(step), 0) + int(n)
        self.counts.put(sorted(counts.items()))
        rule, first = self.rule.get(), min(new)
        if rule is None or first < rule[0]:  # no step between the stream's time and the next to look at had events yet
            if rule is not None:
                self.handle.deleteTimer(rule[0] * 1000 + 1)
            self.rule.update((first, rule[1] if rule else None))
            self.handle.registerTimer(first * 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, since = self.rule.get()
        counts, passed, out = dict(self.counts.get()), timerValues.getCurrentWatermarkInMs(), []
        while at is not None and at * 1000 + 1 <= passed:
            total = sum(n for step, n in counts.items() if at - self.span < step <= at)
            if total > self.limit:
                started, since = since is None, at if since is None else since
                if at - since >= self.hold:
                    out.append((key[0], at, total, "firing", since))
                elif started:
                    out.append((key[0], at, total, "pending", since))
            elif since is not None:
                if at - self.step - since >= self.hold:
                    out.append((key[0], at, total, "resolved", since))
                since = None
            at += self.step
            counts = {step: n for step, n in counts.items() if step > at - self.span}
            if since is None and not any(step <= at for step in counts):
                at = min(counts, default=None)  # nothing happens before
        if at is None:
            self.counts.clear()
            self.rule.clear()
        else:
            self.counts.put(sorted(counts.items()))
            self.rule.update((at, since))
            self.handle.registerTimer(at * 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["label", "step", "n", "state", "since"])

    def close(self) -> None:
        pass


def counted_steps(events: DataFrame, step: int) -> DataFrame:
    """Counts by ``label`` and ``step`` of what lies in one Arrow batch together: the map side of a count, without state.

    ``event_time`` is the latest of each group, which the stream's time follows.
    """
    rows = events.select("label", F.col("event_time").cast("timestamp").alias("event_time"), step_of(F.col("event_time"), step).alias("step"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = pa.Table.from_batches([batch]).group_by(["label", "step"]).aggregate([("event_time", "max"), ([], "count_all")])
            told = told.select(["label", "step", "count_all", "event_time_max"]).rename_columns(["label", "step", "n", "event_time"])
            yield from told.to_batches()

    return rows.where("step IS NOT NULL").mapInArrow(run, "label string, step long, n long, event_time timestamp")


def rule_states(events: DataFrame, step: int, span: int, limit: float, hold: int, late_by: str = "0 seconds") -> DataFrame:
    """``label``, ``step``, ``n`` (events in the last ``span`` seconds), ``state`` and ``since`` as a rule goes pending, fires (each
    step) and is resolved. ``events`` has label and ``event_time``; steps end at whole multiples of ``step`` seconds."""
    counts = counted_steps(events, step).withWatermark("event_time", late_by)
    schema = "label string, step long, n long, state string, since long"
    return counts.groupBy("label").transformWithStateInPandas(RuleWatch(step, span, limit, hold), schema, "append", "eventTime")
