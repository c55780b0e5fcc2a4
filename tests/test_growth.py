"""Steps whose work must not grow faster than their input."""

from collections import Counter
from pathlib import Path

from pyspark.sql import Row
from pyspark.sql import functions as F

from cyclewise import shared
from cyclewise.operators import models, windows
from cyclewise.sources import events
from cyclewise.streaming import state


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_features_take_a_row_once(spark):
    """No frame of Spark's, which adds up every row as often as there are windows over it; chunks, batches and nulls change nothing."""
    rows = spark.range(900).selectExpr(
        "if(id % 3 = 2, null, id % 3) as unit", "id div 3 + 1 as cycle", "if(id % 11 = 0, null, id * id % 97 / 7D) as x", "0 as RUL"
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = windows.window_features(rows, ["x"], 30, ordinal="cycle", chunk_rows=40)
        assert "specifiedwindowframe" not in plan_of(found)
        got = sorted(map(repr, found.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    frame = "over (partition by unit order by cycle rows between 29 preceding and current row)"
    want = rows.selectExpr(
        "unit", "cycle", "x as x_last", f"avg(x) {frame} as x_mean", f"stddev_pop(x) {frame} as x_std",
        f"covar_pop(x, cycle) {frame} / (899 / 12D) as x_slope", "RUL as label",
    )
    assert got == sorted(map(repr, want.where("cycle >= 30").collect())) and len(got) == 3 * 271


def test_boosting_rows_are_dealt_evenly(spark):
    """One part for each core, however the rows come: one more would double the time of every pass."""
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(4000).selectExpr(
        "id % 40 as unit", "id as cycle", "0L as label", "if(id % 5 = 0, 'val', 'train') as split", "cast(id % 7 as double) as x",
        "id % 7 * 0.1D as y", "1.0D as weight",
    )
    written = lambda: set(Path(shared.scratch(spark, "x")).parent.glob("boosting-*"))
    before = written()
    models.train_with_history(rows.coalesce(1), trees=1, depth=1)
    (folder,) = written() - before
    sizes = Counter(r.f for r in spark.read.parquet(str(folder)).select(F.input_file_name().alias("f")).collect())
    assert len(sizes) == cores and max(sizes.values()) < 1.3 * 4000 / cores


def test_tokens_are_made_once(spark):
    """Neither the events nor the rejected lines repeat the step that makes the tokens for each token they look at."""
    text = F.when(F.col("id") % 5 == 0, "1 2 x").when(F.col("id") % 7 == 0, "1 2 3 x").otherwise(F.concat_ws(" ", "id", "id", F.col("id") / 4, "id"))
    lines = spark.range(70).select(F.split(F.when(F.col("id") != 69, text), " ").alias("tokens"))
    found = events.event_from_tokens(lines, F.lit(5), ["a", "b"], [2, 3], 4)
    rejected = events.rejected_tokens(lines, [2, 3], 4)
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert optimized(found).count("split(") == 1 and optimized(rejected).count("split(") <= 3
    good = [i for i in range(69) if i % 5 and i % 7]
    assert sorted(map(tuple, found.collect())) == sorted((f"ENG-{i}", i, 5, {"a": i / 4, "b": float(i)}) for i in good)
    reasons = Counter(r.reason for r in rejected.collect())
    assert reasons == {"incomplete": 14 + 1, "malformed": 8}


class Open:
    """The one value that an alert keeper holds for an engine."""

    value = None

    def getValueState(self, *_):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_alerts_are_kept_on_plain_rows():
    """No frame is made for an engine; what happens is the same as with frames."""
    held, keeper = Open(), state.AlertRows()
    keeper.init(held)
    names = ("engine_id", *keeper.FIELDS, "acknowledges")
    risky = lambda n: ("a", "HIGH", 0.7, 30, n, n, None)
    ack = lambda n: ("a", None, None, None, None, None, n)
    told = lambda *rows: [(r["event"], r["arrival"]) for r in keeper.handleInputRows(("a",), iter([Row(**dict(zip(names, r))) for r in rows]), None)]
    assert told(risky(5), risky(4)) == [("raised", 4)] and told(risky(1)) == []
    assert told(ack(4), risky(6), ack(4)) == [("closed", 4), ("raised", 6)] and held.value == (6,)
    assert told(ack(4)) == [] and told(ack(6)) == [("closed", 6)] and held.value is None
