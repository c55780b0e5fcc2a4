"""Metric series: counters, histograms, rates, quantiles and alert rules on a fixed time grid.

Raw observations are reduced to one row per (label, step) first, with map-side combine. Everything after
that works on the grid, whose size is labels x steps and does not depend on the number of observations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cyclewise import shared
from cyclewise.operators import chunked


def step_of(ts: Column, step: int) -> Column:
    """End of the step that ``ts`` falls in, in epoch seconds; a step covers (end - step, end]."""
    return (F.ceil(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0 * step)) * step).cast("long")


# Steps of a grid: a year of minutes is half a million.
MOST_STEPS = 5_000_000


def counts_on_grid(df: DataFrame, ts: Column, step: int, label: Column | None = None, most: int = MOST_STEPS) -> DataFrame:
    """``(label, step, n)`` for every step between the first and the last of the whole input, 0 where empty.

    Null is a label like others. An event without a time has no step and can't be counted on one. Times so far apart that
    there would be more than ``most`` steps are an error that names both ends: a stray time isn't left out, and doesn't
    fill a table with empty steps.
    """
    name = F.lit("all") if label is None else label
    counts = df.where(ts.isNotNull()).groupBy(name.alias("label"), step_of(ts, step).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    counts = shared.settle(counts, "grid")
    span = counts.agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    labels = counts.select("label").distinct().withColumns({"lo": lo, "hi": hi})
    far = F.format_string(f"more than {most} steps of {step} s between %s and %s", *[F.timestamp_seconds(c).cast("string") for c in ("lo", "hi")])
    steps = F.when(F.col("hi") - F.col("lo") > most * step, F.raise_error(far).cast("array<bigint>"))
    steps = steps.otherwise(F.sequence(F.col("lo"), F.col("hi"), F.lit(step).cast("long")))
    spine = labels.select("label", F.explode(steps).alias("step"))
    found = counts.select(F.col("label").alias("_label"), F.col("step").alias("_step"), "n")
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.col("step") == F.col("_step"))
    return spine.join(found, same, "left").select("label", "step", F.coalesce("n", F.lit(0)).alias("n"))


def range_rate(grid: DataFrame, span: int) -> DataFrame:
    """Events per second over the ``span`` seconds that end at each step (no extrapolation)."""
    frame = W.partitionBy("label").orderBy("step").rangeBetween(-(span - 1), 0)
    return grid.withColumn("rate", F.sum("n").over(frame) / F.lit(float(span)))


def instant_rate(grid: DataFrame) -> DataFrame:
    """Rate between the last two samples of a running counter at each step."""
    by_time = W.partitionBy("label").orderBy("step")
    total = grid.withColumn("total", F.sum("n").over(by_time.rowsBetween(W.unboundedPreceding, 0)))
    grown = F.col("total") - F.lag("total").over(by_time)
    seconds = F.col("step") - F.lag("step").over(by_time)
    return total.withColumn("irate", F.try_divide(grown.cast("double"), seconds))


def increases(samples: DataFrame, key: Sequence[str], order: Sequence[str], value: str = "value", ts: str = "ts") -> DataFrame:
    """By how much a cumulative counter has grown since the sample before: ``increase`` and ``since`` (seconds).

    ``key`` is one series, ``order`` the order of its samples. A value below the one before is a reset: the counter has
    grown by the value itself. The first sample of a series has no increase; samples without a value are left out.
    """
    known = samples.where(F.col(value).isNotNull()).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    hour = F.floor(F.col("_at") / 3_600_000_000).cast("long")
    told = known.withColumn("_both", F.struct(F.col(value).alias("value"), F.col("_at").alias("at")))
    before = chunked.with_previous(told, key, order, hour, "_both", "_before")
    grown = F.when(F.col(value) >= F.col("_before.value"), F.col(value) - F.col("_before.value")).otherwise(F.col(value))
    return before.where(F.col("_before").isNotNull()).select(
        *samples.columns, grown.alias("increase"), ((F.col("_at") - F.col("_before.at")) / F.lit(1_000_000.0)).alias("since")
    )


def counter_rate(grown: DataFrame, key: Sequence[str], step: int, span: int, ts: str = "ts") -> DataFrame:
    """Per series and step with samples: increase per second over the ``span`` seconds that end there."""
    sums = grown.groupBy(*key, step_of(F.col(ts), step).alias("step")).agg(F.sum("increase").alias("_sum"))
    frame = W.partitionBy(*key).orderBy("step").rangeBetween(-(span - 1), 0)
    return sums.select(*key, "step", (F.sum("_sum").over(frame) / F.lit(float(span))).alias("rate"))


def counter_irate(grown: DataFrame, key: Sequence[str], order: Sequence[str], step: int, ts: str = "ts") -> DataFrame:
    """Per series and step with samples: rate between the last two samples up to there."""
    last = F.max_by(F.struct("increase", "since"), F.struct(*order)).alias("_l")
    return grown.groupBy(*key, step_of(F.col(ts), step).alias("step")).agg(last).select(
        *key, "step", F.try_divide(F.col("_l.increase").cast("double"), F.col("_l.since")).alias("irate")
    )


def rate_over_all(grid: DataFrame, span: int) -> DataFrame:
    """Sum of the labels' rates at each step; the grid has every label at every step, so nothing is missing."""
    return range_rate(grid, span).groupBy("step").agg(F.sum("rate").alias("rate"))


def bucket_counts(df: DataFrame, value: Column, bounds: Sequence[float], *by: Column) -> DataFrame:
    """Cumulative histogram ``(by..., le, cum_count)`` over the fixed bounds and +Inf.

    Each observation is put into its own bucket and counted once; the running sum over the few buckets follows.
    Null and NaN aren't observations.
    """
    slot = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        slot = F.when(value <= float(bounds[i]), i).otherwise(slot)
    keys = [c.alias(f"_by{i}") for i, c in enumerate(by)]
    names = [f"_by{i}" for i in range(len(by))]
    observed = df.where(value.isNotNull() & ~F.isnan(value.cast("double")))
    counted = observed.groupBy(*keys, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    filled = counted.groupBy(*names).agg(
        *[F.sum(F.when(F.col("_slot") <= i, F.col("_n")).otherwise(0)).alias(f"_c{i}") for i in range(len(bounds) + 1)]
    )
    edges = [float(b) for b in bounds] + [float("inf")]
    rows = F.array(
        *[F.struct(F.lit(edge).alias("le"), F.col(f"_c{i}").alias("cum_count")) for i, edge in enumerate(edges)]
    )
    return filled.select(*names, F.explode(rows).alias("r")).select(*names, "r.le", "r.cum_count")


def quantiles(histogram: DataFrame, qs: Sequence[float], *by: str) -> DataFrame:
    """Quantiles ``(by..., q, quantile)`` from a cumulative histogram, interpolated linearly inside the bucket.

    A rank in the +Inf bucket gives the largest finite bound; an empty histogram gives no row. The histogram has
    one row per bucket, so the windows here are over a dozen rows.
    """
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")
    rows = histogram.select(*by, "le", "cum_count", wanted)
    keys = [*by, "q"]
    order, whole = W.partitionBy(*keys).orderBy("le"), W.partitionBy(*keys)
    finite = F.col("le") != F.lit(float("inf"))
    first_low = F.when(F.col("le") > 0, F.lit(0.0)).otherwise(F.col("le"))
    ranked = rows.withColumns(
        {
            "_total": F.max("cum_count").over(whole),
            "_top": F.max(F.when(finite, F.col("le"))).over(whole),
            "_low_count": F.coalesce(F.lag("cum_count").over(order), F.lit(0)),
            "_low": F.coalesce(F.lag("le").over(order), first_low),
        }
    )
    rank = F.col("q") * F.col("_total")
    inside = F.col("_low") + (F.col("le") - F.col("_low")) * F.try_divide(
        rank - F.col("_low_count"), F.col("cum_count") - F.col("_low_count")
    )
    value = F.when(finite, F.coalesce(inside, F.col("le"))).otherwise(F.col("_top"))
    hit = ranked.where((F.col("cum_count") >= rank) & (F.col("_total") > 0))
    return hit.groupBy(*keys).agg(F.min_by(value, F.col("le")).alias("quantile"))


def bucket_rates(grown: DataFrame, bounds: Sequence[float], step: int, span: int, *by: str, ts: str = "ts") -> DataFrame:
    """A cumulative histogram ``(by..., step, le, cum_count)`` of rates, for ``quantiles``, from counters of buckets.

    ``grown`` holds the increases of each bucket counter ``(series..., le, increase, ts)`` as ``increases`` finds them, so a
    counter that was reset is counted on. They are summed over the series and over the ``span`` seconds that end at each
    step; a bucket without samples in them has grown by nothing. Scrapes of one histogram aren't taken at one instant, so a
    bucket may seem to have grown by less than one inside it: it is raised to that one's rate. The buckets are ``bounds``
    and +Inf; one row holds all of a step, so nothing is joined.
    """
    edges = [float(b) for b in bounds] + [float("inf")]
    sums = [F.sum(F.when(F.col("le") == edge, F.col("increase"))).alias(f"_b{i}") for i, edge in enumerate(edges)]
    steps = grown.where(F.col("le").isin(edges)).groupBy(*by, step_of(F.col(ts), step).alias("step")).agg(*sums)
    frame = W.partitionBy(*by).orderBy("step").rangeBetween(-(span - 1), 0)
    rates = F.array(*[F.coalesce(F.sum(f"_b{i}").over(frame), F.lit(0)) / F.lit(float(span)) for i in range(len(edges))])
    rows = steps.select(*by, "step", rates.alias("rates"))
    raised = [F.struct(F.lit(edge).alias("le"), F.array_max(F.slice("rates", 1, i + 1)).alias("cum_count")) for i, edge in enumerate(edges)]
    return rows.select(*by, "step", F.inline(F.array(*raised)))


def ratio_rule(df: DataFrame, part: Column, whole: Column, limit: float) -> DataFrame:
    """Rows whose ratio is above the limit; a zero denominator gives no ratio and never fires."""
    return df.withColumn("ratio", F.try_divide(part.cast("double"), whole.cast("double"))).where(
        F.col("ratio") > limit
    )


def sustained(grid: DataFrame, condition: Column, hold: int, step: int) -> DataFrame:
    """Steps at which the condition has been true for the whole of the last ``hold`` seconds."""
    frame = W.partitionBy("label").orderBy("step").rangeBetween(-hold, 0)
    needed = hold // step + 1
    held = grid.withColumn("_ok", condition.cast("int")).withColumns(
        {"_all": F.min("_ok").over(frame), "_n": F.count("_ok").over(frame)}
    )
    return held.where((F.col("_all") == 1) & (F.col("_n") == needed)).drop("_ok", "_all", "_n")


def absent(grid: DataFrame, span: int) -> DataFrame:
    """Steps with no event in the ``span`` seconds before them."""
    return range_rate(grid, span).where(F.col("rate") == 0)


def rate_alert(grid: DataFrame, span: int, limit: float, hold: int, step: int) -> DataFrame:
    """Steps at which the rate has been above the limit for the whole hold."""
    return sustained(range_rate(grid, span), F.col("rate") > limit, hold, step)


def silence_alert(grid: DataFrame, span: int, hold: int, step: int) -> DataFrame:
    """Steps at which there has been no activity for the whole hold."""
    return sustained(range_rate(grid, span), F.col("rate") == 0, hold, step)


def quantile_alert(
    df: DataFrame, ts: Column, value: Column, bounds: Sequence[float], q: float, limit: float, hold: int, step: int
) -> DataFrame:
    """Steps at which the quantile of the step's observations has been above the limit for the whole hold.

    A step without observations has no quantile and ends the condition.
    """
    histogram = bucket_counts(df, value, bounds, step_of(ts, step)).withColumnRenamed("_by0", "step")
    per_step = quantiles(histogram, [q], "step").withColumn("label", F.lit("all"))
    return sustained(per_step, F.col("quantile") > limit, hold, step)


def ratio_alert(
    df: DataFrame, ts: Column, label: Column, part: Column, whole: Column, limit: float, hold: int, step: int
) -> DataFrame:
    """Per label: steps at which the ratio of the summed parts to the summed whole has been above the limit for the hold."""
    sums = df.groupBy(label.alias("label"), step_of(ts, step).alias("step")).agg(
        F.sum(part.cast("double")).alias("_part"), F.sum(whole.cast("double")).alias("_whole")
    )
    shares = sums.select("label", "step", F.try_divide("_part", "_whole").alias("ratio"))
    return sustained(shares, F.coalesce(F.col("ratio") > limit, F.lit(False)), hold, step)
