"""Per-sensor distribution drift: two-sample Kolmogorov-Smirnov test from value counts."""

from __future__ import annotations

from collections.abc import Sequence
from math import inf
from typing import NamedTuple

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cyclewise import config, shared

SERIES_TERMS = 100
# Parts that the two sides' quantiles cut a sensor's values into.
SLICES = 512


class Profile(NamedTuple):
    """What one read of both sides tells of a sensor: its values on either side, and approximate quantiles of them."""

    sensor: str
    n_ref: int
    n_cur: int
    cuts_ref: list[float]
    cuts_cur: list[float]


def halves(rows: DataFrame, is_ref: Column, sensors: Sequence[str]) -> DataFrame:
    """One table of which ``is_ref`` tells the reference from the current rows; what isn't a value becomes null."""
    values = [F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")).alias(s) for s in sensors]
    return rows.select(*values, is_ref.alias("is_ref")).where(F.col("is_ref").isNotNull())


def sides(reference: DataFrame, current: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Two tables as one."""
    return halves(reference, F.lit(True), sensors).unionAll(halves(current, F.lit(False), sensors))


def profiles(both: DataFrame, sensors: Sequence[str], points: int = SLICES // 2) -> tuple[int, list[Profile]]:
    """The number of current rows and a profile of each sensor: one read, and two short lists a sensor for the driver."""
    wanted = [i / points for i in range(1, points)]
    found = []
    for i, s in enumerate(sensors):
        for side, of in (("ref", F.col("is_ref")), ("cur", ~F.col("is_ref"))):
            value = F.when(of, F.col(s))
            found += [F.count(value).alias(f"n_{side}{i}"), F.percentile_approx(value, wanted, 10 * points).alias(f"cuts_{side}{i}")]
    row = both.agg(F.count_if(~F.col("is_ref")).alias("rows"), *found).first()
    told = [Profile(s, row[f"n_ref{i}"], row[f"n_cur{i}"], row[f"cuts_ref{i}"] or [], row[f"cuts_cur{i}"] or []) for i, s in enumerate(sensors)]
    return row["rows"], told


def _promising(p: Profile, cuts: np.ndarray, points: int) -> np.ndarray:
    """Which parts between cuts may hold the largest gap, as far as the sketches can tell."""
    ref, cur = (np.concatenate([[0.0], np.searchsorted(np.array(own), cuts, "left") / points, [1.0]]) for own in (p.cuts_ref, p.cuts_cur))
    start, best = ref[:-1] - cur[:-1], np.abs(ref - cur).max()
    # Inside a part the gap goes up by at most what the reference has there, and down by what the current rows have.
    most = np.maximum(np.abs(start + np.diff(ref)), np.abs(start - np.diff(cur)))
    # Each share is off by at most a part and the sketch's error.
    slack = 1 / points + 1 / (10 * points)
    return most + 4 * slack >= best - 2 * slack


def _ranges(parts: np.ndarray, most: int = 8) -> list[tuple[int, int]]:
    """Part numbers as few ranges, which may take in others between them."""
    runs = [(int(i), int(i)) for i in np.flatnonzero(parts)]
    out: list[tuple[int, int]] = []
    for run in runs:
        if out and run[0] == out[-1][1] + 1:
            out[-1] = (out[-1][0], run[1])
        else:
            out.append(run)
    while len(out) > most:
        i = min(range(len(out) - 1), key=lambda j: out[j + 1][0] - out[j][1])
        out[i : i + 2] = [(out[i][0], out[i + 1][1])]
    return out


def _part_gaps(both: DataFrame, told: Sequence[Profile], cuts: dict[str, np.ndarray], exact: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """One read: per sensor and part its counts, the gaps at its ends, the largest gap known in it, and what it could be at most.

    Values in the ``exact`` parts are merged where equal, on the map side too, and accumulated inside their part; other parts are
    just counted.
    """
    names = [p.sensor for p in told]
    splits = [[-inf, *cuts[s].tolist(), inf] for s in names]
    numbered = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"_part_{i}" for i in range(len(names))], handleInvalid="keep").transform(both)
    pairs = []
    for i, s in enumerate(names):
        part = F.col(f"_part_{i}").cast("int")
        whole = F.lit(False)
        for first, last in exact[s]:
            whole = whole | part.between(first, last)
        pairs.append(F.struct(F.lit(s).alias("sensor"), part.alias("part"), whole.alias("exact"), F.when(whole, F.col(s)).alias("x"), F.col(s).isNotNull().alias("ok")))
    values = numbered.select("is_ref", F.inline(F.array(*pairs))).where("ok")
    counts = [F.count_if("is_ref").alias("a"), F.count_if(~F.col("is_ref")).alias("b")]
    merged = values.groupBy("sensor", "part", "exact", "x").agg(*counts)
    sizes = {"n": {p.sensor: float(p.n_ref) for p in told}, "m": {p.sensor: float(p.n_cur) for p in told}}
    merged = merged.withColumns({c: F.create_map(*[F.lit(x) for pair in by.items() for x in pair])[F.col("sensor")] for c, by in sizes.items()})
    upto = W.partitionBy("sensor", "part").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    inside = F.sum("a").over(upto) / F.col("n") - F.sum("b").over(upto) / F.col("m")
    parts = merged.withColumn("inside", inside).groupBy("sensor", "part", "exact", "n", "m").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("inside").alias("highest"), F.min("inside").alias("lowest")
    )
    before = W.partitionBy("sensor").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("a").over(before), F.lit(0)) / F.col("n") - F.coalesce(F.sum("b").over(before), F.lit(0)) / F.col("m")
    beyond = F.greatest(F.abs(F.col("start") + F.col("a") / F.col("n")), F.abs(F.col("start") - F.col("b") / F.col("m")))
    # Of a part that is only counted, what is known is the gap at its end.
    known = F.greatest(F.abs(F.col("start") + F.col("highest")), F.abs(F.col("start") + F.col("lowest")))
    return parts.withColumn("start", start).select("sensor", "part", "exact", known.alias("gap"), F.when(F.col("exact"), known).otherwise(beyond).alias("most"))


def _statistics(both: DataFrame, profiled: Sequence[Profile], points: int) -> DataFrame:
    told = [p for p in profiled if p.n_ref and p.n_cur]
    schema = "sensor string, n_ref long, n_cur long, d double"
    spark = both.sparkSession
    if not told:
        return spark.createDataFrame([], schema)
    # Two cuts at least, or there is nothing to split.
    cuts = {p.sensor: np.unique(np.array([*p.cuts_ref, *p.cuts_cur, 0.0]) + 0.0) for p in told}
    exact = {p.sensor: _ranges(_promising(p, cuts[p.sensor], points)) for p in told}
    found: dict[str, float] = {}
    while len(found) < len(told):
        left = [p for p in told if p.sensor not in found]
        gaps = shared.settle(_part_gaps(both, left, cuts, exact), "drift-parts")
        best = {r["sensor"]: r["d"] for r in gaps.groupBy("sensor").agg(F.max("gap").alias("d")).collect()}
        # Parts that could still beat the best are counted exactly in another read; the sketches' errors seldom leave any.
        top = F.max("gap").over(W.partitionBy("sensor"))
        open_parts = gaps.withColumn("d", top).where(~F.col("exact") & (F.col("most") > F.col("d"))).select("sensor", "part").collect()
        for p in left:
            missing = [r["part"] for r in open_parts if r["sensor"] == p.sensor]
            if not missing:
                found[p.sensor] = best[p.sensor]
                continue
            marks = np.zeros(len(cuts[p.sensor]) + 1, bool)
            marks[missing] = True
            for first, last in exact[p.sensor]:
                marks[first : last + 1] = True
            exact[p.sensor] = _ranges(marks)
    rows = [F.struct(F.lit(p.sensor).alias("sensor"), *[F.lit(x).cast("long").alias(c) for c, x in (("n_ref", p.n_ref), ("n_cur", p.n_cur))], F.lit(found[p.sensor]).alias("d")) for p in told]
    return spark.range(1).select(F.inline(F.array(*rows)))


def ks_statistics(
    reference: DataFrame, current: DataFrame, sensors: Sequence[str] = config.SENSORS, slices: int = SLICES
) -> DataFrame:
    """``(sensor, n_ref, n_cur, d)`` for each sensor with values on both sides; any ``slices`` give the exact distance.

    1. One read of both sides sketches each sensor's quantiles on either side. Where these cut the values, the gap between the two
       distributions is known but for the sketches' error, which leaves few parts that can hold the largest gap.
    2. A second read counts every part, and in those few the single values. A part's counts bound the gap inside it: if
       a part that was only counted could beat the best gap found, it is counted exactly as well, in another read.

    No task holds more than the distinct values of one part of one sensor, and no table of values is written.
    """
    return ks_of(sides(reference, current, sensors), sensors, slices)


def ks_of(both: DataFrame, sensors: Sequence[str] = config.SENSORS, slices: int = SLICES) -> DataFrame:
    """As ``ks_statistics``, for both sides in one table (``halves``, ``sides``)."""
    points = max(2, slices // 2)
    return _statistics(both, profiles(both, sensors, points)[1], points)


def p_value(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value: the alternating Kolmogorov series, 1 below the range it converges in."""
    size = F.sqrt(n.cast("double") * m.cast("double") / (n + m).cast("double"))
    lam = size * d
    term = lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES_TERMS)), F.lit(0.0), term)
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * total)))


def drift_table(reference: DataFrame, current: DataFrame, sensors: Sequence[str] = config.SENSORS) -> DataFrame:
    return judged(ks_statistics(reference, current, sensors))


def judged(stats: DataFrame) -> DataFrame:
    """Adds ``p_value`` and ``drifted`` to the statistics of each sensor."""
    return stats.withColumn("p_value", p_value(F.col("d"), F.col("n_ref"), F.col("n_cur"))).withColumn(
        "drifted", F.col("p_value") < config.DRIFT_P_VALUE
    )


def alert_level(share: Column) -> Column:
    return (
        F.when(share > config.DRIFT_CRITICAL_SHARE, "CRITICAL")
        .when(share > config.DRIFT_WARNING_SHARE, "WARNING")
        .otherwise("OK")
    )


def drift_summary(
    reference: DataFrame,
    current: DataFrame,
    sensors: Sequence[str] = config.SENSORS,
    min_rows: int = config.DRIFT_MIN_ROWS,
) -> DataFrame:
    """One row for the whole check; no row when ``current`` has fewer than ``min_rows`` rows.

    Sensors present on both sides count in the denominator even when one side holds no value. When no wanted
    sensor is present the row carries the level ERROR instead of failing the job.
    """
    wanted = [s for s in sensors if s in reference.columns]
    available = [s for s in wanted if s in current.columns]
    missing = [s for s in wanted if s not in current.columns]
    if not available:
        empty = current.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
        return empty.select(
            F.lit(False).alias("drift_detected"),
            F.lit(0.0).alias("drift_share"),
            F.lit("").alias("drifted_features"),
            F.lit(0).alias("total_features"),
            F.lit("").alias("missing_features"),
            F.lit("ERROR").alias("alert_level"),
        )
    return summary_of(sides(reference, current, available), available, missing, min_rows)


def summary_of(both: DataFrame, available: Sequence[str], missing: Sequence[str] = (), min_rows: int = config.DRIFT_MIN_ROWS) -> DataFrame:
    """As ``drift_summary``, for both sides in one table (``halves``, ``sides``)."""
    points = SLICES // 2
    rows, told = profiles(both, available, points)
    enough = rows >= min_rows
    # One row per sensor reaches this aggregate.
    drifted = F.sort_array(F.collect_list(F.when(F.col("drifted"), F.col("sensor"))))
    table = judged(_statistics(both, told if enough else [], points)).agg(drifted.alias("names"))
    share = F.size("names") / F.lit(float(len(available)))
    return table.where(F.lit(enough)).select(
        (share > config.DRIFT_WARNING_SHARE).alias("drift_detected"),
        F.bround(share, 4).alias("drift_share"),
        F.array_join("names", ",").alias("drifted_features"),
        F.lit(len(available)).alias("total_features"),
        F.lit(",".join(missing)).alias("missing_features"),
        alert_level(share).alias("alert_level"),
    )
