"""Evaluation of predicted against true remaining life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewise import config, shared
from cyclewise.functions import scalars as S


def error_table(df: DataFrame, score: Column, truth: Column, clip: float = config.RUL_CLIP) -> DataFrame:
    """``unit, true_rul, pred_rul, error, abs_error`` with predictions clipped to [0, clip]."""
    predicted = S.clamp(score * F.lit(float(clip)), 0.0, clip)
    return df.select("unit", truth.cast("double").alias("true_rul"), predicted.alias("pred_rul")).withColumns(
        {"error": F.col("pred_rul") - F.col("true_rul"), "abs_error": F.abs(F.col("pred_rul") - F.col("true_rul"))}
    )


def error_ranges(errors: DataFrame) -> DataFrame:
    return errors.agg(
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("pred_rul", "true_rul") for f in (F.min, F.max)]
    )


def rmse() -> Column:
    return F.sqrt(F.avg(F.pow(F.col("error"), F.lit(2.0))))


def nasa_score() -> Column:
    """Asymmetric penalty: a late prediction (positive error) costs more than an early one."""
    d = F.col("error")
    return F.sum(F.when(d < 0, F.exp(-d / 13) - 1).otherwise(F.exp(d / 10) - 1))


def confusion(threshold: float = config.CRITICAL_RUL) -> dict[str, Column]:
    """Aggregates ``tp, fp, fn, tn`` for the class 'critical' (RUL below the threshold, strict)."""
    true, pred = F.col("true_rul") < threshold, F.col("pred_rul") < threshold
    return {
        "tp": F.count_if(true & pred),
        "fp": F.count_if(~true & pred),
        "fn": F.count_if(true & ~pred),
        "tn": F.count_if(~true & ~pred),
    }


def confusion_counts(errors: DataFrame, threshold: float = config.CRITICAL_RUL) -> DataFrame:
    return errors.agg(*[c.alias(n) for n, c in confusion(threshold).items()])


def confusion_matrix(errors: DataFrame, threshold: float = config.CRITICAL_RUL) -> DataFrame:
    """Four rows ``(critical_true, critical_pred, n)``; empty cells stay with 0."""
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("critical_true"), F.lit(p).alias("critical_pred"), F.col(c).alias("n"))
            for t, p, c in ((False, False, "tn"), (False, True, "fp"), (True, False, "fn"), (True, True, "tp"))
        ]
    )
    return confusion_counts(errors, threshold).select(F.explode(cells).alias("r")).select("r.*")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def report_from_counts(counts: DataFrame) -> DataFrame:
    """Rows ``(class, precision, recall, f1, support)`` from one row ``tp, fp, fn, tn``.

    Classes: the two labels, 'accuracy' (in all three ratio columns), 'macro avg', 'weighted avg'.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def scores(hit: Column, wrong: Column, missed: Column) -> tuple[Column, Column, Column, Column]:
        precision, recall = _ratio(hit, hit + wrong), _ratio(hit, hit + missed)
        return precision, recall, _ratio(2 * precision * recall, precision + recall), hit + missed

    safe, critical = scores(tn, fn, fp), scores(tp, fp, fn)
    macro = [(a + b) / 2 for a, b in zip(safe[:3], critical[:3])]
    weighted = [_ratio(a * safe[3] + b * critical[3], n) for a, b in zip(safe[:3], critical[:3])]
    accuracy = _ratio(tp + tn, n)
    rows = [
        ("Non-Critical", *safe),
        ("Critical", *critical),
        ("accuracy", accuracy, accuracy, accuracy, n),
        ("macro avg", *macro, n),
        ("weighted avg", *weighted, n),
    ]
    names = ("precision", "recall", "f1", "support")
    structs = [
        F.struct(F.lit(label).alias("class"), *[v.alias(c) for c, v in zip(names, values)]) for label, *values in rows
    ]
    return counts.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def classification_report(errors: DataFrame, threshold: float = config.CRITICAL_RUL) -> DataFrame:
    return report_from_counts(confusion_counts(errors, threshold))


def metrics_row(errors: DataFrame, threshold: float = config.CRITICAL_RUL) -> DataFrame:
    """All headline metrics in one pass, unrounded."""
    counts = errors.agg(
        rmse().alias("rmse"), nasa_score().alias("nasa_score"), *[c.alias(n) for n, c in confusion(threshold).items()]
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = _ratio(2 * precision * recall, precision + recall)
    safe_p, safe_r = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    safe_f1 = _ratio(2 * safe_p * safe_r, safe_p + safe_r)
    n = tp + fp + fn + tn
    return counts.select(
        "rmse",
        "nasa_score",
        precision.alias("precision_critical"),
        recall.alias("recall_critical"),
        f1.alias("f1_critical"),
        _ratio(tp + tn, n).alias("accuracy"),
        _ratio(f1 * (tp + fn) + safe_f1 * (tn + fp), n).alias("f1_weighted"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """The metrics as reported: RMSE to 2 digits, score to 1, the rest to 3; missing ones are 0."""
    digits = {"rmse": 2, "nasa_score": 1}
    return metrics.select(
        *[S.half_even(F.coalesce(F.col(c), F.lit(0.0)), digits.get(c, 3)).alias(c) for c in metrics.columns]
    )


def targets(rounded: DataFrame) -> DataFrame:
    """Each reported metric with its target and whether it is met (strict comparisons)."""
    rows = []
    for name, op, goal in config.METRIC_TARGETS:
        value = F.col(name)
        met = value < goal if op == "<" else value > goal
        rows.append(
            F.struct(
                F.lit(name).alias("metric"),
                value.alias("value"),
                F.lit(f"{op} {goal:g}").alias("target"),
                F.coalesce(met, F.lit(False)).alias("ok"),
            )
        )
    return rounded.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def promotion(metrics: DataFrame, rmse_max: float = config.PROMOTION_RMSE, nasa_max: float = config.PROMOTION_NASA):
    return metrics.select(
        "rmse",
        "nasa_score",
        ((F.col("rmse") <= rmse_max) & (F.col("nasa_score") <= nasa_max)).alias("promote"),
    )


def rul_bin(rul: Column) -> Column:
    """Right-closed bins; 0 and values above the last edge belong to none."""
    label = None
    for name, low, high in config.RUL_BINS:
        inside = (rul > low) & (rul <= high)
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return label


def error_by_bin(errors: DataFrame) -> DataFrame:
    return (
        errors.select(rul_bin(F.col("true_rul")).alias("bucket"), "abs_error")
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(S.half_even(F.avg("abs_error"), 2).alias("mean_abs_error"), F.count(F.lit(1)).alias("n"))
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins are listed with 0.

    A column with a single value gets bins of total width 1 around it. Null, NaN and infinite values are left out.
    """
    x = F.col(column).cast("double")
    df = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    limits = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    limits = shared.settle(limits, "limits")
    flat = F.col("lo") == F.col("hi")
    limits = limits.where(F.col("lo").isNotNull()).select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        (F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins).alias("width"),
    )
    lo, width = limits.select("lo").scalar(), limits.select("width").scalar()
    slot = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    spine = limits.select("lo", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(counts, F.col("bin") == F.col("_slot"), "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("low"),
        F.coalesce("_n", F.lit(0)).alias("n"),
    )


def deviations(df: DataFrame, columns: list[str], cut: float = 0.01) -> DataFrame:
    """Sample standard deviation per sensor, smallest first, and whether the sensor is too flat to keep."""
    stats = df.agg(*[F.stddev_samp(c).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("sensor"), F.col(c).alias("std")) for c in columns]
    long = stats.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")
    return long.withColumn("drop", F.coalesce(F.col("std") < cut, F.lit(False))).orderBy("std", "sensor")


def best_epoch(history: DataFrame, run: str, epoch: str, val_loss: str) -> DataFrame:
    """Per training run: the first epoch with the smallest validation loss, and the last epoch's loss."""
    return history.groupBy(run).agg(
        F.min_by(epoch, F.struct(val_loss, epoch)).alias("best_epoch"),
        F.min(val_loss).alias("best_val_loss"),
        F.max(epoch).alias("final_epoch"),
        F.max_by(val_loss, epoch).alias("final_val_loss"),
    )
