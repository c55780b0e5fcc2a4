"""Registered queries: evaluation of predictions, reports, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewise.operators import evaluate
from cyclewise.plans.registry import query
from cyclewise.plans.views import Fleet

def errors(v: Fleet) -> DataFrame:
    return evaluate.error_table(v.pred, F.col("pred_norm"), F.col("true_rul"))


@query("error_table", "SELECT unit, true_rul, pred_rul, error, abs_error FROM errors")
def error_table(v: Fleet) -> DataFrame:
    return errors(v)


@query(
    "error_ranges",
    """SELECT min(pred_rul) AS min_pred_rul, max(pred_rul) AS max_pred_rul, min(true_rul) AS min_true_rul,
              max(true_rul) AS max_true_rul FROM errors""",
)
def error_ranges(v: Fleet) -> DataFrame:
    return evaluate.error_ranges(errors(v))


@query("regression_metrics", "SELECT round(sqrt(avg(error * error)), 6) AS rmse, count(*) AS n FROM errors")
def regression_metrics(v: Fleet) -> DataFrame:
    return errors(v).agg(F.round(evaluate.rmse(), 6).alias("rmse"), F.count(F.lit(1)).alias("n"))


@query("nasa_score", "SELECT round(nasa_score / 1000, 6) AS nasa_score_thousands FROM cells")
def nasa_score(v: Fleet) -> DataFrame:
    return errors(v).agg(F.round(evaluate.nasa_score() / 1000, 6).alias("nasa_score_thousands"))


@query(
    "confusion_matrix",
    """SELECT false AS critical_true, false AS critical_pred, tn AS n FROM cells UNION ALL SELECT false, true, fp FROM cells
       UNION ALL SELECT true, false, fn FROM cells UNION ALL SELECT true, true, tp FROM cells""",
)
def confusion_matrix(v: Fleet) -> DataFrame:
    return evaluate.confusion_matrix(errors(v))


@query(
    "classification_report",
    """SELECT class, round(CAST(p AS DOUBLE), 6) AS precision, round(CAST(r AS DOUBLE), 6) AS recall,
              round(CAST(f AS DOUBLE), 6) AS f1, support
       FROM (SELECT 'Non-Critical' AS class, p0 AS p, r0 AS r, f1_0 AS f, tn + fp AS support FROM class_scores
             UNION ALL SELECT 'Critical', p1, r1, f1_1, tp + fn FROM class_scores
             UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, n FROM class_scores
             UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n FROM class_scores
             UNION ALL SELECT 'weighted avg', (p0 * (tn + fp) + p1 * (tp + fn)) / n, (r0 * (tn + fp) + r1 * (tp + fn)) / n,
                              (f1_0 * (tn + fp) + f1_1 * (tp + fn)) / n, n FROM class_scores)""",
)
def classification_report(v: Fleet) -> DataFrame:
    report = evaluate.classification_report(errors(v))
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("evaluation_summary", "SELECT * FROM summary")
def evaluation_summary(v: Fleet) -> DataFrame:
    return evaluate.summary(evaluate.metrics_row(errors(v)))


@query(
    "metric_targets",
    """SELECT metric, value, target, ok FROM (
         SELECT 'rmse' AS metric, rmse AS value, '< 20' AS target, rmse < 20 AS ok FROM summary
         UNION ALL SELECT 'nasa_score', nasa_score, '< 2000', nasa_score < 2000 FROM summary
         UNION ALL SELECT 'precision_critical', precision_critical, '> 0.8', precision_critical > 0.8 FROM summary
         UNION ALL SELECT 'recall_critical', recall_critical, '> 0.75', recall_critical > 0.75 FROM summary
         UNION ALL SELECT 'f1_critical', f1_critical, '> 0.8', f1_critical > 0.8 FROM summary
         UNION ALL SELECT 'accuracy', accuracy, '> 0.8', accuracy > 0.8 FROM summary
         UNION ALL SELECT 'f1_weighted', f1_weighted, '> 0.8', f1_weighted > 0.8 FROM summary)""",
)
def metric_targets(v: Fleet) -> DataFrame:
    return evaluate.targets(evaluation_summary(v))


@query(
    "promotion_gate",
    """SELECT round(rmse, 6) AS rmse, round(nasa_score / 1000, 6) AS nasa_score_thousands,
              rmse <= 70 AND nasa_score <= 10000 AS promote FROM cells""",
)
def promotion_gate(v: Fleet) -> DataFrame:
    gate = evaluate.promotion(evaluate.metrics_row(errors(v)))
    return gate.select(
        F.round("rmse", 6).alias("rmse"),
        F.round(F.col("nasa_score") / 1000, 6).alias("nasa_score_thousands"),
        "promote",
    )


@query(
    "error_by_bucket",
    """SELECT bucket, round_even(avg(abs_error), 2) AS mean_abs_error, count(*) AS n
       FROM (SELECT abs_error, CASE WHEN true_rul > 0 AND true_rul <= 30 THEN 'critical(0-30)'
                                    WHEN true_rul > 30 AND true_rul <= 60 THEN 'degrading(30-60)'
                                    WHEN true_rul > 60 AND true_rul <= 90 THEN 'mid(60-90)'
                                    WHEN true_rul > 90 AND true_rul <= 125 THEN 'healthy(90-125)' END AS bucket FROM errors)
       WHERE bucket IS NOT NULL GROUP BY bucket""",
)
def error_by_bucket(v: Fleet) -> DataFrame:
    return evaluate.error_by_bin(errors(v))


@query(
    "error_histogram",
    """SELECT bin, round(lo + bin * width, 6) AS low, count(error) AS n
       FROM (SELECT CAST(unnest(range(30)) AS INTEGER) AS bin), (SELECT min(error) AS lo, (max(error) - min(error)) / 30 AS width FROM errors)
       LEFT JOIN errors ON least(CAST(floor((error - lo) / width) AS INTEGER), 29) = bin
       GROUP BY bin, lo, width""",
)
def error_histogram(v: Fleet) -> DataFrame:
    return evaluate.histogram(errors(v), "error", 30).withColumn("low", F.round("low", 6))
