"""Data-quality checks on raw cycle lines and truth lines, each reported as a violation count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewise import config
from cyclewise.operators import chunked


def main_checks(lines: DataFrame, columns: Sequence[str] = config.RAW_COLUMNS) -> DataFrame:
    """Checks on tokenised main lines ``(tokens array<string>)`` in one pass: ``(check, violations)``."""
    bad_width = F.size("tokens") != len(columns)
    non_numeric = F.exists("tokens", lambda t: t.try_cast("double").isNull())
    return _long(
        lines.agg(
            F.count_if(bad_width).alias("column_count"),
            F.count_if(non_numeric).alias("numeric"),
            F.count_if(F.lit(True)).alias("rows"),
        )
    )


def truth_checks(lines: DataFrame) -> DataFrame:
    """Checks on tokenised truth lines ``(tokens array<string>)``: one number per line, not negative."""
    value = F.get("tokens", F.lit(0)).try_cast("double")
    return _long(
        lines.agg(
            F.count_if(F.size("tokens") != 1).alias("truth_column_count"),
            F.count_if(value.isNull()).alias("truth_numeric"),
            F.count_if(value < 0).alias("truth_negative"),
            F.count_if(F.lit(True)).alias("truth_rows"),
        )
    )


def _long(counts: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in counts.columns]
    exploded = counts.select(F.explode(F.array(*pairs)).alias("r")).select("r.check", "r.n")
    is_rows = F.col("check").endswith("rows")
    # An input without lines is itself a failure.
    return exploded.select(
        F.when(F.col("check") == "rows", "not_empty")
        .when(F.col("check") == "truth_rows", "truth_not_empty")
        .otherwise(F.col("check"))
        .alias("check"),
        F.when(is_rows, (F.col("n") == 0).cast("long")).otherwise(F.col("n")).alias("violations"),
    )


def cycle_order_violations(
    df: DataFrame,
    order: Sequence[str],
    chunk: Column,
    unit: str = "unit",
    cycle: str = "cycle",
    hot_rows: int | None = None,
) -> DataFrame:
    """Rows per unit whose cycle is below that of the line before; equal cycles are accepted.

    ``order`` gives the line order, ``chunk`` grows with it (for text: the block the line is in).
    """
    seen = chunked.with_previous(df, [unit], order, chunk, cycle, "_previous", hot_rows)
    return seen.groupBy(unit).agg(
        F.count_if(F.col(cycle) < F.col("_previous")).alias("violations"),
        F.count(F.lit(1)).alias("rows"),
    )


def verdict(checks: DataFrame) -> DataFrame:
    """``passed``/``failed`` over all checks, with the names of the failed ones (one row per check: bounded)."""
    failed = F.sort_array(F.collect_list(F.when(F.col("violations") > 0, F.col("check"))))
    return checks.agg(failed.alias("failed_checks")).select(
        F.when(F.size("failed_checks") == 0, "passed").otherwise("failed").alias("status"),
        F.array_join("failed_checks", ",").alias("error"),
    )
