"""Whitespace-separated text: raw cycle lines and positional truth files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclewise import config
from cyclewise.operators import chunked

TRUTH_MARK = "RUL"


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Text lines with their place in the input: ``(file, file_path, block, line_order, value)``.

    Lines are in order of (file_path, block, line_order): file name, offset of the block that one task reads, and
    a number that grows inside the block.
    """
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(path).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_order"),
        "value",
    )


def tokenize(lines: DataFrame) -> DataFrame:
    """Non-blank lines as ``tokens``; any run of blanks separates."""
    bare = lines.withColumn("value", F.btrim("value", F.lit(" \t\r\f\v"))).where(F.col("value") != "")
    return bare.withColumn("tokens", F.split("value", r"\s+")).drop("value")


def token_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    return tokenize(read_lines(spark, path, glob))


def cycles(
    lines: DataFrame, columns: Sequence[str] = config.RAW_COLUMNS, integers: Sequence[str] = ("unit", "cycle")
) -> DataFrame:
    """Raw cycle table with names given by position; a token that is not a number becomes null."""
    return tokenize(lines).select(*_numbers(columns, integers))


def placed_cycles(
    lines: DataFrame, columns: Sequence[str] = config.RAW_COLUMNS, integers: Sequence[str] = ("unit", "cycle")
) -> DataFrame:
    """The cycle table with ``place`` (file and block) and ``line_order``, which together give the line order."""
    place = F.struct("file_path", "block").alias("place")
    return tokenize(lines).select(place, "line_order", *_numbers(columns, integers))


def _numbers(columns: Sequence[str], integers: Sequence[str]) -> list[Column]:
    return [
        F.get("tokens", F.lit(i)).try_cast("int" if c in integers else "double").alias(c) for i, c in enumerate(columns)
    ]


def truth(lines: DataFrame) -> DataFrame:
    """Truth lines in input order: ``(pos, rul)`` with ``pos`` = 1, 2, ...

    Lines are numbered block by block: a count per block, its running sum over the blocks, and a row number
    inside the block. No sort of the whole input.
    """
    place = F.struct("file_path", "block").alias("place")
    values = tokenize(lines).select(place, "line_order", F.get("tokens", F.lit(0)).try_cast("int").alias("rul"))
    numbered = chunked.with_global_ordinal(values, [F.col("line_order")], F.col("place"), "pos")
    return numbered.select("pos", "rul")


def scan_cycles(
    spark: SparkSession, path: str, columns: Sequence[str] = config.RAW_COLUMNS, glob: str | None = None
) -> DataFrame:
    return cycles(read_lines(spark, path, glob), columns)


def scan_truth(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    return truth(read_lines(spark, path, glob))


def route(tokens: DataFrame) -> DataFrame:
    """Mark each line as belonging to a truth file or a main file, by name.

    A dataset that Spark wrote is a folder of part files; its name is the folder's.
    """
    parts = F.split("file_path", "/")
    name = F.when(F.col("file").startswith("part-"), F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))
    return tokens.withColumn("kind", F.when(F.upper(name).contains(TRUTH_MARK), "truth").otherwise("main"))


def write_cycles(df: DataFrame, path: str, columns: Sequence[str], gap: str = " ") -> None:
    """Write columns as whitespace-separated lines, without a header."""
    df.select(F.concat_ws(gap, *[F.col(c).cast("string") for c in columns]).alias("value")).write.text(path)
