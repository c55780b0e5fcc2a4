"""Sinks for micro-batches. Every write is keyed by the batch number, so a batch that runs twice leaves one result."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclewise.functions import scalars as S
from cyclewise.operators import chunked


@contextmanager
def adaptive(spark: SparkSession) -> Iterator[None]:
    """Adaptive execution for what a micro-batch is made into. A stream turns it off for its own plan and so for the jobs of its batches:
    without it a rebalance isn't done, and each join and aggregate runs in all shuffle partitions however few rows there are."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Snapshot:
    """A table of a few rows per key, of which a micro-batch rewrites only the buckets its keys fall in.

    A bucket's rows lie in one folder for each batch that wrote it. Batch n reads the newest folder below n and writes its
    own, so a failed or repeated batch finds its input unharmed; folders that no repeat can need any more are removed.
    The driver lists folders, of which there are at most a few per bucket; it sees no rows. ``buckets`` bounds the rows of a
    task that writes, so it grows with the number of keys (some ten thousand a bucket); a table keeps the number it began with.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "engine_id", buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self._root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _written(self) -> dict[int, list[int]]:
        """Batches that wrote each bucket, in order."""
        found: dict[int, list[int]] = {}
        if self._files.exists(self._root):
            for status in self._files.globStatus(self._root.suffix("/_bucket=*/_batch=*")) or []:
                bucket, batch = (int(part.split("=")[1]) for part in status.getPath().toString().split("/")[-2:])
                found.setdefault(bucket, []).append(batch)
        return {bucket: sorted(batches) for bucket, batches in found.items()}

    def _read(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self.schema).option("basePath", self.path)
        return (rows.parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)).drop("_batch", "_bucket")

    def touched(self, rows: DataFrame) -> list[int]:
        """The numbers of the buckets that the keys of ``rows`` fall in."""
        return sorted(r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect())

    def before(self, batch: int, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows as they were before ``batch``, of all buckets or of those given."""
        newest = {b: [n for n in batches if n < batch] for b, batches in self._written().items() if buckets is None or b in buckets}
        return self._read([f"{self.path}/_bucket={b}/_batch={batches[-1]}" for b, batches in newest.items() if batches])

    def replace(self, batch: int, rows: DataFrame) -> None:
        """Write the buckets of ``rows``, which must hold all rows of these buckets."""
        filed = rows.withColumns({"_bucket": self._bucket(), "_batch": F.lit(batch).cast("long")})
        # One bucket is one task's work: a few rows for each key of the bucket.
        dealt = filed.repartition("_bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_batch").parquet(self.path)
        for bucket, batches in self._written().items():
            for old in [n for n in batches if n < batch][:-1]:
                self._files.delete(self._root.suffix(f"/_bucket={bucket}/_batch={old}"), True)

    def latest(self) -> DataFrame:
        """The newest rows of every bucket."""
        return self._read([f"{self.path}/_bucket={b}/_batch={batches[-1]}" for b, batches in self._written().items()])


def upsert_latest(before: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key over the old snapshot and the new rows; map-side combined, one shuffle of one row per key."""
    columns = batch.columns
    return chunked.latest_per_key(before.select(*columns).unionByName(batch), key, order)


def write_offline(vectors: DataFrame, path: str, batch: int, by: str = "event_time") -> None:
    """Append feature vectors under ``date=/hour=``; a repeated batch overwrites only its own partitions.

    ``by`` = 'event_time' files a vector under its own time, 'ingest' under the time of writing.
    """
    millis = F.unix_millis(F.current_timestamp()) if by == "ingest" else F.col("event_time")
    date, hour = S.partition_parts(millis)
    filed = vectors.withColumns({"date": date, "hour": hour, "batch": F.lit(batch)})
    (
        # Few files per folder, and a crowded hour is still split over tasks.
        filed.hint("rebalance", "date", "hour")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy("date", "hour", "batch")
        .parquet(path)
    )


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Write one batch's rows into the batch's own folder."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def drop_batches(spark: SparkSession, path: str, before: int) -> None:
    """Remove the folders of batches below ``before``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(root.suffix("/batch=*")) or []:
        if int(status.getPath().getName().split("=")[1]) < before:
            files.delete(status.getPath(), True)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches written so far; no rows when nothing was written."""
    return read_or_empty(spark, f"{path}/batch=*", schema)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
