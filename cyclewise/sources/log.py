"""A partitioned log of messages as a stream source that is polled for a bounded number of rows.

The log is a folder with one subfolder for each partition; a message has an ``offset``, counted from 1 without
gaps inside its partition. Messages of one key lie in one partition, so their order is that of the offsets. A poll takes at most
``rows`` messages in all, dealt out fairly among the partitions that have new ones; how far each partition has been read
is a map from partition to offset, which the query keeps in its checkpoint. Executors read the messages; the
driver only reads the footers of the newest files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from cyclewise.operators import chunked

# A poll takes this many rows unless told otherwise, and a task this many of them.
POLL_ROWS = 200
TASK_ROWS = 100_000


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"^[a-z0-9+.-]+://?", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def append(messages: DataFrame, path: str, partitions: int, key: str, order: Sequence[str]) -> None:
    """Put messages into the log behind those that are there; ``order`` is the order in which they arrived.

    Null is a key like others. Each partition's new messages are files of at most ``TASK_ROWS``, sorted by offset, and written by as many
    tasks; a poll opens those that hold what it takes.
    """
    spark = messages.sparkSession
    dealt = messages.withColumn("partition", F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int"))
    chunk = F.floor(F.col(order[0]) / 100_000).cast("long")
    placed = chunked.with_ordinal(dealt, ["partition"], [F.col(c) for c in order], chunk, "offset")
    ends = LogReader(path, POLL_ROWS, None).ends()
    if ends:
        known = spark.createDataFrame([(int(p), n) for p, n in ends.items()], "partition int, end long")
        placed = placed.join(F.broadcast(known), "partition", "left")
        placed = placed.withColumn("offset", F.col("offset") + F.coalesce("end", F.lit(0))).drop("end")
    block = F.floor((F.col("offset") - 1) / TASK_ROWS)
    rows = placed.repartition(F.col("partition"), block).sortWithinPartitions("partition", "offset")
    rows.write.mode("append").option("maxRecordsPerFile", TASK_ROWS).partitionBy("partition").parquet(path)


@dataclass
class Range(InputPartition):
    """Offsets ``after`` (exclusive) to ``upto`` of one partition, and the files that hold some of them."""

    partition: int
    after: int
    upto: int
    files: tuple[str, ...]

    def __post_init__(self):
        super().__init__(self.partition)


def shares(waiting: Mapping[str, int], rows: int) -> dict[str, int]:
    """Deal ``rows`` out among partitions with so many messages waiting: equal shares, and what one can't use goes to others."""
    out = dict.fromkeys(waiting, 0)
    left = rows
    open_ones = sorted((n, p) for p, n in waiting.items() if n > 0)
    while open_ones and left:
        n, p = open_ones.pop(0)
        out[p] = min(n, -(-left // (len(open_ones) + 1)))
        left -= out[p]
    return out


class LogReader(DataSourceStreamReader):
    """Admission of at most ``rows`` messages a poll; the position is a map from partition to the last offset taken.

    A restarted query plans its last batch again before it asks for more, and so tells a new reader where it was.
    """

    def __init__(self, path: str, rows: int, schema: T.StructType | None, start: Mapping[str, int] | None = None):
        self.path, self.rows, self.schema, self.start = path, rows, schema, dict(start or {})
        self.position: dict[str, int] | None = None

    def _folders(self) -> dict[str, list[pafs.FileInfo]]:
        files, root = open_path(self.path)
        found: dict[str, list[pafs.FileInfo]] = {}
        for info in files.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True)):
            if info.is_file and (hit := re.search(r"/partition=(\d+)/[^/._][^/]*\.parquet$", info.path)):
                found.setdefault(hit[1], []).append(info)
        return found

    def _spans(self) -> dict[str, tuple[str, int, int]]:
        """Partition, first and last offset of each file, from the footers of the files that are newer than those seen."""
        files, _ = open_path(self.path)
        known = self.__dict__.setdefault("_seen", {})
        for partition, infos in self._folders().items():
            for info in infos:
                if info.path not in known:
                    known[info.path] = (partition, *offsets(files, info.path))
        return known

    def ends(self) -> dict[str, int]:
        """The last offset of each partition."""
        out: dict[str, int] = {}
        for partition, _, end in self._spans().values():
            out[partition] = max(out.get(partition, 0), end)
        return out

    def initialOffset(self) -> dict:
        return {p: self.start.get(p, 0) for p in sorted(set(self.ends()) | set(self.start), key=int)}

    def latestOffset(self) -> dict:
        at = self.initialOffset() if self.position is None else self.position
        ends = self.ends()
        taken = shares({p: end - at.get(p, self.start.get(p, 0)) for p, end in ends.items()}, self.rows)
        at = {p: at.get(p, self.start.get(p, 0)) + taken.get(p, 0) for p in sorted(set(at) | set(ends), key=int)}
        self.position = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self.position is None:
            self.position = dict(end)
        by_partition: dict[str, list[tuple[int, int, str]]] = {}
        for path, (partition, low, high) in self._spans().items():
            by_partition.setdefault(partition, []).append((low, high, path))
        out = []
        for partition, upto in end.items():
            for after in range(start.get(partition, self.start.get(partition, 0)), upto, TASK_ROWS):
                last = min(after + TASK_ROWS, upto)
                held = [path for low, high, path in by_partition.get(partition, []) if low <= last and high > after]
                out.append(Range(int(partition), after, last, tuple(held)))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.files:
            raise ValueError(f"offsets {partition.after + 1} to {partition.upto} of partition {partition.partition} are not in the log")
        files, _ = open_path(self.path)
        rows = pads.dataset(list(partition.files), filesystem=files, format="parquet")
        wanted = (pads.field("offset") > partition.after) & (pads.field("offset") <= partition.upto)
        columns = {c: pads.scalar(partition.partition) if c == "partition" else pads.field(c) for c in self.schema.names}
        told = to_arrow_schema(self.schema)
        for batch in rows.to_batches(columns=columns, filter=wanted):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(batch.columns, told)], schema=told)

    def commit(self, end: dict) -> None:
        """Nothing to do: the position that counts is the one in the query's checkpoint."""


def offsets(files: pafs.FileSystem, path: str) -> tuple[int, int]:
    """The smallest and the largest offset in a file, from the statistics in its footer; of an empty one 0 and 0."""
    footer = pq.ParquetFile(path, filesystem=files).metadata
    column = footer.schema.to_arrow_schema().get_field_index("offset")
    told = [footer.row_group(i).column(column).statistics for i in range(footer.num_row_groups)]
    return min((s.min for s in told), default=0), max((s.max for s in told), default=0)


class LogSource(DataSource):
    """Format ``cyclewise_log``; options ``path``, ``rows`` (most in a poll) and ``start`` (JSON: partition to offset)."""

    @classmethod
    def name(cls) -> str:
        return "cyclewise_log"

    def streamReader(self, schema: T.StructType) -> LogReader:
        start = json.loads(self.options.get("start", "{}"))
        return LogReader(self.options["path"], int(self.options.get("rows", POLL_ROWS)), schema, start)


def polled(spark: SparkSession, path: str, schema: T.StructType | str, rows: int = POLL_ROWS, start: Mapping[str, int] | None = None) -> DataFrame:
    """The log as a stream, at most ``rows`` messages a micro-batch. ``schema`` may name any of the log's columns, also
    ``partition`` and ``offset``; reading begins behind ``start`` where no checkpoint says otherwise.

    Run it with ``jobs.run_until_done`` or ``jobs.run_forever``: one poll is all that a source of this kind gives a run of
    ``availableNow``.
    """
    spark.dataSource.register(LogSource)
    reader = spark.readStream.format("cyclewise_log").schema(schema).option("path", path).option("rows", rows)
    return reader.option("start", json.dumps(dict(start or {}))).load()


def kafka_options(
    servers: str,
    topic: str,
    per_trigger: int | None = None,
    start: Mapping[int, int] | None = None,
    group: str | None = None,
    extra: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options of Spark's Kafka source for a topic keyed by engine.

    Reading begins at the earliest message, or behind ``start`` (partition to the last offset taken; partitions not named
    begin at the earliest); a checkpoint's offsets go before both. ``extra`` are client settings, with or
    without their prefix. Messages that the broker has deleted before they were read are an error.
    """
    first = "earliest"
    if start:
        if min(start) < 0:
            raise ValueError("partitions are counted from 0")
        # -2 is the source's number for the earliest offset.
        named = {str(p): start[p] + 1 if p in start else -2 for p in range(max(start) + 1)}
        first = json.dumps({topic: named})
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": first, "failOnDataLoss": "true"}
    if per_trigger:
        out["maxOffsetsPerTrigger"] = str(per_trigger)
    if group:
        out["kafka.group.id"] = group
    for name, value in (extra or {}).items():
        out[name if name.startswith("kafka.") else f"kafka.{name}"] = value
    return out


def in_log_order(messages: DataFrame, key: Column | None = None) -> DataFrame:
    """Kafka's columns as the jobs take them: ``key``, ``value`` (text), ``partition`` and ``arrival``.

    Messages of one key are in one partition, in which the offset tells their order; so the offset is the arrival.
    """
    own = F.col("key").cast("string") if key is None else key
    return messages.select(own.alias("key"), F.col("value").cast("string").alias("value"), "partition", F.col("offset").alias("arrival"))
