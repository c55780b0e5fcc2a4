"""Small helpers that the operators on texts share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entries a worker's memo may hold before the older half of them goes.
MEMO_ENTRIES = 1 << 19
# Rows in one Arrow batch of whole texts. Spark bounds the bytes of a batch as well (64 MB unless the session says otherwise).
BATCH_ROWS = 256


class Memo(dict):
    """Results of a pure function on short strings: at most ``entries`` of them, in two generations.

    Looking up a known key runs in C (``map(memo.__getitem__, keys)``); only unknown keys reach Python.
    """

    LONGEST = 256

    def __init__(self, function: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self._function, self._half, self._old = function, max(1, entries // 2), {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._function(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self._half:
                self._old = dict(self)
                self.clear()
            self[key] = value
        return value


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``frame`` is called that."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_texts(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The named columns of ``docs``, to be sent to workers in small batches."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(*columns)


def per_text(docs: DataFrame, make: Callable[[], Callable], schema: str, *keep: str, text: str = "text") -> DataFrame:
    """Apply ``make()`` (built once in each worker) to the list of texts of every batch; null counts as empty.

    The function returns a dict of lists or arrays, one entry for each row; the columns in ``keep`` are passed on.
    """
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) if keep else ""
    full = ", ".join(x for x in (kept, schema) if x)

    def run(batches):
        function = make()
        for batch in batches:
            out = function([t or "" for t in batch.column(len(keep)).to_pylist()])
            columns = [batch.column(i) for i in range(len(keep))] + [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in out.values()]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *out])

    return whole_texts(docs, *keep, F.col(text).alias("__text")).mapInArrow(run, full)


def filter_texts(docs: DataFrame, make: Callable[[], Callable], text: str = "text") -> DataFrame:
    """The rows for whose texts the function that ``make()`` builds says True; it gets a list of texts (null: empty)."""

    def run(batches):
        function = make()
        for batch in batches:
            names = batch.schema.names
            kept = function([t or "" for t in batch.column(names.index(text)).to_pylist()])
            yield batch.filter(pa.array(kept, pa.bool_()))

    return whole_texts(docs, "*").mapInArrow(run, docs.schema)
