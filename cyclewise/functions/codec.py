"""Binary form of a feature tensor: big-endian single precision, row after row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def pack_tensor(values: pd.Series) -> pd.Series:
    """All values of a batch are converted at once and cut up again by their lengths."""
    known = values[values.notna()]
    ends = np.cumsum([0, *map(len, known)]) * 4
    data = np.concatenate([np.asarray(v, dtype="f4") for v in known] or [np.empty(0, "f4")]).astype(">f4").tobytes()
    parts = pd.Series([data[a:b] for a, b in zip(ends, ends[1:])], index=known.index, dtype=object)
    return parts.reindex(values.index).where(values.notna(), None)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_tensor(blob: pd.Series) -> pd.Series:
    known = blob[blob.notna()]
    ends = np.cumsum([0, *map(len, known)]) // 4
    data = np.frombuffer(b"".join(known), dtype=">f4").astype("f4")
    parts = pd.Series([data[a:b] for a, b in zip(ends, ends[1:])], index=known.index, dtype=object)
    return parts.reindex(blob.index).where(blob.notna(), None)
