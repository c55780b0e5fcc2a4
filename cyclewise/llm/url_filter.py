"""URL rules in a sorted digest array that workers memory-map.

A rule is a host, a path prefix and an action. It fits its host and all subdomains of it when the url's path starts with
its path; of several fitting rules the longest (host and path together, then host) holds. Urls without one get ``default``.

The index is one file: the sorted 64-bit xxHash keys of all rules, where each rule's string ends, the actions, and the
strings one after the other. Spark ships it to every executor (``addFile``); workers map it, probe the keys of a whole
batch by binary search and compare the stored strings, so that equal digests of different strings do no harm.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclewise import shared
from cyclewise.llm import texts

ACTIONS = ("allow", "block")
# Rules beyond this size are joined instead of shipped as one file.
INDEX_BYTES = 64 << 20
HEADER = 3  # 64-bit numbers: rules, longest host, number of path lengths


@dataclass(frozen=True)
class Index:
    name: str
    default: str


def normalized(rules: DataFrame) -> DataFrame:
    """``rule`` (host in lower case and path), ``host_size`` and ``action``, once each; block wins over allow."""
    host = F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (
        rules.where(F.length("host") > 0)
        .select(F.concat(host, F.coalesce("path", F.lit(""))).alias("rule"), F.length("host").alias("host_size"), "action")
        .groupBy("rule", "host_size")
        .agg(F.max("action").alias("action"))
    )


def build_index(rules: DataFrame, default: str = "allow") -> Index:
    """Write the index file of ``rules`` (host, path, action) below the shared folder and hand it to the executors.

    Rules without a host are left out; a null path is an empty one. The size is checked before anything is gathered.
    """
    spark, rules = rules.sparkSession, shared.settle(normalized(rules), "url-rules")
    if (rules.agg(F.sum(F.octet_length("rule") + 17)).head()[0] or 0) > INDEX_BYTES:
        raise ValueError("too many rules for one file; use judge_by_join")
    rows = sorted((xxhash.xxh64_intdigest(r.rule.encode()), r.rule.encode(), r.host_size, r.action) for r in rules.collect())
    lengths = sorted({len(r[1].decode()) - r[2] for r in rows})
    parts = (
        np.array([len(rows), max([0, *(r[2] for r in rows)]), len(lengths)], dtype="<u8"),
        np.array(lengths, dtype="<u8"),
        np.array([r[0] for r in rows], dtype="<u8"),
        np.cumsum([len(r[1]) for r in rows], dtype="<u8"),
        np.array([r[2] for r in rows], dtype="<u4"),
        np.array([ACTIONS.index(r[3]) for r in rows], dtype="u1"),
    )
    data = b"".join(p.tobytes() for p in parts) + b"".join(r[1] for r in rows)
    path = shared.scratch(spark, "url-index")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        for start in range(0, len(data), 1 << 20):
            out.write(data[start : start + (1 << 20)])
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return Index(os.path.basename(path), default)


class Digests:
    """The mapped index file."""

    def __init__(self, path: str):
        size = lambda kind, n: np.dtype(kind).itemsize * n
        n, self.longest_host, k = (int(x) for x in np.fromfile(path, dtype="<u8", count=HEADER))
        at = size("<u8", HEADER)

        def part(kind, count):
            nonlocal at
            out = np.memmap(path, dtype=kind, mode="r", offset=at, shape=(count,)) if count else np.empty(0, dtype=kind)
            at += size(kind, count)
            return out

        self.path_lengths = part("<u8", k).tolist()
        self.keys, self.ends, self.host_sizes, self.actions = part("<u8", n), part("<u8", n), part("<u4", n), part("u1", n)
        self.strings = part("u1", int(self.ends[-1]) if n else 0)

    def rule(self, i: int) -> bytes:
        return bytes(self.strings[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])])

    def find(self, candidates: list[str], digest: Callable = xxhash.xxh64_intdigest) -> list[int]:
        """The place of each candidate among the rules, or -1."""
        raw = [c.encode() for c in candidates]
        probes = np.array([digest(r) for r in raw], dtype="<u8")
        at = np.searchsorted(self.keys, probes)
        out = [-1] * len(raw)
        inside = np.flatnonzero(at < len(self.keys))
        for j in inside[self.keys[at[inside]] == probes[inside]].tolist():
            i = int(at[j])
            while i < len(self.keys) and self.keys[i] == probes[j]:
                if self.rule(i) == raw[j]:
                    out[j] = i
                    break
                i += 1
        return out


_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split(url: str) -> tuple[str, str]:
    """Host in lower case, and path, of a url; both empty where there is no ``://``."""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_UPPER), slash + path


def candidates(host: str, path: str, longest_host: int, path_lengths: list[int]) -> list[tuple[str, int]]:
    """The strings a fitting rule may have, with the host's size; the longest first."""
    names, at = [], max(0, len(host) - longest_host)
    if at:  # only whole labels
        at = host.find(".", at - 1) + 1 or len(host)
    while at < len(host):
        names.append(host[at:])
        at = host.find(".", at) + 1 or len(host)
    found = [(name + path[:n], len(name)) for name in names for n in path_lengths if n <= len(path)]
    return sorted(found, key=lambda c: (-len(c[0]), -c[1]))


def judge(pages: DataFrame, index: Index, *keep: str, url: str = "url") -> DataFrame:
    """``host``, ``path``, ``rule`` (null without one) and ``verdict`` of every row, beside the columns in ``keep``.

    A null url, or one without ``://``, has an empty host and path and gets the default. Repeated rows stay; other columns
    aren't read, so their names don't matter. An index without rules judges everything by default.
    """

    def make():
        digests = Digests(SparkFiles.get(index.name))

        def run(urls):
            parts = [split(u) for u in urls]
            tried = [candidates(h, p, digests.longest_host, digests.path_lengths) for h, p in parts]
            places = iter(digests.find([c for row in tried for c, _ in row]))
            hits = [[i for c, size in row if (i := next(places)) >= 0 and digests.host_sizes[i] == size] for row in tried]
            return {
                "host": [h for h, _ in parts],
                "path": [p for _, p in parts],
                "rule": pa.array([digests.rule(hit[0]).decode() if hit else None for hit in hits], pa.string()),
                "verdict": [ACTIONS[digests.actions[hit[0]]] if hit else index.default for hit in hits],
            }

        return run

    return texts.per_text(pages, make, "host string, path string, rule string, verdict string", *keep, text=url)


def judge_by_join(pages: DataFrame, rules: DataFrame, *keep: str, url: str = "url", default: str = "allow") -> DataFrame:
    """As ``judge``, for rule sets of any size: the candidates of each distinct url are joined with the rules."""
    rules = shared.settle(normalized(rules), "url-rules")
    lengths = [int(r[0]) for r in rules.select(F.length("rule") - F.col("host_size")).distinct().collect()]
    longest = rules.agg(F.max("host_size")).head()[0] or 0

    def run(urls):
        parts = [split(u) for u in urls]
        tried = [candidates(h, p, longest, lengths) for h, p in parts]
        kind = pa.list_(pa.struct([("rule", pa.string()), ("host_size", pa.int32())]))
        return {
            "host": [h for h, _ in parts],
            "path": [p for _, p in parts],
            "tried": pa.array([[{"rule": c, "host_size": n} for c, n in row] for row in tried], kind),
        }

    once = pages.select(F.coalesce(F.col(url), F.lit("")).alias("__url")).distinct()
    schema = "host string, path string, tried array<struct<rule: string, host_size: int>>"
    split_up = shared.settle(texts.per_text(once, lambda: run, schema, "__url", text="__url"), "url-candidates")
    best = (
        split_up.select("__url", F.explode("tried").alias("t"))
        .select("__url", "t.rule", "t.host_size")
        .join(rules, ["rule", "host_size"])
        .groupBy("__url")
        .agg(F.max(F.struct(F.length("rule").alias("size"), "host_size", "rule", "action")).alias("best"))
    )
    judged = shared.settle(
        split_up.join(best, "__url", "left").select(
            "__url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
        ),
        "url-verdicts",
    )
    rows = pages.select(*keep, F.coalesce(F.col(url), F.lit("")).alias("__url"))
    return rows.join(judged, "__url").drop("__url")
