"""Secrets in texts, by a trigram inverted index and DataFrame expressions alone.

From each rule's pattern a Boolean query over trigrams is derived: every text that the pattern matches satisfies it. The
index holds, for each trigram that some query names, the keys of the texts containing it (in lower case). Intersecting
the postings leaves the candidate texts of each rule; only these are searched with the pattern itself. A pattern that
guarantees no trigram is searched for in all texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewise import shared
from cyclewise.llm import texts

# Candidate keys that may be sent to all executors; more are joined.
SENT_KEYS = 1 << 20
# Numbers that a running sum takes at a time, and characters of a piece of text that is redacted.
BLOCK = 256
PIECE = 4096
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count if they, or their group ``group``, have at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


BASE_RULES = (
    Rule("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
RULES = (
    *BASE_RULES,
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
MARK = "[SECRET]"

# --- Trigram queries: ("and", parts), ("or", parts) or a trigram; ("and", ()) holds for every text.
ALWAYS = ("and", ())


def _all_of(parts) -> tuple | str:
    """The parts together; nested conjunctions are opened."""
    opened = (x for p in parts for x in (p[1] if isinstance(p, tuple) and p[0] == "and" else (p,)))
    kept = tuple(dict.fromkeys(opened))
    return kept[0] if len(kept) == 1 else ("and", kept)


def _any_of(parts) -> tuple | str:
    """One of the parts; a part that another one follows from is enough (a or (a and b) is a)."""
    opened = list(dict.fromkeys(x for p in parts for x in (p[1] if isinstance(p, tuple) and p[0] == "or" else (p,))))
    terms = {p: frozenset(p[1] if isinstance(p, tuple) and p[0] == "and" else (p,)) for p in opened}
    kept = tuple(p for p in opened if not any(terms[q] < terms[p] for q in opened))
    return ALWAYS if not kept else kept[0] if len(kept) == 1 else ("or", kept)


def _query_of(strings: set[str]) -> tuple | str:
    return _any_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str) -> tuple | str:
    """A condition on the trigrams of a lower-cased text that every match of ``pattern`` fulfils."""

    def walk(nodes) -> tuple[set[str] | None, list]:
        """All strings that the nodes can match, if they are few, else None; and conditions that hold in any case."""
        conditions, strings, few = [], {""}, True
        for kind, value in nodes:
            some, name = None, str(kind)
            if name == "LITERAL":
                some = {chr(value).lower()}
            elif name == "IN" and all(str(k) == "LITERAL" for k, _ in value):
                some = {chr(v).lower() for _, v in value}
            elif name == "SUBPATTERN":
                some, more = walk(value[-1])
                conditions += more
            elif name == "BRANCH":
                branches = [walk(b) for b in value[1]]
                conditions.append(_any_of([_all_of([*more, _query_of(s or {""})]) for s, more in branches]))
                if all(s is not None for s, _ in branches):
                    some = set().union(*(s for s, _ in branches))
            elif name == "MAX_REPEAT":
                low, high, body = value
                inner, more = walk(body)
                if low > 0:
                    conditions += [*more, _query_of(inner or {""})]
                if (low, high) == (0, 1) and inner is not None:
                    some = inner | {""}
            if some is None or len(some) * len(strings) > MOST_STRINGS:
                conditions.append(_query_of(strings))
                strings, few = some if some is not None and len(some) <= MOST_STRINGS else {""}, False
            else:
                strings = {a + b for a, b in product(strings, some)}
        if few:
            return strings, conditions
        return None, [*conditions, _query_of(strings)]

    strings, conditions = walk(list(re._parser.parse(pattern)))
    return _all_of([*conditions, _query_of(strings or {""})])


def trigrams(query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _holds(query, mask: Column, bit: dict[str, int]) -> Column:
    if isinstance(query, str):
        return mask.bitwiseAND(F.lit(1 << bit[query])) != 0
    kind, parts = query
    return reduce(Column.__and__ if kind == "and" else Column.__or__, (_holds(p, mask, bit) for p in parts))


def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def postings(docs: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """The inverted index: ``trigram`` and ``text_key``, once each, for the trigrams asked for."""
    folded = F.lower(_body(text))
    found = F.array(*(F.when(F.contains("__folded", F.lit(t)), F.lit(t)) for t in names))
    rows = docs.select(F.xxhash64(_body(text)).alias("text_key"), folded.alias("__folded"))
    return rows.select("text_key", F.explode(F.array_compact(found)).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """``text_key`` and ``__rules`` (bit i: rule i may match) of the texts that fulfil some rule's trigram query."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ALWAYS}
    names = sorted(set().union(*(trigrams(q) for q in queries.values()))) if queries else []
    if len(names) > 63:
        raise ValueError("the rules' queries name more than 63 trigrams; scan with fewer rules at a time")
    if not names:
        return docs.sparkSession.createDataFrame([], "text_key bigint, __rules bigint")
    index = shared.settle(postings(docs, names, text), "postings")
    bit = {t: i for i, t in enumerate(names)}
    number = F.element_at(F.create_map(*(x for t, i in bit.items() for x in (F.lit(t), F.lit(1 << i)))), F.col("trigram"))
    masks = index.groupBy("text_key").agg(F.bit_or(number.cast("bigint")).alias("mask"))
    fits = reduce(
        Column.bitwiseOR, (F.when(_holds(q, F.col("mask"), bit), F.lit(1 << i)).otherwise(F.lit(0)) for i, q in queries.items())
    )
    return shared.settle(masks.select("text_key", fits.cast("bigint").alias("__rules")).where("__rules != 0"), "candidates")


def searched(rule: Rule) -> str:
    """The pattern to look for. Where a match is one run of a class, perhaps behind letters of that class, its least
    length goes into the pattern: shorter runs are dropped anyway, and hold no longer one."""
    told = re.fullmatch(r"(\w*)(\[[^\]]+\])\+", rule.pattern)
    if rule.group or not told or not all(re.fullmatch(told[2], c) for c in told[1]):
        return rule.pattern
    return f"{told[1]}{told[2]}{{{max(1, rule.least - len(told[1]))},}}"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once; an expression that a lambda mentions is computed in each of its calls."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array, what the numbers before it join to (0 for the first).

    Appending to an array copies it. So the array is taken in blocks: what comes before a block first, then its own numbers.
    """

    def one_by_one(numbers: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda state, x: F.struct(join(state["at"], x).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))
        return F.aggregate(numbers, empty, step, lambda state: state["out"])

    def by_block(numbers: Column) -> Column:
        count = F.greatest(F.ceil(F.size(numbers) / BLOCK).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(numbers, (i - 1) * BLOCK + 1, BLOCK))

    def joined(blocks: Column) -> Column:
        before = one_by_one(F.transform(blocks, lambda numbers: F.aggregate(numbers, F.lit(0), join)), F.lit(0))
        return F.flatten(F.zip_with(blocks, before, one_by_one))

    return _let(values, lambda numbers: _let(by_block(numbers), joined))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of the rule's matches; offsets count code points."""
    pattern = searched(rule)
    size = lambda x: F.length(F.regexp_extract(x["found"], rule.pattern, rule.group) if rule.group else x["found"])
    start = lambda x: x["before"] + x["gap"]
    span = lambda x: F.struct(start(x).alias("start"), F.lit(order).alias("order"), (start(x) + F.length(x["found"])).alias("end"))

    def placed(x: Column) -> Column:
        before = _running(F.zip_with(x["gap"], x["found"], lambda g, f: g + F.length(f)), lambda a, b: a + b)
        matches = F.arrays_zip(before.alias("before"), x["gap"].alias("gap"), x["found"].alias("found"))
        return F.transform(F.filter(matches, lambda m: size(m) >= rule.least), span)

    gaps = lambda found: F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda found: _let(F.struct(found.alias("found"), gaps(found).alias("gap")), placed))


def _worth(text: Column, rule: Rule) -> Column:
    """Cheaply: whether a match that is long enough can exist at all. Only for patterns that hold their least length."""
    pattern = searched(rule)
    return F.rlike(text, F.lit(pattern)) if pattern != rule.pattern else F.lit(True)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with one more column, ``name``: array of (start, end, kind), by start and then in the order of the rules.

    Matches are leftmost and non-overlapping for each rule; those that are too short are dropped after matching. A null or
    empty text has none. Repeated rows stay as they are, and a column already called ``name`` is replaced; others, whatever they are
    called, are passed on. The work on one text grows with its length and its matches.
    """
    indexed = {i for i, r in enumerate(rules) if trigram_query(r.pattern) != ALWAYS}
    found = candidates(docs, rules, text)
    if found.count() <= SENT_KEYS:
        found = F.broadcast(found)
    key, may = texts.fresh(docs, "key"), texts.fresh(docs, "rules")
    rows = docs.withColumn(key, F.xxhash64(_body(text))).join(found.select(F.col("text_key").alias(key), F.col("__rules").alias(may)), key, "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    parts = []
    for i, rule in enumerate(rules):
        due = F.coalesce(F.col(may).bitwiseAND(F.lit(1 << i)) != 0, F.lit(False)) if i in indexed else _worth(_body(text), rule)
        parts.append(F.when(due, _spans(_body(text), rule, i)).otherwise(none))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    named = F.transform(
        F.array_sort(F.concat(*parts)),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(kinds, s["order"]).alias("kind")),
    )
    return rows.withColumn(name, named).select(*(c for c in docs.columns if c != name), name)


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with every stretch covered by spans (by start) replaced by ``mark`` (spans that overlap share one).

    A part of a text is found by counting from its beginning; so the text is cut into pieces of one size first, and each
    stretch between marks is put together from the few pieces it lies in.
    """

    def part(pieces: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / PIECE).cast("int")
        held = F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(held, ""), start - first * PIECE + 1, end - start)

    ends = F.transform(spans, lambda s: s["end"])
    starts = F.transform(spans, lambda s: s["start"])
    reached = _running(ends, lambda a, b: F.greatest(a, b))
    marked = F.filter(F.arrays_zip(starts.alias("start"), reached.alias("reached")), lambda s: s["start"] >= s["reached"])

    def shown(pieces: Column) -> Column:
        told = F.transform(marked, lambda s: F.concat(part(pieces, s["reached"], s["start"]), F.lit(mark)))
        return F.concat(F.array_join(told, ""), part(pieces, F.array_max(ends), F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(pieces, shown)).otherwise(text)
