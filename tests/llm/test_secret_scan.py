"""Secrets against Python's re, and trigram queries that hold for every match."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cyclewise.llm import secret_scan
from cyclewise.llm.secret_scan import RULES, Rule

HEX, KEY = "0123456789abcdef" * 2, "AKIA" + "Z9" * 9
TEXTS = [
    None, "", "password=hunter22", "PassWord : 'hunter22'", "passwd=abc", "password=token: abcdef123", "token=secret=abcdefg", "api_key = " + KEY,
    f"é🙂 {HEX} {KEY}", HEX + HEX, HEX[:23], "AKIA", "AKIAAKIA" + "0" * 12, "tokentoken=aaaaaa token=bbbbbb", 'secret"="abcdef"', "ſecret=abcdefg toKen=abcdefg",
    "ghp_" + "a" * 36 + " xoxb-1234567890", "-----BEGIN RSA PRIVATE KEY-----\n" + HEX, "eyJabcdefghij.eyJabcdefghijklmnopq.sigsigsigsig", "apikey:=x", f"token={HEX}",
    "password  =  abcdef\npassword\n=abcdef", f"{HEX}\n" * 40, "clean text " * 3000, f"token={HEX}", "secret='ab\"cdefgh'",
]


def brute(text, rules=RULES):
    found = []
    for n, rule in enumerate(rules):
        for m in re.finditer(rule.pattern.replace("(?i:", "(?ai:"), text or ""):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), n, m.end()))
    return ",".join(f"{rules[n].kind}:{a}:{b}" for a, n, b in sorted(found))


def test_scan(spark, frame):
    docs = frame(list(enumerate(TEXTS)))
    found = secret_scan.scan(docs, name="found")
    assert found.columns == [*docs.columns, "found"]
    rows = found.select("doc_id", secret_scan.written(found.found)).collect()
    assert dict(map(tuple, rows)) == {i: brute(t) for i, t in enumerate(TEXTS)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert secret_scan.scan(frame([])).collect() == []
    assert "spans" in secret_scan.scan(docs).columns  # replaced


def test_joined_instead_of_sent(spark, frame, monkeypatch):
    monkeypatch.setattr(secret_scan, "SENT_KEYS", -1)
    found = secret_scan.scan(frame(list(enumerate(TEXTS))), name="found")
    rows = found.select("doc_id", secret_scan.written(found.found)).collect()
    assert dict(map(tuple, rows)) == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_redacted(spark, frame):
    found = secret_scan.scan(frame(list(enumerate(TEXTS))), name="found")
    rows = dict(map(tuple, found.select("doc_id", secret_scan.redacted(found.text, found.found)).collect()))
    for i, text in enumerate(TEXTS):
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute(text).split(",") if s]
        covered = {c for a, b in spans for c in range(a, b)}
        starts = {a for a, _ in spans if a - 1 not in covered} | {a for a, b in spans if all(a >= d or c >= a for c, d in spans)}
        want = "".join((secret_scan.MARK if c in starts else "") + ("" if c in covered else x) for c, x in enumerate(text or ""))
        assert rows[i] == (None if text is None else want)


def seconds(spark, text, shown=True):
    """Of a scan (and the redacting) of one text, the quickest of three."""
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    docs.count()
    spent = []
    for _ in range(3):
        start = time.perf_counter()
        found = secret_scan.scan(docs, name="found")
        found.select(F.size("found"), F.length(secret_scan.redacted(found.text, found.found)) if shown else F.lit(0)).collect()
        spent.append(time.perf_counter() - start)
    docs.unpersist()
    return min(spent)


def test_one_key_in_a_long_text(spark):
    """A million characters of prose take at most twice the time with a key in them; the first run warms up."""
    prose = "and the hand of a bold decade faced each cafe bad deed; " * 18_000
    assert len(prose) > 1_000_000
    seconds(spark, prose[:50_000] + HEX)
    plain, keyed = seconds(spark, prose), seconds(spark, prose[:500_000] + " " + HEX + " " + prose[500_000:])
    assert keyed <= 2 * plain + 1


def test_many_secrets_in_a_text(spark):
    """Ten times the secrets in a text of one length take no more than a few times as long."""
    one = "token=abcdef123 and then " + "some words " * 2
    few, many = one * 20 + "x " * (len(one) * 19_000 // 2), one * 20_000
    seconds(spark, few)
    assert seconds(spark, many) <= 6 * seconds(spark, few) + 2


@pytest.mark.parametrize("block, piece", [(1, 1), (2, 3), (3, 50)])
def test_blocks_and_pieces(spark, frame, monkeypatch, block, piece):
    """The same spans and the same redacted texts however the work on a text is cut."""
    docs = frame([(i, None if t is None else t * 3) for i, t in enumerate(TEXTS[:-3]) if len(t or "") < 2000])
    told = lambda: sorted((r.doc_id, r.spans, r.shown or "") for r in secret_scan.scan(docs, name="found").select("doc_id", secret_scan.written(F.col("found")).alias("spans"), secret_scan.redacted(F.col("text"), F.col("found")).alias("shown")).collect())  # noqa: E731, E501
    want = told()
    monkeypatch.setattr(secret_scan, "BLOCK", block)
    monkeypatch.setattr(secret_scan, "PIECE", piece)
    assert told() == want


def test_repeated_ids_and_secrets_in_long_texts(spark, frame):
    long = ("é🙂 words of prose, " * 5000) + HEX + (" more 🙂 words. " * 3000) + f"token={HEX} " + "w " * 20_000 + KEY
    pairs = [(1, f"token={HEX}"), (1, f"token={HEX}"), (1, "none"), (None, KEY), (None, None), (2, long)]
    found = secret_scan.scan(frame(pairs), name="found")
    got = [(r.doc_id, r.spans) for r in found.select("doc_id", secret_scan.written(found.found).alias("spans")).collect()]
    assert sorted(got, key=str) == sorted(((i, brute(t)) for i, t in pairs), key=str)
    shown = found.where("doc_id = 2").select(secret_scan.redacted(found.text, found.found)).first()[0]
    assert shown == long.replace(f"token={HEX}", secret_scan.MARK).replace(HEX, secret_scan.MARK).replace(KEY, secret_scan.MARK)


@pytest.mark.parametrize("rule, told", [(RULES[0], None), (RULES[1], "AKIA[A-Z0-9]{16,}"), (RULES[2], "[0-9a-f]{24,}"), (RULES[3], None), (Rule("a", "ab[a-z]+", 1), "ab[a-z]{1,}")])
def test_least_length_in_the_pattern(rule, told):
    assert secret_scan.searched(rule) == (told or rule.pattern)


def fulfils(query, text):
    if isinstance(query, str):
        return query in text
    return (all if query[0] == "and" else any)(fulfils(p, text) for p in query[1])


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.kind)
@settings(max_examples=150, deadline=None)
@given(data=st.data())
def test_every_match_fulfils_the_query(rule, data):
    text = data.draw(st.from_regex(rule.pattern.replace("(?i:", "(?ai:")))
    assert fulfils(secret_scan.trigram_query(rule.pattern), text.lower())


@pytest.mark.parametrize(
    ("pattern", "query"),
    [
        ("abcd", ("and", ("abc", "bcd"))),
        ("ab", secret_scan.ALWAYS),
        ("[0-9]+", secret_scan.ALWAYS),
        ("abc|abcd", "abc"),
        ("abc|xyz", ("or", ("abc", "xyz"))),
        ("(?:abc)*", secret_scan.ALWAYS),
        ("(?:abc)+", "abc"),
        ("ab[cd]e", ("or", (("and", ("abc", "bce")), ("and", ("abd", "bde"))))),
        ("abc.*xyz", ("and", ("abc", "xyz"))),
        ("colou?r", ("or", (("and", ("col", "olo", "lou", "our")), ("and", ("col", "olo", "lor"))))),
    ],
)
def test_queries(pattern, query):
    def sets(q):
        return q if isinstance(q, str) else (q[0], frozenset(map(sets, q[1])))

    assert sets(secret_scan.trigram_query(pattern)) == sets(query)


def test_rules_without_trigrams(spark, frame):
    rules = (Rule("digits", r"[0-9]+", 3), Rule("pair", r"ab"))
    found = secret_scan.scan(frame([(1, "12 123 ab"), (2, None)]), rules, name="found")
    assert dict(map(tuple, found.select("doc_id", secret_scan.written(found.found)).collect())) == {1: "digits:3:6,pair:7:9", 2: ""}
