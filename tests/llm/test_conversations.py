"""Edits against trying all of them, and whole tables against a version that holds conversations in lists."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cyclewise.llm import conversations, edits, queries

SHAPE = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, fault string, block string, place long, conversation string"


def ways_of(initials, faults, most):
    """All (cost, edits) with up to ``most`` insertions, from which the least is taken."""
    rows = []
    for initial, fault in zip(initials, faults):
        cut = 5 * (fault == "t")
        here = [("D", 2, "")]
        if fault != "x":
            here += [("K", cut, initial), ("R", 1 + cut, "u"), ("R", 1 + cut, "a")]
        rows.append(here)
    gaps = [p for n in range(most + 1) for p in itertools.product("ua", repeat=n)]
    for picks in itertools.product(*rows):
        for fill in itertools.product(gaps, repeat=len(rows) + 1):
            if sum(map(len, fill)) > most:
                continue
            roles, letters, cost = "", "", 0
            for gap, pick in itertools.zip_longest(fill, picks):
                roles, letters, cost = roles + "".join(gap), letters + "I" * len(gap), cost + 5 * len(gap)
                if pick:
                    roles, letters, cost = roles + pick[2], letters + pick[0], cost + pick[1]
            if SHAPE.fullmatch(roles):
                yield cost, letters


def cheapest(initials, faults, block=None):
    block = block or len(initials)
    held = edits.begin(edits.START, False)
    for i in range(0, len(initials), block):
        held = edits.after_block(held, edits.through(initials[i : i + block], faults[i : i + block], i == 0))
    cost, best = edits.best(held)
    return cost, "".join(best.pieces())


rows_of = lambda most: st.lists(st.tuples(st.sampled_from("suao"), st.sampled_from("xt..")), min_size=1, max_size=most)


@settings(max_examples=100, deadline=None)
@given(rows_of(3))
def test_least_of_all_edits(rows):
    initials, faults = "".join(i for i, _ in rows), "".join(f for _, f in rows)
    assert cheapest(initials, faults) == min(ways_of(initials, faults, 2))


def backwards(initials, faults):
    """Costs from the end, then the least letter at each step that stays as cheap: another way to the same edits."""
    n, far = len(initials), 1 << 30
    options = lambda i, q: [("D", 2, 1, q)] + ([] if faults[i] == "x" else [
        *([("K", 5 * (faults[i] == "t"), 1, edits.kept_to(q, initials[i]))] if edits.kept_to(q, initials[i]) is not None else []),
        ("R", 1 + 5 * (faults[i] == "t"), 1, edits.NEXT[q])])
    cost = [[far] * 4 for _ in range(n + 1)]
    cost[n] = [0, 10, 5, 0]
    for i in range(n - 1, -1, -1):
        cost[i] = [min(c + cost[i + 1][to] for _, c, _, to in options(i, q)) for q in range(4)]
        for _ in range(3):
            cost[i] = [min(cost[i][q], 5 + cost[i][edits.NEXT[q]]) for q in range(4)]
    i, q, out = 0, 0, ""
    while i < n or cost[i][q]:
        steps = [("I", 5, 0, edits.NEXT[q])] + (options(i, q) if i < n else [])
        letter, _, on, to = min(s for s in steps if s[1] + cost[i + s[2]][s[3]] == cost[i][q])
        i, q, out = i + on, to, out + letter
    return cost[0][0], out


@settings(max_examples=150, deadline=None)
@given(rows_of(60), st.integers(1, 9))
def test_longer_rows_and_blocks(rows, block):
    initials, faults = "".join(i for i, _ in rows), "".join(f for _, f in rows)
    want = backwards(initials, faults)
    assert cheapest(initials, faults) == want and cheapest(initials, faults, block) == want


@pytest.mark.parametrize("modulus", [1, 2, 7])
def test_collisions(monkeypatch, modulus):
    """Hashes that collide all the time give the same edits."""
    monkeypatch.setattr(edits, "MODULUS", modulus)
    own = random.Random(modulus)
    for _ in range(60):
        initials, faults = ("".join(own.choice(x) for _ in range(40)) for x in ("suao", "xt.."))
        assert cheapest(initials, faults, own.choice([3, 8, 40])) == backwards(initials, faults)


def test_order_of_edits():
    """Any two strings, built with shared beginnings and in pieces of any size, compare as Python's strings do."""
    own = random.Random(5)
    made = [edits.Edits(None, "")]
    for _ in range(400):
        made.append(edits.Edits(own.choice(made[-20:]), "".join(own.choice("DK") for _ in range(own.randint(1, 3)))))
    text = {n: "".join(n.pieces()) for n in made}
    for _ in range(3000):
        a, b = own.choice(made), own.choice(made)
        assert edits.before(a, b) == (text[a] < text[b])


def brute(turns):
    """Result rows for (conv_id, turn, role, text) rows."""
    groups = {c: [] for c, *_ in turns}
    for conv, turn, role, text in turns:
        told = lambda x: " " if x is None else x
        hit = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        row = ((turn is not None, turn or 0), "user" if hit == 4 else role, text, turn)
        groups[conv] += [row] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0], r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text, _ in rows:
            blank = not re.search(r"[^\x20\x09-\x0D]", text)
            short = not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
            faults.append("b" if blank else "d" if (role, text) in seen else "t" if short else ".")
            seen.add((role, text))
        numbers = [r[3] for r in rows if r[3] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[1][:1] for r in rows]
        plain = "".join(i if i and i in "sua" else "o" for i in initials)
        cost, audit = backwards(plain, "".join("x" if f in "bd" else f for f in faults)) if rows else (0, "")
        lines, state, left = [], 0, list(zip(plain, rows))
        for letter in audit:
            if letter == "I":
                state = edits.NEXT[state]
                lines.append("?user:?assistant:".split("?")[state - 1])
                continue
            initial, (_, role, text, _) = left.pop(0)
            if letter == "K":
                state = edits.kept_to(state, initial)
                lines.append(f"{role}:{text}")
            elif letter == "R":
                state = edits.NEXT[state]
                lines.append(f"{['user', 'assistant'][state - 2]}:{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest))
    return sorted(out, key=str)


def told(spark, turns):
    frame = spark.createDataFrame([(*t, "x", "x", 3, "x") for t in turns], SCHEMA)
    return sorted(map(tuple, conversations.audit(conversations.damaged(frame), frame).collect()), key=str)


EDGES = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 2, "user", "And"), (1, 3, "user", None), (1, None, "system", "Go."),
    (2, 5, None, "x."), (2, 5, "user", "x."), (2, 5, "user", "x."), (2, 9, "", " "), (2, 9, "tool", " \t\n\x0b\x0c\r"),
    (None, None, None, None), (None, 1, "assistant", "Fine.  \n"), (None, 1, "assistant", "Fine.  \n"), (3, 0, "user", ""), (4, -7, "User", "a.\n"),
    (4, 7, "ué", "é?\u0085"), (5, 1, "user", "long words. " * 20000), (5, 2, "assistant", "long words " * 20000), (6, 0, "assistant", "a:b\nc."),
]


def test_odd_turns(spark):
    assert told(spark, EDGES) == brute(EDGES)


def test_no_turns(spark):
    assert told(spark, []) == []
    frame = spark.createDataFrame([(7, 1, "user", "a.", "x", "x", 3, "x")], SCHEMA)
    nothing = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert [tuple(r) for r in conversations.audit(frame.limit(0), frame).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", nothing)]


def test_a_conversation_of_many_blocks(spark, monkeypatch):
    """One conversation has most of the turns and goes through several blocks; the same without damage to compare repaired turns."""
    monkeypatch.setattr(conversations, "BLOCK", 16)
    own = random.Random(6)
    texts = ["One.", "Two!", "Three", "Four?", " "] + [f"Text {i}." for i in range(200)]
    turn = lambda conv, i: (conv, i, own.choice(["user", "assistant", "assistant", "system", "tool"]), own.choice(texts))
    turns = [turn(1, i) for i in range(500)] + [turn(c, i) for c in range(2, 40) for i in range(own.randint(1, 20))]
    assert told(spark, turns) == brute(turns)


def test_repaired_turns(spark):
    turns = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Why?"), (1, 2, "user", "Why?"), (1, 3, "assistant", "So.")]
    rows = conversations.judged(spark.createDataFrame([(*t, "x", "x", 3, "x") for t in turns], SCHEMA))
    fates = conversations.chosen(conversations.blocks(rows))
    got = conversations.repaired(rows, fates).orderBy("place", "part").collect()
    assert [(r.role, r.text) for r in got] == [("user", "Why?"), ("assistant", "So.")]
    assert fates.where("block IS NULL").first().audit == "DKDK"


def test_query(spark, small):
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    assert sorted(map(tuple, queries.queries()["op12_conversation_repair"](spark, small).collect()), key=str) == brute(turns)
