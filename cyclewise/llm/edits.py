"""The cheapest edits that make a row of turns a conversation, by dynamic programming over persistent edit strings.

Edits are letters: K keeps a turn, R gives it the other role, D deletes it, I inserts an empty turn. Four states say what the turns
kept so far end in; for each of them only the cheapest edits are held, and of equally cheap ones the ASCII-least. The edits of
all states are linked nodes: they share their prefixes, and each node knows its ancestors at distances of powers of two and
a rolling hash of all letters up to it. Equally cheap edits are compared at the end of their longest common prefix, which
is found by halving over the hashes; that the prefix is equal is then verified letter by letter back to the shared node.

(Of two equally cheap edit strings of the same turns none begins with the other: the longer one would have insertions
more and so cost more. So what is least stays least whatever follows, and keeping one string for each state is enough.)
"""

from __future__ import annotations

KEEP, RENAME, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
MODULUS, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51

# States: nothing yet, after a leading system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
# Which role's turn an edit or an insertion can add to each state, as the state that it leads to.
NEXT = (USER, USER, ASSISTANT, USER)
ENDS = (START, ASSISTANT)
#: What a row's state may be: the letter of its role, "o" for any other; and whether it must go or was cut short.
GONE, SHORT, WHOLE = "x", "t", "."


class Edits:
    """A string of edits that shares its beginning with others."""

    __slots__ = ("digest", "length", "piece", "up")

    def __init__(self, parent: Edits | None, piece: str):
        self.piece = piece
        if parent is None:
            self.up, self.length, self.digest = (), 0, 0
            return
        self.length = parent.length + len(piece)
        self.digest = extended(parent.digest, piece)
        up, k = [parent], 0
        while len(up[k].up) > k:  # the ancestor at twice the distance
            up.append(up[k].up[k])
            k += 1
        self.up = up

    def holder(self, n: int) -> Edits:
        """The node whose piece has the ``n``-th letter, counted from 1."""
        node = self
        while node.up[0].length >= n:
            for ancestor in reversed(node.up):
                if ancestor.length >= n:
                    node = ancestor
                    break
        return node

    def prefix_digest(self, n: int) -> int:
        if n == 0:
            return 0
        node = self.holder(n)
        return node.digest if node.length == n else extended(node.up[0].digest, node.piece[: n - node.up[0].length])

    def letter(self, n: int) -> str:
        """The letter behind the first ``n``."""
        node = self.holder(n + 1)
        return node.piece[n - node.up[0].length]

    def pieces(self) -> list[str]:
        out, node = [], self
        while node.up:
            out.append(node.piece)
            node = node.up[0]
        return out[::-1]


def extended(digest: int, piece: str) -> int:
    for letter in piece:
        digest = (digest * BASE + ord(letter)) % MODULUS
    return digest


def parted(a: Edits, b: Edits) -> tuple[int, str, str]:
    """Length of the part that both share as nodes, and what each has beyond it."""
    left, right = [], []
    while a is not b:
        if a.length >= b.length and a.up:
            left.append(a.piece)
            a = a.up[0]
        else:
            right.append(b.piece)
            b = b.up[0]
    return a.length, "".join(reversed(left)), "".join(reversed(right))


def common_prefix(a: Edits, b: Edits) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(a.length, b.length)
    while low < high:
        middle = (low + high + 1) // 2
        if a.prefix_digest(middle) == b.prefix_digest(middle):
            low = middle
        else:
            high = middle - 1
    shared, left, right = parted(a, b)
    if left[: max(0, low - shared)] != right[: max(0, low - shared)]:  # two prefixes with the same hash
        low = shared + next(i for i, (x, y) in enumerate(zip(left, right)) if x != y)
    return low


def before(a: Edits, b: Edits) -> bool:
    """Whether ``a`` comes before ``b`` in ASCII order."""
    if a is b:
        return False
    n = common_prefix(a, b)
    if n == min(a.length, b.length):
        return a.length < b.length
    return a.letter(n) < b.letter(n)


Held = list  # by state: (cost, Edits), or None where the state can't be reached


def offer(held: Held, state: int, cost: int, parent: Edits, piece: str) -> None:
    """Hold these edits if they are cheaper than the state's so far, or as cheap and before them."""
    known = held[state]
    if known is None or cost < known[0]:
        held[state] = (cost, Edits(parent, piece))
    elif cost == known[0]:
        edits = Edits(parent, piece)
        if before(edits, known[1]):
            held[state] = (cost, edits)


def with_insertions(held: Held) -> Held:
    """Turns inserted at this place; a user's first, as an assistant's may follow it."""
    old = list(held)
    for state in (START, SYSTEM, ASSISTANT, USER):
        source = held[USER] if state == USER else old[state]
        if source is not None:
            offer(held, NEXT[state], source[0] + INSERT, source[1], "I")
    return held


def begin(state: int, first: bool) -> Held:
    held = [None] * STATES
    held[state] = (0, Edits(None, ""))
    return with_insertions(held) if first else held


def after_row(held: Held, initial: str, fault: str) -> Held:
    """One more row, of this initial (s, u, a or o) and fault (``GONE``, ``SHORT`` or ``WHOLE``)."""
    out: Held = [None] * STATES
    for state, known in enumerate(held):
        if known is None:
            continue
        cost, edits = known
        offer(out, state, cost + DELETE, edits, "D")
        if fault != GONE:
            cost += CUT_SHORT * (fault == SHORT)
            if (to := kept_to(state, initial)) is not None:
                offer(out, to, cost + KEEP, edits, "K")
            offer(out, NEXT[state], cost + RENAME, edits, "R")
    return with_insertions(out)


def kept_to(state: int, initial: str) -> int | None:
    """The state after a turn that keeps its role, or None where it can't follow."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if "ua"[NEXT[state] - USER] == initial else None


def through(initials: str, faults: str, first: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) of the cheapest edits of a block of rows.

    The ``first`` block of a conversation begins in one state, and turns may be inserted before it.
    """
    out = []
    for state in (START,) if first else range(STATES):
        held = begin(state, first)
        for initial, fault in zip(initials, faults):
            held = after_row(held, initial, fault)
        out += [(state, to, x[0], "".join(x[1].pieces())) for to, x in enumerate(held) if x is not None]
    return out


def after_block(held: Held, ways: list[tuple[int, int, int, str]]) -> Held:
    """As ``after_row``, for a whole block by what ``through`` says of it."""
    out: Held = [None] * STATES
    for state, to, cost, edits in ways:
        if (known := held[state]) is not None:
            offer(out, to, known[0] + cost, known[1], edits)
    return out


def best(held: Held) -> tuple[int, Edits]:
    """The cheapest edits that end in a whole conversation."""
    ended: Held = [None]
    for state in ENDS:
        if (known := held[state]) is not None and (ended[0] is None or known[0] < ended[0][0] or known[0] == ended[0][0] and before(known[1], ended[0][1])):
            ended[0] = known
    return ended[0]


def by_row(state: int, edits: str, initials: str) -> tuple[int, list[str]]:
    """The state after a block's edits, and for each row what becomes of it.

    K and D stand for themselves, u and a for a new role, U and A for a turn inserted after the row (in a conversation's first
    block also before its first row).
    """
    out, early = [], ""
    for edit in edits:
        if edit == "I":
            state = NEXT[state]
            letter = "UA"[state - USER]
            if out:
                out[-1] += letter
            else:
                early += letter
            continue
        letter = edit
        if edit == "K":
            state = kept_to(state, initials[len(out)])
        elif edit == "R":
            state = NEXT[state]
            letter = "ua"[state - USER]
        out.append(early + letter)
        early = ""
    return state, out
