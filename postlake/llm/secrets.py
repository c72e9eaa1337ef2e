"""Secret scans with one deterministic automaton for all rules.

The rules' regular expressions are turned into non-deterministic automata, made
deterministic by subset construction, minimised and multiplied into one; the result is an array
of transitions over classes of bytes. A batch of texts is scanned in one pass over its bytes: the
stretches between bytes that no rule holds are the lanes of a vectorised walk, as no
match crosses them. Where the walk accepts, a walk from the right marks where each rule's
matches begin, and one from there to the right finds where they end and whether they count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from postlake.llm.common import ids, texts


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are leftmost, longest and don't overlap; those count that ``counts`` matches too.

    ``counts`` is ``pattern`` with its least length, or the same. Base rules come first, in the order in which their
    kinds are listed. ``sure`` is what the automaton for all rules looks for, ``counts`` if empty: it occurs wherever
    a match counts, with lengths cut that would only double the automaton's states.
    """

    kind: str
    pattern: str
    counts: str = ""
    sure: str = ""
    base: bool = False


VALUE = "[A-Za-z0-9+/_.=-]"
NAME = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = NAME + r"""["']?\x20*[:=]\x20*["']?""" + VALUE

RULES = (
    Rule("assign", ASSIGN + "+", ASSIGN + "{12,}", base=True),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{16,}", base=True),
    Rule("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", sure="-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}", sure="eyJ[A-Za-z0-9_-]+[.]eyJ"),
    Rule("prefixed", "gh[pousr]_[A-Za-z0-9]{36,}", sure="gh[pousr]_[A-Za-z0-9]{4}"),
)


def parsed(pattern: str) -> tuple:
    """A pattern of ASCII literals, classes, groups, alternatives and counts, as nested tuples."""
    at = 0

    def char() -> str:
        nonlocal at
        if pattern[at] != "\\":
            at += 1
            return pattern[at - 1]
        if pattern[at + 1] == "x":
            at += 4
            return chr(int(pattern[at - 2 : at], 16))
        at += 2
        return pattern[at - 1]

    def one() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = either()
            at += 1
            return inner
        if pattern[at] in ".^$*+?{":
            raise ValueError(f"{pattern[at]} has no place in a rule")
        chars = set()
        if pattern[at] == "[":
            at += 1
            while pattern[at] != "]":
                low = high = char()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = char()
                chars |= set(range(ord(low), ord(high) + 1))
            at += 1
        else:
            chars = {ord(char())}
        if max(chars) > 127:
            raise ValueError("rules are of ASCII characters")
        return "set", frozenset(chars)

    def counted() -> tuple:
        nonlocal at
        item = one()
        if at < len(pattern) and pattern[at] in "?*+":
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[at]]
            at += 1
        elif at < len(pattern) and pattern[at] == "{":
            low, comma, high = pattern[at + 1 : pattern.index("}", at)].partition(",")
            least, most = int(low), int(high) if high else None if comma else int(low)
            at = pattern.index("}", at) + 1
        else:
            return item
        return "repeat", item, least, most

    def either() -> tuple:
        nonlocal at
        branches = [[]]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                at += 1
                branches.append([])
            else:
                branches[-1].append(counted())
        return "either", tuple(("row", tuple(b)) for b in branches)

    return either()


def _chars(tree: tuple) -> frozenset[int]:
    """All characters that a pattern names."""
    if tree[0] == "set":
        return tree[1]
    parts = [tree[1]] if tree[0] == "repeat" else tree[1]
    return frozenset().union(*map(_chars, parts))


class _Nfa:
    """Thompson construction over bytes; ``backward`` reads patterns from the right."""

    def __init__(self, backward: bool = False):
        self.backward = backward
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, at: int, tree: tuple) -> int:
        """The state in which the pattern ends that begins in state ``at``."""
        if tree[0] == "set":
            to, end = self.state(), self.state()
            self.moves[at] = (tree[1], to)
            self.empty[to].append(end)
            return end
        if tree[0] == "row":
            for item in reversed(tree[1]) if self.backward else tree[1]:
                at = self.add(at, item)
            return at
        end = self.state()
        if tree[0] == "either":
            for branch in tree[1]:
                first = self.state()
                self.empty[at].append(first)
                self.empty[self.add(first, branch)].append(end)
            return end
        _, body, least, most = tree
        for _ in range(least):
            at = self.add(at, body)
        if most is None:
            loop, first = self.state(), self.state()
            self.empty[at].append(loop)
            self.empty[loop] += [end, first]
            self.empty[self.add(first, body)].append(loop)
        else:
            for _ in range(most - least):
                self.empty[at].append(end)
                first = self.state()
                self.empty[at].append(first)
                at = self.add(first, body)
            self.empty[at].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def _subsets(patterns: list[str], anchored: bool = False, backward: bool = False, sticky: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction: transitions by state and byte, and a bit for each pattern that ends in a state.

    State 0 is the start. An anchored automaton has a last state without a way out; others begin anew at each byte.
    A sticky one stays in the state in which a match ends.
    """
    nfa = _Nfa(backward)
    start = nfa.state()
    ends = []
    for p in patterns:
        first = nfa.state()
        nfa.empty[start].append(first)
        ends.append(nfa.add(first, parsed(p)))
    begin = nfa.closure([start])
    again, found, dead = frozenset() if anchored else begin, frozenset([-1]), frozenset()
    names, rows, flags, todo = {begin: 0}, [], [], [begin]

    def number(states: frozenset[int]) -> int:
        if states not in names:
            names[states] = len(names)
            todo.append(states)
        return names[states]

    for here in todo:
        flags.append(1 if here == found else sum((e in here) << k for k, e in enumerate(ends)))
        if here == found:
            rows.append([names[found]] * 256)
            continue
        by_byte: dict[int, set[int]] = {}
        for s in here:
            if nfa.moves[s]:
                for b in nfa.moves[s][0]:
                    by_byte.setdefault(b, set()).add(nfa.moves[s][1])
        row = [number(again if again else dead)] * 256
        known: dict[frozenset[int], int] = {}
        for b, to in by_byte.items():
            raw = frozenset(to)
            if raw not in known:
                full = nfa.closure(raw) | again
                known[raw] = number(found if sticky and any(e in full for e in ends) else full)
            row[b] = known[raw]
        rows.append(row)
    return np.array(rows), np.array(flags)


def _minimal(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moore's partition refinement of states that accept alike; the start stays state 0."""
    _, part = np.unique(accepts, return_inverse=True)
    table, back = np.unique(table, axis=1, return_inverse=True)
    back = back.ravel()
    while True:
        _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    first = np.unique(part, return_index=True)[1]
    order = np.argsort(first != first[part[0]], kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return place[part[table[first[order]]]][:, back], accepts[first[order]]


def _product(a: np.ndarray, flags_a: np.ndarray, b: np.ndarray, flags_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The reachable pairs of states of two automata, run side by side; a pair accepts where either does."""
    # all accepting pairs are one: keep the first automaton's accepting state as their name
    end = int(np.flatnonzero(flags_a)[0])
    either = (flags_a[:, None] | flags_b[None, :]).ravel()
    name = np.where(either, end * len(b), np.arange(len(a) * len(b)))
    known = np.full((len(a), len(b)), -1)
    known[0, 0] = 0
    fresh, pairs, rows = np.array([[0, 0]]), [np.array([[0, 0]])], []
    while len(fresh):
        to = name[a[fresh[:, 0]] * len(b) + b[fresh[:, 1]]]
        both = np.unique(to)
        both = both[known.ravel()[both] < 0]
        known.ravel()[both] = np.arange(len(both)) + known.max() + 1
        rows.append(to)
        fresh = np.column_stack([both // len(b), both % len(b)])
        pairs.append(fresh)
    table = known.ravel()[np.concatenate(rows)]
    at = np.concatenate(pairs)
    return table, either[at[:, 0] * len(b) + at[:, 1]]


@dataclass(frozen=True)
class Automaton:
    """``next[state + byte_class[byte]]`` is the next state, states being multiples of ``classes``.

    In state ``found`` some rule has matched since the stretch began. ``breaks``: the bytes that no rule holds.
    ``shortest``: the length of the shortest match. ``starts`` and ``ends`` have for each rule
    transitions by state and byte, and the states' flags.
    """

    next: np.ndarray
    found: int
    byte_class: np.ndarray
    classes: int
    breaks: np.ndarray
    shortest: int
    starts: tuple
    ends: tuple


def _shortest(tree: tuple) -> int:
    if tree[0] == "set":
        return 1
    if tree[0] == "row":
        return sum(map(_shortest, tree[1]))
    return min(map(_shortest, tree[1])) if tree[0] == "either" else tree[2] * _shortest(tree[1])


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> Automaton:
    """The minimal automaton that tells, after each stretch, whether any rule's ``sure`` occurs in it, and those that place matches.

    It stays in its accepting state until the stretch ends, so that the rules'
    product holds no record of which of them have matched.
    """
    sure = [r.sure or r.counts or r.pattern for r in rules]
    table, accepts = _minimal(*_subsets([sure[0]], sticky=True))
    for p in sure[1:]:
        more, flags = _minimal(*_subsets([p], sticky=True))
        table, accepts = _minimal(*_product(table, accepts == 1, more, flags == 1))
    columns, byte_class = np.unique(table, axis=1, return_inverse=True)
    classes = columns.shape[1]
    if columns.size > np.iinfo(np.int32).max:
        raise ValueError("the rules make too large an automaton")
    held = frozenset().union(*[_chars(parsed(x)) for r in rules for x in (r.pattern, r.counts, r.sure)])
    return Automaton(
        (columns * classes).astype(np.int32).ravel(), int(np.flatnonzero(accepts)[0]) * classes, byte_class.ravel().astype(np.uint8), classes,
        np.array([b not in held for b in range(256)]), min(_shortest(parsed(p)) for p in sure),
        tuple(_listed(_minimal(*_subsets([r.pattern], backward=True))) for r in rules),
        tuple(_listed(_minimal(*_subsets([r.pattern, r.counts or r.pattern], anchored=True))) for r in rules),
    )


def _listed(pair: tuple[np.ndarray, np.ndarray]) -> tuple[list, list, int]:
    """Rows of transitions, flags and the state without a way out (-1 if there is none), for a walk of single bytes."""
    table, flags = pair
    stuck = np.flatnonzero((table == np.arange(len(table))[:, None]).all(axis=1) & (flags == 0))
    return table.tolist(), flags.tolist(), int(stuck[0]) if len(stuck) else -1


#: Bytes that one walk takes at most, and lanes under which the rest is walked one by one.
WALK_BYTES, FEW_LANES = 8 << 20, 24


def scan(automaton: Automaton, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of the stretches in which any rule occurs: one pass over the bytes."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < WALK_BYTES):
            size += len(texts[upto]) + 1
            upto += 1
        for k, a, b in _walk(automaton, texts[at:upto]):
            yield at + k, a, b
        at = upto


def _walk(m: Automaton, texts: list[bytes]) -> list[tuple[int, int, int]]:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(m.breaks[raw])
    starts = np.concatenate([[0], ends[:-1] + 1])
    enough = ends - starts >= m.shortest
    starts, ends = starts[enough], ends[enough]
    data = m.byte_class[raw]
    order = np.argsort(starts - ends, kind="stable")  # longest first
    pos, left = starts[order], (ends - starts)[order]
    state = np.zeros(len(order), np.int32)
    live, step = len(order), 0
    while live >= FEW_LANES:
        # all live lanes have at least this many bytes more
        for _ in range(int(left[live - 1]) - step):
            state[:live] = m.next[state[:live] + data[pos[:live] + step]]
            step += 1
        live = int(np.count_nonzero(left > step))
    table = m.next
    for lane in range(live):
        s = int(state[lane])
        for c in data[pos[lane] + step : pos[lane] + left[lane]].tolist():
            s = table[s + c]
        state[lane] = s
    hit = order[state == m.found]
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    owner = np.searchsorted(firsts, starts[hit], side="right") - 1
    return sorted(zip(owner.tolist(), (starts[hit] - firsts[owner]).tolist(), (ends[hit] - firsts[owner]).tolist(), strict=True))


def placed(m: Automaton, part: bytes) -> Iterator[tuple[int, int, int]]:
    """(start, rule, end) of the matches in a stretch that count; each rule reads it twice at most."""
    for rule, ((back, begins, _), (ahead, flags, stuck)) in enumerate(zip(m.starts, m.ends, strict=True)):
        state, found = 0, []
        for at in range(len(part) - 1, -1, -1):
            state = back[state][part[at]]
            if begins[state]:
                found.append(at)
        free = 0
        for start in reversed(found):
            if start < free:
                continue
            state, counts = 0, False
            for at in range(start, len(part)):
                state = ahead[state][part[at]]
                if state == stuck:
                    break
                if flags[state] & 1:
                    free, counts = at + 1, flags[state] > 1
            if counts:
                yield start, rule, free


def spans(m: Automaton, text: bytes, parts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, rule, end) of all spans in stretches of a text, in code points and by start, then rule."""
    found = [(a + s, k, a + e) for a, b in parts for s, k, e in placed(m, text[a:b])]
    if found and not text.isascii():
        before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        found = [(int(before[s]), k, int(before[e])) for s, k, e in found]
    return sorted(found)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count per base rule, base_sha256 and all spans of every whole text.

    Null texts count as empty, and a text without secrets has no spans and the digest of
    nothing. Every row gives one, repeated ones too; an empty table gives none. Null ids stay null.
    Columns besides doc_id and text are not read.
    """
    automaton = compiled(tuple(rules))
    base = [k for k, r in enumerate(rules) if r.base]
    counts = [f"n_{rules[k].kind}" for k in base]
    schema = "doc_id long, " + "".join(f"{c} long, " for c in counts) + "base_sha256 string, spans string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = [x.encode() for x in batch["text"]]
            parts: dict[int, list[tuple[int, int]]] = {}
            for k, a, b in scan(automaton, whole):
                parts.setdefault(k, []).append((a, b))
            rows = []
            for at, text in enumerate(whole):
                found = spans(automaton, text, parts[at]) if at in parts else []
                listed = [(k, f"{rules[k].kind}:{a}:{b}") for a, k, b in found]
                own = ",".join(x for k, x in listed if rules[k].base)
                rows.append(
                    [sum(k == b for _, k, _ in found) for b in base]
                    + [hashlib.sha256(own.encode()).hexdigest(), ",".join(x for _, x in listed)]
                )
            out = pd.DataFrame(rows, columns=[*counts, "base_sha256", "spans"])
            out.insert(0, "doc_id", ids(batch).array)
            yield out

    return texts(docs).mapInPandas(run, schema)
