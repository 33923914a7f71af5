"""Secret scanning with one deterministic automaton for all rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factorlake.llm.scratch import bounded_batches

#: The base rules. `find` is searched leftmost, non-overlapping; a match stays if
#: group `of` has at least `least` characters. In listed order.
BASE = [
    {"kind": "assign", "find": r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "of": 2, "least": 12},
    {"kind": "access", "find": r"AKIA[A-Z0-9]+", "of": 0, "least": 18},
    {"kind": "hex", "find": r"[0-9a-f]+", "of": 0, "least": 16},
]
#: Further rules, by public formats of tokens and keys.
MORE = [
    {"kind": "github", "find": r"gh[pousr]_[A-Za-z0-9]+", "of": 0, "least": 40},
    {"kind": "slack", "find": r"xox[abprs]-[A-Za-z0-9-]+", "of": 0, "least": 20},
    {"kind": "jwt", "find": r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "of": 0, "least": 30},
    {"kind": "pem", "find": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "of": 0, "least": 1},
]
RULES = BASE + MORE


class _Nfa:
    """Thompson construction from the parse tree of Python's own regex parser, over bytes."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def chars(self, at: int, chars: Iterable[int], fold: bool) -> int:
        wanted = set(chars)
        if fold:
            wanted |= {ord(f(chr(c))) for c in wanted for f in (str.lower, str.upper) if c < 128}
        end = self.state()
        self.moves[at].append((frozenset(wanted), end))
        return end

    def add(self, at: int, tree: Iterable, fold: bool = False) -> int:
        for op, arg in tree:
            if op is C.LITERAL:
                at = self.chars(at, [arg], fold)
            elif op is C.IN:
                at = self.chars(at, [c for kind, v in arg for c in (range(v[0], v[1] + 1) if kind is C.RANGE else [v])], fold)
            elif op is C.SUBPATTERN:
                at = self.add(at, arg[3], fold or bool(arg[1] & re.IGNORECASE))
            elif op is C.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    first = self.state()
                    self.empty[at].append(first)
                    self.empty[self.add(first, branch, fold)].append(end)
                at = end
            elif op is C.MAX_REPEAT:
                low, high, body = arg
                for _ in range(low):
                    at = self.add(at, body, fold)
                if high is C.MAXREPEAT:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(loop, body, fold)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.empty[at].append(end)
                        at = self.add(at, body, fold)
                    self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"rules may not use {op}")
        return at


class Automaton:
    """moves[state * 256 + byte] is the next state; accepts[state] has the bits of the rules that match there."""

    def __init__(self, moves: np.ndarray, accepts: np.ndarray, start: int) -> None:
        self.moves, self.accepts, self.start = moves, accepts, start
        states = moves.reshape(-1, 256)
        #: Bytes after which the automaton is at its start, wherever it was: no match holds one.
        self.resets = np.array([bool((states[:, b] == start).all()) for b in range(256)])
        #: Whether a state accepts, a byte each.
        self.some = (accepts != 0).astype(np.uint8).tobytes()

    def run(self, data: bytes, state: int) -> int:
        """The bits of all rules that match somewhere in `data`, read from `state` on."""
        moves, some, bits = memoryview(self.moves), self.some, 0
        for c in data:
            state = moves[state * 256 + c]
            if some[state]:
                bits |= int(self.accepts[state])
        return bits

    def ends(self, data: bytes, at: int = 0) -> list[int]:
        """The places after `at` where a match ends, in ascending order; reading stops in a state that nothing leaves."""
        moves, some, state, dead, out = memoryview(self.moves), self.some, self.start, self.dead, []
        for place in range(at, len(data)):
            state = moves[state * 256 + data[place]]
            if some[state]:
                out.append(place + 1)
            elif state == dead:
                break
        return out

    @cached_property
    def dead(self) -> int:
        """The state that no byte leaves and that accepts nothing, or -1."""
        own = (self.moves.reshape(-1, 256) == np.arange(len(self.accepts))[:, None]).all(axis=1) & (self.accepts == 0)
        return int(np.flatnonzero(own)[0]) if own.any() else -1


Tree = list  # of (operation, argument), as Python's parser of regular expressions gives it


def backwards(tree: Iterable) -> Tree:
    """The tree of the same words read from their ends."""

    def turned(op, arg):  # noqa: ANN001, ANN202
        if op is C.SUBPATTERN:
            return op, (*arg[:3], backwards(arg[3]))
        if op is C.BRANCH:
            return op, (arg[0], [backwards(b) for b in arg[1]])
        return (op, (*arg[:2], backwards(arg[2]))) if op is C.MAX_REPEAT else (op, arg)

    return [turned(*x) for x in reversed(list(tree))]


@lru_cache(maxsize=4)
def compiled(patterns: tuple[str, ...]) -> Automaton:
    """One minimal automaton that finds an occurrence of any of the patterns anywhere."""
    return determinised([list(_parser.parse(p)) for p in patterns], anywhere=True)


def determinised(trees: list[Tree], anywhere: bool) -> Automaton:
    """A minimal automaton by subset construction; a match begins at any byte, or at the first one only."""
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for bit, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[root].append(first)
        ends[nfa.add(first, tree)] = 1 << bit

    def closed(states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += nfa.empty[s]
        return frozenset(seen)

    # bytes that no rule tells apart are one letter of the alphabet
    wanted_sets = [wanted for moves in nfa.moves for wanted, _ in moves]
    kinds: dict[tuple, int] = {}
    letter = np.array([kinds.setdefault(tuple(c in w for w in wanted_sets), len(kinds)) for c in range(256)])
    examples = [int(np.flatnonzero(letter == k)[0]) for k in range(len(kinds))]
    letters_of = {w: [k for k, c in enumerate(examples) if c in w] for w in set(wanted_sets)}

    start = closed([root])
    number, order, rows = {start: 0}, [start], []
    follow: dict[frozenset[int], frozenset[int]] = {}
    for here in order:
        row: list[set[int]] = [set() for _ in examples]
        for s in here:
            for wanted, end in nfa.moves[s]:
                for k in letters_of[wanted]:
                    row[k].add(end)
        line = []
        for targets in map(frozenset, row):
            if targets not in follow:
                follow[targets] = closed(targets) | start if anywhere else closed(targets)
            there = follow[targets]
            if there not in number:
                number[there] = len(order)
                order.append(there)
            line.append(number[there])
        rows.append(line)
    table = np.array(rows, dtype=np.int64)
    accepts = np.array([sum(bit for s, bit in ends.items() if s in here) for here in order], dtype=np.int64)
    # Moore's minimisation: split classes until their members move alike
    kind = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([kind, kind[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == kind.max():
            break
        kind = finer
    firsts = np.array([int(np.flatnonzero(kind == k)[0]) for k in range(kind.max() + 1)])
    return Automaton(kind[table[firsts]][:, letter].reshape(-1).astype(np.int32), accepts[firsts], int(kind[0]))


def trigger(rule: dict) -> str:
    """The pattern that the automaton looks for: the rule's own, with its least length where the rule is one bare run.

    Runs after a fixed beginning keep their `+`: counters of several rules that advance together
    would multiply the states, and the beginnings are rare. The least lengths are checked on the match.
    """
    if len(list(_parser.parse(rule["find"]))) == 1 and rule["find"].endswith("+"):
        return rule["find"][:-1] + "{%d,}" % rule["least"]
    return rule["find"]


#: Segments that advance together at least; when fewer are left, each is read to its end by itself.
TOGETHER = 64


def hot_segments(buffer: np.ndarray, automaton: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rule bits of the segments between reset bytes in which some rule matches.

    All segments advance together, longest first: step t feeds byte t of every segment that has
    one through the transition array. Each byte is read once, whatever the number of rules. The
    few segments that are far longer than the others go on alone, in time linear in their bytes.
    """
    cuts = np.flatnonzero(automaton.resets[buffer])
    starts = np.concatenate([[0], cuts + 1])
    ends = np.concatenate([cuts, [len(buffer)]])
    some = ends > starts
    starts, ends = starts[some], ends[some]
    order = np.argsort(starts - ends, kind="stable")
    starts, ends = starts[order], ends[order]
    lengths = ends - starts
    state = np.full(len(starts), automaton.start, dtype=np.int32)
    bits = np.zeros(len(starts), dtype=np.int64)
    together = int(lengths[TOGETHER - 1]) if len(lengths) >= TOGETHER else 0
    active = len(starts)
    for t in range(together):
        active = int(np.searchsorted(-lengths[:active], -t, side="left"))
        state[:active] = automaton.moves[state[:active] * 256 + buffer[starts[:active] + t]]
        found = automaton.accepts[state[:active]]
        if found.any():
            bits[:active] |= found
    for i in np.flatnonzero(lengths > together):
        bits[i] |= automaton.run(buffer[starts[i] + together : ends[i]].tobytes(), int(state[i]))
    hit = bits > 0
    return starts[hit], ends[hit], bits[hit]


class Finder:
    """Spans of one rule, from automata alone: where matches start, how far each goes, where its group starts.

    A match is the longest from the leftmost start on, which is also what the rules' greedy
    expressions find. The group whose length counts is the rule's last part, or the whole.
    """

    def __init__(self, rule: dict) -> None:
        tree = list(_parser.parse(rule["find"]))
        self.least = rule["least"]
        self.whole = determinised([tree], anywhere=False)
        self.starts = determinised([backwards(tree)], anywhere=True)
        self.before = None
        if rule["of"]:
            if tree[-1][0] is not C.SUBPATTERN or tree[-1][1][0] != rule["of"]:
                raise ValueError(f"group {rule['of']} has to end the rule")
            self.before = determinised([tree[:-1]], anywhere=False)

    def spans(self, data: bytes) -> Iterator[tuple[int, int]]:
        at = 0
        for e in reversed(self.starts.ends(data[::-1])):
            s = len(data) - e
            if s < at:
                continue
            at = self.whole.ends(data, s)[-1]
            first = s
            if self.before:
                first = max(e for e in self.before.ends(data[:at], s) if e < at)
            if at - first >= self.least:
                yield s, at


class Scanner:
    """The automaton of all rules, and those of each."""

    def __init__(self, rules: list[dict]) -> None:
        self.automaton = compiled(tuple(trigger(r) for r in rules))
        self.finders = [Finder(r) for r in rules]


def spans_of(texts: list[str], scanner: Scanner) -> list[list[tuple[int, int, int]]]:
    """Per text (start, rule number, end) in code points, sorted."""
    raw = [t.encode() for t in texts]
    joined = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    # code points before each byte of all texts
    points = np.cumsum((joined & 0xC0) != 0x80, dtype=np.int64) - 1
    firsts = np.cumsum([0] + [len(r) + 1 for r in raw])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts, ends, bits = hot_segments(joined, scanner.automaton)
    owners = np.searchsorted(firsts, starts, side="right") - 1
    shifts = points[starts] - points[firsts[owners]]
    for s, e, b, i, shift in zip(starts.tolist(), ends.tolist(), bits.tolist(), owners.tolist(), shifts.tolist(), strict=True):
        piece = joined[s:e].tobytes()  # ASCII only: every other byte is a reset
        out[i] += [(shift + f, k, shift + t) for k, finder in enumerate(scanner.finders) if b >> k & 1 for f, t in finder.spans(piece)]
    return [sorted(x) for x in out]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[dict] | None = None) -> DataFrame:
    """The spans of secrets in every whole text: id, spans (array of kind, start, end; code points, end exclusive).

    One row per row of `docs`, in any order; null and empty texts have no spans; repeated rows
    are scanned alike; null ids pass through; other columns are not carried. A byte that no
    rule can hold cuts a text into segments: texts of any length are scanned in pieces, and
    no match is cut.
    """
    rules = RULES if rules is None else rules
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [r["kind"] for r in rules]
    # compiled once, here; tables of 256 numbers a state, which the rules fix
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = spans_of([t or "" for t in b.column(1).to_pylist()], shared.value)
            spans = [[{"kind": names[k], "start": s, "end": e} for s, k, e in x] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(span))], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind string, start bigint, end bigint>>")
