"""Periodic runs of words: all maximal stretches that repeat with a smallest period, and texts without the repeats.

Every run has a Lyndon root: the longest Lyndon word that begins at some place of it, in one of
the two orders of an alphabet. So the longest Lyndon words of all places, in both orders, are all
candidates there are; each is extended to the right and to the left by longest common
extensions, which Ukkonen's suffix trees of the words and of their reversal answer in constant
time, as the lowest common ancestors of two leaves by their Euler tours.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factorlake.llm.pieces import strings
from factorlake.llm.scratch import bounded_batches

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Words that one pair of trees holds, about; a longer stretch has trees of its own.
TREE_WORDS = 1 << 15
#: Places of a block of range minima: blocks have a sparse table, the ends of a range running minima.
BLOCK = 16


class RangeMin:
    """Minima of ranges of an array, each in constant time."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        padded = np.full(-(-len(values) // BLOCK) * BLOCK, np.iinfo(values.dtype).max, dtype=values.dtype)
        padded[: len(values)] = values
        blocks = padded.reshape(-1, BLOCK)
        self.from_start = np.minimum.accumulate(blocks, axis=1).ravel()
        self.to_end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of values[lo] to values[hi], both included, element by element; lo <= hi."""
        first, last = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.to_end[lo], self.from_start[hi])
        inner = np.flatnonzero(last - first > 1)
        if len(inner):
            a, n = first[inner] + 1, last[inner] - first[inner] - 1
            level = np.frexp(n)[1] - 1
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                row, span = self.levels[k], 1 << int(k)
                out[inner[at]] = np.minimum(out[inner[at]], np.minimum(row[a[at]], row[a[at] + n[at] - span]))
        same = np.flatnonzero(first == last)
        if len(same):
            a, b = lo[same], hi[same]
            least = self.values[a]
            for k in range(1, BLOCK):
                least = np.minimum(least, self.values[np.minimum(a + k, b)])
            out[same] = least
        return out


class SuffixTree:
    """Ukkonen's suffix tree of a list of numbers below `sigma` whose last one occurs once."""

    def __init__(self, s: list[int], sigma: int) -> None:
        n = len(s)
        start, end, go = self._grown(s, sigma)
        # children of a node are neighbours in the order of the keys, which are node * sigma + first symbol
        keys = np.fromiter(go.keys(), dtype=np.int64, count=len(go))
        order = np.argsort(keys)
        kids = np.fromiter(go.values(), dtype=np.int64, count=len(go))[order].tolist()
        bounds = np.searchsorted(keys[order] // sigma, np.arange(len(start) + 1)).tolist()
        tour, first = self._toured(n, start, end, kids, bounds)
        self.first = np.array(first, dtype=np.int64)
        self.least = RangeMin(np.array(tour, dtype=np.int32))

    @staticmethod
    def _grown(s: list[int], sigma: int) -> tuple[list[int], list[int], dict[int, int]]:
        """Ends of the edge into each node, and the nodes by parent and first symbol."""
        n = len(s)
        start, end, link, go = [0], [0], [0], {}
        node = edge = length = remainder = 0
        for i, c in enumerate(s):
            remainder += 1
            waits = 0  # an inner node made in this step that still lacks its link
            while remainder:
                if not length:
                    edge = i
                key = node * sigma + s[edge]
                child = go.get(key)
                if child is None:
                    go[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if waits:
                        link[waits] = node
                        waits = 0
                else:
                    at = start[child]
                    long = end[child] - at
                    if length >= long:
                        edge += long
                        length -= long
                        node = child
                        continue
                    if s[at + length] == c:
                        length += 1
                        if waits:
                            link[waits] = node
                        break
                    inner = len(start)
                    go[key] = inner
                    start[child] = at + length
                    go[inner * sigma + s[at + length]] = child
                    go[inner * sigma + c] = inner + 1
                    start += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    if waits:
                        link[waits] = inner
                    waits = inner
                remainder -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - remainder + 1
        return start, end, go

    @staticmethod
    def _toured(n: int, start: list[int], end: list[int], kids: list[int], bounds: list[int]) -> tuple[list[int], list[int]]:
        """The Euler tour as the lengths that its nodes spell, and where it meets the leaf of each suffix."""
        tour, first, ahead = [0], [0] * n, bounds[:-1]
        above: list[tuple[int, int]] = []
        node = depth = 0
        while True:
            k = ahead[node]
            if k < bounds[node + 1]:
                ahead[node] = k + 1
                child = kids[k]
                d = depth + end[child] - start[child]
                if end[child] == n and bounds[child] == bounds[child + 1]:
                    first[n - d] = len(tour)
                    tour += (d, depth)
                else:
                    above.append((node, depth))
                    tour.append(d)
                    node, depth = child, d
            elif above:
                node, depth = above.pop()
                tour.append(depth)
            else:
                return tour, first

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the suffixes at i and j agree; i and j differ."""
        a, b = self.first[i], self.first[j]
        return self.least(np.minimum(a, b), np.maximum(a, b))

    def ranks(self) -> np.ndarray:
        """Each suffix's place among the sorted suffixes."""
        out = np.empty(len(self.first), dtype=np.int64)
        out[np.argsort(self.first)] = np.arange(len(self.first))
        return out


def _next_less(ranks: list[int]) -> list[int]:
    """For each place the next one of a lesser rank; where none is, the length."""
    n = len(ranks)
    out, open_ = [n] * n, []
    for i, r in enumerate(ranks):
        while open_ and ranks[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return out


def runs_of(s: list[int], sigma: int, min_length: int, min_exponent: int) -> np.ndarray:
    """start, length, period of all runs that are long enough, in rows; the first and the last number of s occur once."""
    n = len(s)
    tree = SuffixTree(s, sigma)
    ranks = tree.ranks()
    up, down = _next_less(ranks.tolist()), _next_less((n - 1 - ranks).tolist())
    at = np.tile(np.arange(n), 2)
    nxt = np.array(up + down, dtype=np.int64)
    keep = (nxt < n) & (at > 0)
    at, nxt = at[keep], nxt[keep]
    ahead = tree.common(at, nxt)
    del tree
    # a run of exponent 4 has a root that goes on for one more period at least
    if min_exponent >= 3:
        keep = ahead >= nxt - at
        at, nxt, ahead = at[keep], nxt[keep], ahead[keep]
    if not len(at):
        return np.empty((0, 3), dtype=np.int64)
    back = SuffixTree(s[::-1], sigma).common(n - at, n - nxt)
    period = nxt - at
    start, length = at - back, back + period + ahead
    long = length >= np.maximum(min_length, min_exponent * period)
    return np.unique(np.stack([start[long], length[long], period[long]], axis=1), axis=0)


def stretches(words: np.ndarray, owner: np.ndarray, least: int, min_length: int) -> list[np.ndarray]:
    """The places, stretch by stretch, that a run can lie in.

    A run of exponent `least` holds each of its words that many times. So a word that occurs
    less often in its text is in none, and parts the text in stretches, for which this holds
    again, and so on until nothing more is parted. owner ascends.
    """
    at = np.arange(len(words))
    part = owner.astype(np.int64)
    while len(at):
        key = part * (int(words.max()) + 1) + words[at]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        stay = counts[inverse] >= least
        cut = np.flatnonzero(np.diff(part) | (np.diff(at) > 1)) + 1
        if stay.all():
            return np.split(at, cut)
        at, part = at[stay], part[stay]
        if len(at):
            # stretches are what lies together and was together
            part = np.cumsum(np.concatenate([[0], (np.diff(part) != 0) | (np.diff(at) > 1)]))
            sizes = np.bincount(part)
            stay = sizes[part] >= min_length
            at, part = at[stay], part[stay]
    return []


def batch_runs(texts: list[list[str]], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """Per text, given as words, its runs by start, then period."""
    numbers: dict[str, int] = {}
    flat = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], dtype=np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(flat):
        return out
    found: list[np.ndarray] = []
    group: list[np.ndarray] = []

    def work() -> None:
        # symbols of their own part the stretches and close both ends, so that no run reaches over them
        joined = np.concatenate(group)
        _, compact = np.unique(flat[joined], return_inverse=True)
        sigma = int(compact.max()) + 2 + len(group)
        s, places, k, mark = [sigma - 1], [-1], 0, sigma - 2
        for g in group:
            s += compact[k : k + len(g)].tolist()
            s.append(mark)
            places += g.tolist()
            places.append(-1)
            k, mark = k + len(g), mark - 1
        rows = runs_of(s, sigma, min_length, min_exponent)
        rows[:, 0] = np.array(places)[rows[:, 0]]
        found.append(rows)

    size = 0
    for stretch in stretches(flat, np.repeat(np.arange(len(texts)), sizes), min_exponent, min_length):
        if group and size + len(stretch) > TREE_WORDS:
            work()
            group, size = [], 0
        group.append(stretch)
        size += len(stretch)
    if group:
        work()
    for start, length, period in (r for rows in found for r in rows.tolist()):
        text = int(np.searchsorted(firsts, start, side="right")) - 1
        out[text].append((start - int(firsts[text]), length, period))
    return [sorted(rows, key=lambda r: (r[0], r[2])) for rows in out]


def without_repeats(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return " ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return " ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """id, n_words (long), runs (array of start, length, period; by start, then period) and collapsed (string) of every row.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch of words with a smallest
    period that its neighbours don't carry on, of at least min_length words and min_exponent (2
    or more) periods. collapsed is the text without the words that a run holds after its first
    period, joined by one space.

    Null and empty texts, and those of white space, have no words, no runs and an empty
    collapsed text; null ids and repeated rows pass through row by row; an empty table gives an
    empty table; other columns are not carried. Rows come in Arrow batches of bounded bytes, and
    trees hold TREE_WORDS words or one longer stretch, some 1,000 bytes a word.
    """
    if min_exponent < 2:
        raise ValueError("a run holds its period twice at least")
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [WORDS.findall(t) for t in strings(b.column(1))]
            found = batch_runs(words, min_length, min_exponent)
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
            texts = [without_repeats(w, r) for w, r in zip(words, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(rows, run_type), pa.array(texts, pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
