"""Byte-level BPE through the tokenizers library, piece by piece, each piece encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: The white space of the Unicode property White_Space.
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
L = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
P = ".,!?:;#$%&*|"
#: Safe boundaries of the byte-level pre-tokenizer: before the one space that leads a word, round
#: runs of white space, and between a Latin word and the plain marks that end it. No merge
#: crosses them, so a section's tokens are its pieces' tokens. All else stays whole in its piece.
#: Sections are what lies between the tokenizer's added tokens, where the library cuts first.
PIECES = re.compile(f" ?[{L}]+(?=[{P}]*+(?:[{WS}]|\\Z))| ?[^{WS}]++|[{WS}]+(?![^{WS}])|[{WS}]")
#: Pieces that one Python worker remembers, about, twice over: those met lately and those before; longer ones than LONG are encoded each time.
REMEMBERED, LONG = 500_000, 64
#: Pieces that are encoded in one run.
RUN = 4000
#: What WS holds.
SPACES = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def space_led(path: str) -> np.ndarray:
    """Which ids stand for tokens that begin with a space (written as its byte's letter in the vocabulary)."""
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=False)
    led = np.zeros(max(vocabulary.values()) + 1024, dtype=bool)
    led[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
    return led


@lru_cache(maxsize=4)
def added(path: str) -> tuple[re.Pattern | None, bool, bool]:
    """The added tokens as a pattern, longest first; whether they stand for themselves alone; whether one holds white space."""
    tokens = tokenizer(path).get_added_tokens_decoder().values()
    names = sorted((t.content for t in tokens), key=len, reverse=True)
    # the library finds normalized ones in the normalized text, which is this text where nothing normalizes it
    plain = not any(t.lstrip or t.rstrip or t.single_word or (t.normalized and tokenizer(path).normalizer) for t in tokens)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None, plain, any(c in SPACES for n in names for c in n)


def divisible(path: str) -> bool:
    """Whether texts may be cut, and pieces joined, where a space leads a word: no added token reaches over it."""
    _, plain, spaced = added(path)
    return plain and not spaced


def cut(path: str, text: str) -> list[str]:
    """The pieces of a text; added tokens are pieces of their own."""
    found, plain, _ = added(path)
    if not found or not found.search(text):
        return PIECES.findall(text)
    if not plain:
        return [text]
    return [p for i, section in enumerate(found.split(text)) for p in ([section] if i % 2 else PIECES.findall(section))]


def encode_pieces(path: str, pieces: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Runs of pieces, their ids (unsigned 32-bit) one after another, and where each piece's ids end.

    Pieces led by a space are encoded in runs, since a space begins a token there and nowhere
    else: the ids of a run are cut at the tokens that begin with one. All others, and runs that
    don't give a cut for each piece, are encoded one by one.
    """
    led = space_led(path)
    by_runs = divisible(path)
    words, alone = [], []
    for p in pieces:
        (words if by_runs and p[0] == " " and len(p) > 1 and p[1] not in SPACES and "<|" not in p else alone).append(p)
    runs = [words[s : s + RUN] for s in range(0, len(words), RUN)]
    for run, e in zip(runs, tokenizer(path).encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, dtype="<u4")
        cuts = np.flatnonzero(led[ids])
        if len(cuts) == len(run):
            yield run, ids, np.append(cuts[1:], len(ids))
        else:
            alone += run
    if alone:
        each = [e.ids for e in tokenizer(path).encode_batch_fast(alone, add_special_tokens=False)]
        yield alone, np.array([i for ids in each for i in ids], dtype="<u4"), np.cumsum([len(ids) for ids in each])


def counts(ids: np.ndarray, ends: np.ndarray) -> list[int]:
    return np.diff(ends, prepend=0).tolist()


def raw_ids(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
    return [raw[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]


class PieceEncoder:
    """Encodes texts by their pieces; `values` turns the ids of pieces into what is kept of each."""

    def __init__(self, path: str, values: Callable[[np.ndarray, np.ndarray], list]) -> None:
        self.path, self.values, self.young, self.old = path, values, {}, {}

    def __call__(self, texts: list[str]) -> list[list]:
        """Per text the values of its pieces, in order."""
        each = [cut(self.path, t) for t in texts]
        found = [list(map(self.young.get, c)) for c in each]
        holes = [(c, v, [i for i, x in enumerate(v) if x is None]) for c, v in zip(each, found, strict=True) if None in v]
        missing = set()
        for c, v, at in holes:
            for i in at:
                if (x := self.old.get(c[i])) is None:
                    missing.add(c[i])
                else:
                    self.young[c[i]] = v[i] = x
        missing = list(missing)
        for pieces, ids, ends in encode_pieces(self.path, missing):
            self.young.update(zip(pieces, self.values(ids, ends), strict=True))
        for c, v, at in holes:
            for i in at:
                if v[i] is None:
                    v[i] = self.young[c[i]]
        for p in missing:
            if len(p) > LONG:
                del self.young[p]
        if len(self.young) > REMEMBERED:  # pieces met again live on, the others go with the next turn
            self.old, self.young = self.young, {}
        return found


#: One encoder per kind in each Python worker, kept from task to task.
_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    """kind: `count` for numbers of tokens, `bytes` for ids as little-endian unsigned 32-bit integers."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = PieceEncoder(path, {"count": counts, "bytes": raw_ids}[kind])
    return _encoders[path, kind]


def balanced(texts: Iterable[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts in groups of about `limit` bytes of UTF-8; longer texts are alone."""
    group, size = [], 0
    for t in texts:
        own = len(t) if t.isascii() else len(t.encode())
        if group and size + own > limit:
            yield group
            group, size = [], 0
        group.append(t)
        size += own
    if group:
        yield group


def split_safely(text: str, limit: int) -> list[str]:
    """Cut a long text into parts of about `limit` characters where a piece begins.

    A part ends before a single space that stands between two characters that are no white
    space. Where no such place comes, the part runs on to the next one.
    """
    if len(text) <= limit:
        return [text]
    parts, at = [], 0
    while len(text) - at > limit:
        m = SAFE.search(text, at + limit)
        if not m:
            break
        parts.append(text[at : m.start() + 1])
        at = m.start() + 1
    return [*parts, text[at:]]


SAFE = re.compile(f"[^{WS}](?= [^{WS}])")


def strings(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]
