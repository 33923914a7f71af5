"""Words of texts as 64-bit hashes, worked out for all words of a text at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Base of the words' polynomial hash, modulo 2^64; odd, so that it has an inverse.
BASE = 0xD6E8FEB86659FD93
#: Bytes of a text that are hashed at once, about: what is held meanwhile is some 30 times that.
CHUNK = 1 << 20
#: Words of more bytes are hashed one by one, since a polynomial modulo 2^64 is weak on some long ones.
LONG = 256
#: Fixed value: marks that plain_words() leaves out.
MARKS = b".,;:!?\"'()[]{}<>*#$%&|/\\-_=+~`^@"

_blank = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_blanks = re.compile(rb"[\x20\x09-\x0D]")
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, n of them at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 14)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _chunks(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > CHUNK:
        m = _blanks.search(raw, at + CHUNK)
        end = m.start() if m else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:]


def hash_words(raw: bytes) -> np.ndarray:
    """A hash of every word `[^\\x20\\x09-\\x0D]+`, in order.

    A word's polynomial is a difference of running sums over all bytes, moved to its start.
    """
    out = []
    for part in _chunks(raw):
        b = np.frombuffer(part, dtype=np.uint8)
        edges = np.flatnonzero(np.diff(_blank[b], prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        up, down = _up_to(len(b) + 1)
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
        for i in np.flatnonzero(ends - starts > LONG):
            h[i] = xxhash.xxh64_intdigest(part[starts[i] : ends[i]])
        out.append(h)
    return out[0] if len(out) == 1 else np.concatenate(out)


def exact_words(text: str) -> np.ndarray:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased and all else as it is."""
    return hash_words(text.encode().lower())


def plain_words(text: str) -> np.ndarray:
    """Words in lower case without punctuation."""
    return hash_words(text.lower().encode().translate(None, MARKS))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams in order; fewer words make one gram of them all; none make none."""
    m = len(words)
    if m == 0:
        return words
    width = min(n, m)
    out = np.full(m - width + 1, np.uint64(width))
    for j in range(width):
        out = (out ^ words[j : m - width + 1 + j]) * MIX
        out ^= out >> np.uint64(29)
    return out


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The hashes sorted, each once."""
    s = np.sort(hashes)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s
