"""Byte-pair encoding of whole texts by contiguous rank arrays, and decoding."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factorlake.llm.pieces import strings, tokenizer
from factorlake.llm.scratch import bounded_batches

#: No tokens reach over these, whatever the text's other white space: space, tab to carriage return.
CHUNKS = re.compile(r"[^\x20\x09-\x0D]+")
#: Latin letters beyond ASCII, each of one code point in either case, and how the pre-tokenizer cuts texts of these, printable ASCII and white space, in lower case.
LATIN = "\xc0-\xd6\xd8-\xf6\xf8-\xff"
PLAIN = re.compile(f"[\\x20-\\x7E\\x09-\\x0D{LATIN}]*")
PLAIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\\x20\\x09-\\x0Da-z0-9{LATIN}]+")
#: Symbols of a word that is merged by scans of its rank array; longer ones keep their ranks in a heap.
SHORT = 128
#: Words that one Python worker remembers, twice over (those met lately and those before), and the longest such word.
REMEMBERED, LONG = 400_000, 64
NEVER = 1 << 40


class RankedMerges:
    """The merges of a BPE file by the ids of their two sides: the lower its rank, the sooner a pair is merged, and of equal pairs the leftmost."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str) -> None:
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
        #: rank[left][right], and the id that the pair of a rank becomes
        self.rank: list[dict[int, int]] = [{} for _ in range(1 + max(vocabulary.values()))]
        for r, (a, b) in enumerate(pairs):
            self.rank[vocabulary[a]][vocabulary[b]] = r
        self.merged = [vocabulary[a + b] for a, b in pairs]
        self.vocabulary, self.suffix = vocabulary, suffix

    def symbols(self, word: str) -> list[int]:
        """The ids of a word's single letters, which are the vocabulary's; the last one ends a word."""
        return [*(self.vocabulary[c] for c in word[:-1]), self.vocabulary[word[-1] + self.suffix]]

    def ids(self, parts: list[int]) -> list[int]:
        """The ids of a word of these symbols."""
        return self.scanned(parts) if len(parts) <= SHORT else self.heaped(parts)

    def scanned(self, parts: list[int]) -> list[int]:
        """Merge by the rank array: ranks[i] is the rank of the two parts beside boundary i."""
        rank = self.rank
        ranks = [rank[a].get(b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] = own = self.merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank[parts[i - 1]].get(own, NEVER)
            if i < len(ranks):
                ranks[i] = rank[own].get(parts[i + 1], NEVER)
        return parts

    def heaped(self, parts: list[int]) -> list[int]:
        """The same merges in n log n steps, for words whose scans would take n squared."""
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank[a].get(b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or rank[parts[i]].get(parts[j]) != r:
                continue  # one of its sides has changed since
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := rank[parts[i]].get(parts[after[i]])) is not None:
                    heapq.heappush(heap, (s, i))
            if before[i] >= 0 and (s := rank[parts[before[i]]].get(parts[i])) is not None:
                heapq.heappush(heap, (s, before[i]))
        return [p for p in parts if p >= 0]


class Codec:
    """Encodes and decodes by one tokenizer file: its normalizer and pre-tokenizer cut words, which are merged here."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        names = [a["content"] for a in spec["added_tokens"]]
        odd = [a for a in spec["added_tokens"] if a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or CHUNKS.fullmatch(a["content"]) is None]
        if model["type"] != "BPE" or spec["decoder"] is not None or odd or any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} is no BPE of the kind that is read here")
        self.library = tokenizer(path)
        self.merges = RankedMerges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.added = {a["content"]: np.array([a["id"]], dtype="<i4").tobytes() for a in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + ")") if names else None
        numbered = [*model["vocab"].items(), *((a["content"], a["id"]) for a in spec["added_tokens"])]
        self.tokens: list[str | None] = [None] * (1 + max(i for _, i in numbered))
        for t, i in numbered:
            self.tokens[i] = t
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        letters = dict(zip(range(256), self._byte_letters(), strict=True))
        self.inner = [self.merges.vocabulary[letters[b]] for b in range(256)]
        self.last = [self.merges.vocabulary[letters[b] + self.merges.suffix] for b in range(256)]
        # the shortcut for plain texts holds where the file lowers and cuts their characters as written above
        every = [chr(c) for c in range(0x21, 0x100) if PLAIN.fullmatch(chr(c))]
        probes = ["".join(every), *every, *(x + y for x in every for y in "aA1-'"), "it's we'RE I'll'd 12a--b '' 'S't", "a\tb\x0bc\n\nd"]
        spelt = lambda w: "".join(letters[b] for b in w.encode())
        self.plain = all(self._words(p) == [spelt(w) for w in PLAIN_WORDS.findall(p.lower())] for p in probes)

    @staticmethod
    def _byte_letters() -> list[str]:
        """The letter that stands for each byte: the printable ones for themselves, the others for those from U+0100 on, in order."""
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
        hidden = iter(range(0x100, 0x200))
        return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]

    def _words(self, section: str) -> list[str]:
        """The library's words of a section, in the vocabulary's letters."""
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(section))]

    def _plain_word(self, word: str) -> bytes:
        raw = word.encode()
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        return np.array(self.merges.ids(parts), dtype="<i4").tobytes()

    def _other_chunk(self, chunk: str) -> bytes:
        ids = [i for w in self._words(chunk) for i in self.merges.ids(self.merges.symbols(w))]
        return np.array(ids, dtype="<i4").tobytes()

    def _remembered(self, keys: Iterable[str], work: Callable[[str], bytes], out: list[bytes]) -> None:
        young, old = self.young, self.old
        for k in keys:
            raw = young.get(k)
            if raw is None:
                raw = old.get(k)
                if raw is None:
                    raw = work(k)
                if len(k) <= LONG:
                    young[k] = raw
            out.append(raw)
        if len(young) > REMEMBERED:  # words met again live on, the others go with the next turn
            self.old, self.young = young, {}

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        out: list[bytes] = []
        for i, s in enumerate(self.special.split(text) if self.special and self.special.search(text) else [text]):
            if i % 2:
                out.append(self.added[s])
            elif self.plain and PLAIN.fullmatch(s):
                self._remembered(PLAIN_WORDS.findall(s.lower()), self._plain_word, out)
            else:
                for c in CHUNKS.findall(s):
                    if self.plain and PLAIN.fullmatch(c):
                        self._remembered(PLAIN_WORDS.findall(c.lower()), self._plain_word, out)
                    else:
                        self._remembered([c], self._other_chunk, out)
        return b"".join(out)

    def decode(self, ids: list[int | None]) -> str:
        """The tokens of the ids with one space between; ids that stand for none give nothing."""
        known = self.tokens
        return " ".join([t for i in ids if i is not None and 0 <= i < len(known) and (t := known[i]) is not None])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int): the tokens of every whole text, as the tokenizers library gives them for this file.

    Without added special tokens, truncation or padding; special strings inside texts become
    their ids, as by the library's default. Null and empty texts have no ids; null ids of rows
    and repeated rows pass through row by row; an empty table gives an empty table; other columns
    are not carried. Only files of a plain BPE without a decoder are taken, others raise.

    No token reaches over white space, so texts of any length are encoded word by word; words
    met lately are remembered. Rows come in Arrow batches of bounded bytes.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for b in batches:
            raw = [own.encode(t) for t in strings(b.column(1))]
            ends = np.cumsum([0, *(len(r) // 4 for r in raw)])
            values = pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids and decoded (string): what the library's decode gives for the ids, special tokens kept.

    Null and empty arrays give an empty text; null ids inside an array, and ids the file doesn't
    know, give nothing, as with the library.
    """
    bounded_batches(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for b in batches:
            texts = [own.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=[id_col, ids_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>, decoded string")
