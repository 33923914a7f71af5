"""Benchmark decontamination: the rarest seeds that no passage above the threshold can lack join documents to items, then Smith-Waterman alignment."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlake.llm.scratch import bounded_batches, discard, kept
from factorlake.llm.words import MIX, plain_words

#: Item seeds that one pass over the candidates looks up, about: 24 bytes each on every machine.
SEED_BLOCK = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Seeds are k words in order with at most s words between them; the first kind that fits an item's size is taken.
KINDS = ((3, 2), (2, 1), (1, 0))
#: Pairs of a seed in a document and one in an item that are handled at once, about.
HITS = 2_000_000
#: Bits of the filter that tells which seeds of documents are seeds of items: so many a seed, up to 2 ** FILTER_BITS (32 MB).
BITS_PER_SEED, FILTER_BITS = 64, 28
#: Groups of items: a document goes on if it has two places with seeds of one group. What a seed is changed by for each, and for items that need one seed only.
GROUPS = 64
GROUP_MARKS = np.arange(1, GROUPS + 2, dtype=np.uint64) * MIX


def least_score(size: int, threshold: float) -> int:
    """The least alignment score that reaches the threshold for an item of so many words."""
    return max(1, math.ceil(threshold * MATCH * size - 1e-9))


def least_seeds(size: int, threshold: float, k: int, s: int) -> int:
    """How many seeds of the kind every alignment that reaches the threshold holds at least.

    With m matches and score t an alignment has e <= 2 m - t errors, each 1 off. Of its m - k + 1
    runs of k matches, those with over s errors inside are no seeds; every error is inside of
    k - 1 runs at most, so these are (k - 1) e / (s + 1) at most.
    """
    t = least_score(size, threshold)
    m = np.arange(-(-t // MATCH), max(size, -(-t // MATCH)) + 1)
    return int((m - k + 1 - (k - 1) * np.maximum(MATCH * m - t, 0) // (s + 1)).min())


def seed_kind(size: int, threshold: float) -> tuple[int, int]:
    return next((x for x in KINDS if least_seeds(size, threshold, *x) > 0), KINDS[-1])


def seed_hashes(words: np.ndarray, k: int, s: int) -> Iterator[tuple[int, np.ndarray]]:
    """For every way to leave out at most s words between k: the last word's distance, and the hashes by first word."""
    found = [(0, 0, _mixed(np.full(len(words), np.uint64(k)), words))]
    for _ in range(k - 1):
        found = [(last + 1 + g, used + g, _mixed(h[: max(0, len(words) - last - 1 - g)], words[last + 1 + g :])) for last, used, h in found for g in range(s - used + 1)]
    for last, _, h in found:
        yield last, h


def _mixed(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = (h ^ words) * MIX
    out ^= out >> np.uint64(29)
    return out


def _lookup(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams, and a bitmap of their low bits that rules most others out."""
    keys = np.unique(grams.view(np.uint64))
    bits = min(26, max(10, int(len(keys) * 32).bit_length()))
    seen = np.zeros(1 << bits, dtype=bool)
    seen[(keys & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    return keys, seen


def _places(g: np.ndarray, keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in g, and the key's number, of the grams that are among the keys."""
    maybe = np.flatnonzero(seen[(g & np.uint64(len(seen) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, g[maybe]), len(keys) - 1)
    real = keys[at] == g[maybe]
    return maybe[real], at[real]


class _Filter:
    """A Bloom filter of two hashes and bounded size; the driver holds its words, never the seeds."""

    def __init__(self, grams: DataFrame) -> None:
        n = grams.count()
        self.bits = min(FILTER_BITS, max(16, (BITS_PER_SEED * n).bit_length()))
        low = F.lit((1 << self.bits) - 1).cast("long")
        place = F.explode(F.array(F.col("gram").bitwiseAND(low), F.shiftrightunsigned("gram", 64 - self.bits)))
        words = grams.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), dtype=np.uint64)
        self.words[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def _has(self, place: np.ndarray) -> np.ndarray:
        return (self.words[(place >> np.uint64(6)).view(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Where in grams its members, and a few others, are."""
        at = np.flatnonzero(self._has(grams & np.uint64((1 << self.bits) - 1)))
        return at[self._has(grams[at] >> np.uint64(64 - self.bits))]


def _found(texts: pa.Array, kinds: Iterable[tuple[int, int]], known: _Filter) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place (in the words of all, ascending) and seed of the seeds in these texts that pass the filter, for every way to leave words out."""
    each = [plain_words(t or "") for t in texts.to_pylist()]
    words, doc_of = np.concatenate(each), np.repeat(np.arange(len(each)), [len(w) for w in each])
    for k, s in kinds:
        for last, h in seed_hashes(words, k, s):
            at = known.places(h)
            at = at[doc_of[at] == doc_of[at + last]]
            yield doc_of[at], at, h[at]


def _ends_of_each(row: np.ndarray, place: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and the last place of each seed in each row: enough to tell whether seeds lie at two places, however often a text repeats itself."""
    order = np.lexsort((place, gram, row))
    new = (np.diff(row[order]) != 0) | (gram[order][1:] != gram[order][:-1])
    order = order[np.concatenate([[True], new]) | np.concatenate([new, [True]])] if len(order) else order
    return row[order], place[order], gram[order]


def _in_company(row: np.ndarray, place: np.ndarray, gram: np.ndarray, grouped: _Filter) -> np.ndarray:
    """Which of the seeds share their group of items with one at another place of the document, or need not."""
    out = np.zeros(len(gram), dtype=bool)
    for g, mark in enumerate(GROUP_MARKS):
        at = grouped.places(gram ^ mark)
        if g < GROUPS and len(at):
            _, first = np.unique(place[at], return_index=True)
            at = at[np.bincount(row[at[first]])[row[at]] > 1]
        out[at] = True
    return out


def _group_keys(rare: DataFrame) -> DataFrame:
    """gram: the seeds of `rare`, each changed by the mark of its item's group."""
    group = F.when(F.col("need") > 1, F.pmod(F.xxhash64("item_id"), F.lit(GROUPS)).cast("int")).otherwise(GROUPS)
    marks = F.array(*(F.lit(int(m)) for m in GROUP_MARKS.view(np.int64)))
    return rare.select(F.col("gram").bitwiseXOR(F.element_at(marks, group + 1)).alias("gram")).distinct()


def _counted(docs: DataFrame, kinds: list[tuple[int, int]], known: _Filter) -> DataFrame:
    """gram, n: how often all documents hold the seeds that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, found in _found(b.column(0), kinds, shared.value) if b.num_rows else ():
                grams, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _seeded(docs: DataFrame, kinds: list[tuple[int, int]], known: _Filter, grouped: _Filter) -> DataFrame:
    """row, doc_id, text, grams (each once) of the documents that hold two seeds of one group of items, or one of an item that needs no more.

    What passes the filters wrongly goes with the join; nothing is left out wrongly, since an
    item that needs two seeds has them at two places of the document, in its own group.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, grouped))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row, place, gram = (np.concatenate(c) for c in zip(*(_ends_of_each(*f) for f in _found(b.column(2), kinds, shared.value[0])), strict=True))
            good = _in_company(row, place, gram, shared.value[1])
            row, gram = row[good], gram[good].view(np.int64)
            order = np.lexsort((gram, row))
            row, gram = row[order], gram[order]
            if len(row):
                new = np.concatenate([[True], (np.diff(row) != 0) | (gram[1:] != gram[:-1])])
                row, gram = row[new], gram[new]
            has, first = np.unique(row, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(gram))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(has)) for c in b.columns), lists], names=["row", "doc_id", "text", "grams"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, "row bigint, doc_id bigint, text string, grams array<bigint>")


def _item_seeds(item_words: DataFrame, threshold: float) -> DataFrame:
    """item_id, gram, pos, places (of seeds in the item) and need (how many of them an alignment holds) of all the items' seeds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = w.values.to_numpy().view(np.uint64)
                k, s = seed_kind(len(words), threshold)
                need, places = max(1, least_seeds(len(words), threshold, k, s)), len(words) - k + 1
                for _, h in seed_hashes(words, k, s):
                    n = len(h)
                    columns = [np.full(n, i), h.view(np.int64), np.arange(n), np.full(n, places), np.full(n, need)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "gram", "pos", "places", "need"])

    return item_words.mapInArrow(run, "item_id bigint, gram bigint, pos bigint, places bigint, need bigint").distinct()


def _rarest(seeds: DataFrame, counts: DataFrame) -> DataFrame:
    """item_id, gram, pos, need of the seeds at an item's rarest places.

    Of an item's places an alignment holds `need` at least, so it holds one of any places - need + 1
    and two of any places - need + 2. The latter are kept: those that pair the fewest
    documents with items.
    """
    weight = seeds.groupBy("gram").agg(F.count("*").alias("rows")).join(counts, "gram", "left").select("gram", (F.col("rows") * F.coalesce("n", F.lit(0))).alias("pairs"))
    places = seeds.join(weight, "gram").groupBy("item_id", "pos").agg(F.sum("pairs").alias("pairs"), F.first("places").alias("places"), F.first("need").alias("need"))
    order = F.row_number().over(Window.partitionBy("item_id").orderBy("pairs", "pos"))
    some = places.withColumn("nth", order).where(F.col("nth") <= F.col("places") - F.col("need") + F.least("need", F.lit(2))).select("item_id", "pos")
    return seeds.join(some, ["item_id", "pos"]).select("item_id", "gram", "pos", "need")


class _Block:
    """Items and their seeds, as every machine holds them for one pass over the candidates."""

    def __init__(self, ids: list[int], words: list[np.ndarray], threshold: float) -> None:
        self.ids, self.words = np.array(ids, dtype=np.int64), words
        sizes = [len(w) for w in words]
        kind = [seed_kind(m, threshold) for m in sizes]
        self.kinds = sorted(set(kind))
        self.size = np.array(sizes, dtype=np.int64)
        self.need = np.array([max(1, least_seeds(m, threshold, *x)) for m, x in zip(sizes, kind, strict=True)], dtype=np.int64)
        # how many words an alignment that reaches the threshold changes, adds or leaves out, at most
        self.room = np.array([max(0, MATCH * m - least_score(m, threshold)) for m in sizes], dtype=np.int64)
        grams, item, pos = [], [], []
        for i, (w, x) in enumerate(zip(words, kind, strict=True)):
            for _, h in seed_hashes(w, *x):
                grams.append(h)
                item.append(np.full(len(h), i, dtype=np.int64))
                pos.append(np.arange(len(h), dtype=np.int64))
        gram, item, pos = (np.concatenate(x) for x in (grams, item, pos))
        self.keys, self.seen = _lookup(gram)
        number = np.searchsorted(self.keys, gram)
        # where words repeat, one seed fits a place in several ways and counts once
        order = np.lexsort((pos, item, number))
        same = (np.diff(number[order]) == 0) & (np.diff(item[order]) == 0) & (np.diff(pos[order]) == 0)
        order = order[np.concatenate([[True], ~same])]
        self.item, self.pos, self.first = item[order], pos[order], np.searchsorted(number[order], np.arange(len(self.keys) + 1))
        #: Ascending: the seed's number, then its item.
        self.place = number[order] * len(self.ids) + self.item

    def hits(self, words: np.ndarray, doc_of: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Document, place there, item and place there of like seeds, in groups of about HITS.

        Groups are of whole documents; one document of more is parted by items, and those of one
        item by overlapping stretches of the document, of which one holds all of an alignment.
        """
        at, which = [], []
        for k, s in self.kinds:
            for last, h in seed_hashes(words, k, s):
                a, w = _places(h, self.keys, self.seen)
                own = doc_of[a] == doc_of[a + last]
                at.append(a[own])
                which.append(w[own])
        # ascending places, each seed once in each
        both = np.unique(np.concatenate(at) * len(self.keys) + np.concatenate(which))
        at, which = both // len(self.keys), both % len(self.keys)
        times = self.first[which + 1] - self.first[which]
        total, doc = np.cumsum(times), doc_of[at]
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else []
        s = 0
        for e in [*starts[1:], len(doc)]:
            if e > s and (e == len(doc) or total[e - 1] - total[s] + times[s] > HITS):
                # what is over HITS, of one document mostly, is parted by items: pairs stay whole
                parts = min(len(self.ids), 1 + int(times[s:e].sum()) // HITS)
                edges = np.linspace(0, len(self.ids), parts + 1).astype(np.int64)
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    first, last = (np.searchsorted(self.place, which[s:e] * len(self.ids) + x) for x in (lo, hi))
                    t = last - first
                    for a, z in self._stretches(at[s:e], t, int((self.size[lo:hi] + 2 * self.room[lo:hi]).max())):
                        own = t[a:z]
                        entry = np.repeat(first[a:z] - np.cumsum(own) + own, own) + np.arange(own.sum())
                        yield np.repeat(doc[s + a : s + z], own), np.repeat(at[s + a : s + z], own), self.item[entry], self.pos[entry]
                s = e

    @staticmethod
    def _stretches(at: np.ndarray, times: np.ndarray, reach: int) -> Iterator[tuple[int, int]]:
        """Where stretches of ascending places begin and end: of about HITS pairs, but at least 2 * reach wide, and each `reach` into the next."""
        total = np.cumsum(times)
        if not len(at) or total[-1] <= HITS:
            yield 0, len(at)
            return
        a = 0
        while True:
            z = max(int(np.searchsorted(at, at[a] + 2 * reach, side="right")), int(np.searchsorted(total, total[a] - times[a] + HITS, side="right")))
            yield a, z
            if z >= len(at):
                return
            a = int(np.searchsorted(at, at[z - 1] - reach, side="right"))

    def windows(self, words: np.ndarray, ends: np.ndarray, doc_of: np.ndarray, asked: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int, int]]:
        """Document, item, seeds, and from where to where (in all words) an alignment that reaches the threshold may lie.

        asked: the pairs to look at, ascending, as the document's number times that of the items plus the item's; all pairs without it.
        """
        for doc, at, item, pos in self.hits(words, doc_of):
            pair, diagonal = doc * len(self.ids) + item, at - pos
            if asked is not None:
                mine = asked[np.minimum(np.searchsorted(asked, pair), len(asked) - 1)] == pair
                pair, diagonal, pos = pair[mine], diagonal[mine], pos[mine]
                if not len(pair):
                    continue
            order = np.lexsort((pos, diagonal, pair))
            pair, diagonal, pos = pair[order], diagonal[order], pos[order]
            new = np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(diagonal) != 0) | (np.diff(pos) != 0)])
            pair, diagonal = pair[new], diagonal[new]
            item = pair % len(self.ids)
            # its seeds are of one document and lie on diagonals that its errors can reach
            other = np.minimum(np.arange(len(pair)) + self.need[item] - 1, len(pair) - 1)
            enough = (other - np.arange(len(pair)) == self.need[item] - 1) & (pair[other] == pair) & (diagonal[other] - diagonal <= self.room[item])
            here = np.flatnonzero(enough)
            if not len(here):
                continue
            item, room = item[here], self.room[item[here]]
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(pair[here]) != 0) | (np.diff(diagonal[here]) > room[1:])]))
            for s, e in zip(starts, np.append(starts[1:], len(here)) - 1, strict=True):
                i, r = int(item[s]), int(room[s])
                d = int(pair[here[s]] // len(self.ids))
                left, right = int(ends[d - 1]) if d else 0, int(ends[d])
                lo, hi = max(left, int(diagonal[here[s]]) - r), min(right, int(diagonal[here[e]]) + int(self.size[i]) + r)
                # seeds that drift over a long stretch still give windows of bounded size, of which one holds the alignment
                reach = int(self.size[i]) + 2 * r
                for w in range(lo, max(lo + 1, hi - reach), reach) if hi - lo > 2 * reach else [lo]:
                    yield d, i, int(other[here[e]] - here[s] + 1), w, min(hi, w + 2 * reach)


def _aligned(docs: DataFrame, block: _Block, threshold: float) -> DataFrame:
    """doc_id, item_id, score, word_end, n_seeds of the windows that reach the threshold; docs: doc_id, text, item_ids (to look at, of the block's)."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    names = ["doc_id", "item_id", "score", "word_end", "n_seeds"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            each = [plain_words(t or "") for t in b.column(1).to_pylist()]
            ends = np.cumsum([len(w) for w in each])
            words, doc_of = np.concatenate(each), np.repeat(np.arange(len(each)), [len(w) for w in each])
            asked = np.repeat(np.arange(len(each)), pc.list_value_length(b.column(2)).to_numpy()) * len(own.ids) + np.searchsorted(own.ids, b.column(2).flatten().to_numpy())
            for group in _alike(own.windows(words, ends, doc_of, np.sort(asked)), own.size):
                doc, item, seeds, lo, hi = (np.array(c, dtype=np.int64) for c in zip(*group, strict=True))
                score, end = smith_waterman([_signed(own.words[i]) for i in item], [_signed(words[s:e]) for s, e in zip(lo, hi, strict=True)])
                share = score / (MATCH * own.size[item])
                good = np.flatnonzero(score >= np.array([least_score(m, threshold) for m in own.size[item]]))
                place = end + lo - np.where(doc > 0, ends[doc - 1], 0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[good])), pa.array(own.ids[item][good]), pa.array(share[good]), pa.array(place[good]), pa.array(seeds[good], pa.int32())], names=names)

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint, score double, word_end bigint, n_seeds int")


def _alike(windows: Iterable[tuple[int, ...]], size: np.ndarray, at_once: int = 20_000, cells: int = 1 << 20) -> Iterator[list[tuple[int, ...]]]:
    """Groups of windows of like size, of at most `cells` words of items and windows together, or one."""

    def groups(some: list[tuple[int, ...]]) -> Iterator[list[tuple[int, ...]]]:
        some.sort(key=lambda w: (size[w[1]], w[4] - w[3]))
        group, longest = [], 0
        for w in some:
            longest = max(longest, int(size[w[1]]) + w[4] - w[3])
            if group and (len(group) >= 500 or (len(group) + 1) * longest > cells):
                yield group
                group, longest = [], int(size[w[1]]) + w[4] - w[3]
            group.append(w)
        if group:
            yield group

    some: list[tuple[int, ...]] = []
    for w in windows:
        some.append(w)
        if len(some) == at_once:
            yield from groups(some)
            some = []
    yield from groups(some)


def _signed(words: np.ndarray) -> np.ndarray:
    """Hashes without their lowest bit, none of them negative, as what pads an alignment is."""
    return (words >> np.uint64(1)).view(np.int64)


def smith_waterman(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of every item with its window, and the window place just after it.

    All pairs advance together along anti-diagonals.
    """
    n, rows, columns = len(items), max(map(len, items)), max(map(len, windows))
    a, b = np.full((n, rows), -1, dtype=np.int64), np.full((n, columns), -2, dtype=np.int64)
    for i, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    best, end = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    before = np.zeros((n, rows + 1), dtype=np.int32)
    last = np.zeros((n, rows + 1), dtype=np.int32)
    for d in range(rows + columns - 1):
        lo, hi = max(0, d - columns + 1), min(rows, d + 1)
        i = np.arange(lo, hi)
        now = np.zeros_like(last)
        step = np.where(a[:, i] == b[:, d - i], MATCH, MISMATCH)
        now[:, i + 1] = np.maximum(np.maximum(before[:, i] + step, 0), np.maximum(last[:, i], last[:, i + 1]) + GAP)
        top = now[:, lo + 1 : hi + 1].max(axis=1)
        better = top > best
        if better.any():
            place = now[:, lo + 1 : hi + 1].argmax(axis=1)
            end = np.where(better, d - (lo + place) + 1, end)
            best = np.where(better, top, best)
        before, last = last, now
    return best, end


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Pairs of a document and a test item that it holds, whole, in part or edited.

    docs: doc_id, text; items: item_id, text. Returns doc_id, item_id, score (double: alignment
    score over that of the whole item, 1 for an exact copy), word_end (long: the document's word
    after the passage) and n_seeds (int), for all pairs with score >= threshold (over 0); one row a pair, its
    best passage. Words are compared in lower case without punctuation. Null and empty texts and null ids
    take no part; rows of one id are one document, rows of one item_id one item with the least text.
    Empty tables give an empty table; other columns are not carried.

    No pair is lost. Seeds are runs of words of an item, with gaps, of the first kind of KINDS that an
    alignment at the threshold can't lack. How often each occurs is counted over all documents; the
    rarest places of an item, which every such alignment holds two of (or one, where it need hold but one
    seed), join documents to items. In a pair so joined all seeds count: it is aligned where
    as many as it must hold lie on diagonals that its errors can reach, in windows as wide as
    these; n_seeds counts those of one stretch of a document that has millions of them.

    The documents are read twice, however many items there are: to count, and to write those
    with a rare seed. Seeds are told by a filter of bounded size. Of the joined documents items are looked up in
    blocks of about SEED_BLOCK seeds, so what every machine holds is bounded (a longer item is alone in
    its block, or with few others).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([plain_words(t).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["item_id", "words"])

    item_words = kept(items.mapInArrow(run, "item_id bigint, words array<bigint>").where(F.size("words") > 0), "items")
    n_words = item_words.agg(F.sum(F.size("words"))).first()[0] or 0
    if not n_words:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, score double, word_end bigint, n_seeds int")
    n_blocks = -(-6 * n_words // SEED_BLOCK) if 6 * n_words <= SEED_BLOCK else 2 * -(-6 * n_words // SEED_BLOCK)
    kinds = sorted({seed_kind(r[0], threshold) for r in item_words.select(F.size("words")).distinct().toLocalIterator()})
    seeds = kept(_item_seeds(item_words, threshold), "seeds")
    counts = kept(_counted(docs, kinds, _Filter(seeds.select("gram").distinct())), "counts")
    rare = kept(_rarest(seeds, counts), "rare")
    discard(seeds, counts)
    held = kept(_seeded(docs, kinds, _Filter(rare.select("gram").distinct()), _Filter(_group_keys(rare))), "seeded")
    pairs = held.select("row", F.explode("grams").alias("gram")).join(rare, "gram").groupBy("row", "item_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("need").alias("need"))
    pairs = pairs.where("need = 1 or first < last").groupBy("row", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).alias("block")).agg(F.collect_list("item_id").alias("item_ids"))  # of one block's items
    pairs = kept(pairs, "pairs")
    # the pairs grow with the documents: they are never broadcast, and the plan is one at every size
    joined = kept(held.select("row", "doc_id", "text").join(pairs.hint("merge"), "row").select("block", "doc_id", "text", "item_ids"), "joined")
    discard(held, pairs, rare)
    found = None
    for i in range(n_blocks):
        part = item_words.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == i).sort("item_id").collect()  # about SEED_BLOCK / 12 words
        if part:
            block = _Block([r.item_id for r in part], [np.array(r.words, dtype=np.int64).view(np.uint64) for r in part], threshold)
            some = _aligned(joined.where(F.col("block") == i).select("doc_id", "text", "item_ids"), block, threshold)
            found = some if found is None else found.union(some)
    discard(item_words)
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("score", "word_end", "n_seeds"), F.struct("score", "n_seeds", -F.col("word_end"))).alias("b"))
    return best.select("doc_id", "item_id", "b.score", "b.word_end", "b.n_seeds")
