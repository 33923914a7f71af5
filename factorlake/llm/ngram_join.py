"""Near-duplicate documents by an exact n-gram Jaccard join."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.llm.components import components
from factorlake.llm.scratch import bounded_batches, discard, kept
from factorlake.llm.words import distinct, exact_words, ngrams

#: Counters of the frequency sketch, and of one of its chunks: a table of fixed size for any input.
SKETCH, CHUNK = 1 << 21, 1 << 10
#: Members that one copy of a pivot's set is compared with.
FAN = 200
#: Members of one block of an open group, about.
GROUP_BLOCK = 1000
#: Tables that grow with the corpus are joined by shuffle and sort whatever their size at hand.
GROWING = "merge"
#: The suffix filter's parts are told apart by this many leading bits of a shingle's hash, at most.
PART_BITS = 8
#: Longs of a set's parities.
PARITY_LONGS = 8


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words has one shingle, one without words none."""
    return distinct(ngrams(exact_words(text or ""), width))


def facts(docs: DataFrame, width: int) -> DataFrame:
    """Per document its set's size and 128-bit digest; per task and chunk its shingle counts (the rows with a chunk)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.uint32)
        names = ["doc_id", "n", "digest", "chunk", "counts"]
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(1).to_pylist()]
            if sets:
                every = np.concatenate(sets)
                counts += np.bincount((every >> np.uint64(20)).astype(np.int64) & (SKETCH - 1), minlength=SKETCH).astype(np.uint32)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        if counts.any():
            some = [c for c in range(SKETCH // CHUNK) if counts[c * CHUNK : (c + 1) * CHUNK].any()]
            none = pa.nulls(len(some))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(some, pa.int32()), pa.array([counts[c * CHUNK : (c + 1) * CHUNK].tobytes() for c in some], pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id bigint, n bigint, digest binary, chunk int, counts binary")


def frequency_levels(known: DataFrame) -> np.ndarray:
    """For every sketch counter the quarter-octave of its total, one byte each.

    Chunks are dealt by number and summed as they stream by, one total per chunk in memory; the
    driver gets SKETCH numbers whatever the input.
    """

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(raw, dtype=np.uint32).astype(np.uint64)
        if sums:
            levels = [np.round(4 * np.log2(s.astype(float) + 1)).astype(np.uint8).tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["chunk", "levels"])

    levels = np.zeros(SKETCH, dtype=np.uint8)
    chunks = known.where("chunk is not null").select("chunk", "counts").repartition("chunk")
    for r in chunks.mapInArrow(total, "chunk int, levels binary").collect():
        levels[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["levels"], dtype=np.uint8)
    return levels


def partition_sizes(s: np.ndarray) -> bytes:
    """Sizes of a set's parts in equal ranges of the hash, about 8 shingles each; counts over 255 are cut."""
    bits = min(PART_BITS, max(0, int(len(s) // 8).bit_length() - 1))
    parts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) if bits else np.array([len(s)])
    return np.minimum(parts, 255).astype(np.uint8).tobytes()


def parities(s: np.ndarray) -> np.ndarray:
    """For 64 * PARITY_LONGS ranges of the hash, whether a set has an odd number of shingles there, as longs.

    Where two sets differ in that, one has a shingle that the other lacks.
    """
    width = 64 * PARITY_LONGS
    odd = np.bincount((s >> np.uint64(64 - (width - 1).bit_length())).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def suffix_sizes(parts: bytes, ahead: bytes, place: int) -> np.ndarray | None:
    """Part sizes of what follows place `place` in a set's order; None where counts were cut.

    ahead: the leading hash bits of the first shingles in that order.
    """
    sizes = np.frombuffer(parts, dtype=np.uint8).astype(np.int64)
    if sizes.max() == 255:
        return None
    gone = np.frombuffer(ahead, dtype=np.uint8)[: place + 1] >> (PART_BITS - (len(sizes).bit_length() - 1))
    return sizes - np.bincount(gone, minlength=len(sizes))


def suffix_overlap(x: np.ndarray, y: np.ndarray) -> int:
    """The most shingles that two suffixes of these part sizes can have in common."""
    if len(x) > len(y):
        x, y = y, x
    return int(np.minimum(x, y.reshape(len(x), -1).sum(axis=1)).sum())


def prefixes(docs: DataFrame, width: int, percent: int, levels: np.ndarray) -> DataFrame:
    """Per document its rarest shingles, as many as a linked document must share one of.

    All sets are ordered alike, by (frequency level, hash). central is the mean level: high for
    texts whose shingles many others have.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # SKETCH bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle_set(text, width)
                n = len(s)
                if n:
                    own = level[(s >> np.uint64(20)).astype(np.int64) & (SKETCH - 1)]
                    order = np.argsort(own, kind="stable")[: n - (percent * n + 99) // 100 + 1]
                    first = s[order]
                    ahead = (first >> np.uint64(64 - PART_BITS)).astype(np.uint8).tobytes()
                    rows.append((doc_id, n, xxhash.xxh3_128_digest(s.tobytes()), first.astype(np.int64), float(own.mean()), partition_sizes(s), ahead, parities(s)))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.float32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "n", "digest", "tokens", "central", "parts", "ahead", "parities"])

    return docs.mapInArrow(run, "node bigint, n bigint, digest binary, tokens array<bigint>, central float, parts binary, ahead binary, parities array<bigint>")


def possible(x: str, y: str, percent: int) -> Column:
    """Length and positional filters for a shingle at place pos in the order of both sets.

    They hold for the first shingle that two sets have in common: the overlap is then this one
    and, at most, the fewer of those that follow. Linked sets meet in the group of that first
    one, so a pair that fails in the group of a later one isn't lost.
    """
    nx, ny, px, py = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (x, y))
    most = 1 + F.least(nx - px - 1, ny - py - 1)
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & ((100 + percent) * most >= percent * (nx + ny))


def alike(x: str, y: str, percent: int) -> Column:
    """Whether two sets' parities leave room for the overlap they need: they differ by at least as many shingles as parities."""
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.p{k}").bitwiseXOR(F.col(f"{y}.p{k}"))) for k in range(PARITY_LONGS)), F.lit(0))
    return (100 + percent) * (both - apart) >= 2 * percent * both


def hopeful(y: str, least: str, percent: int) -> Column:
    """Whether a member can pass the positional filter with the shortest partner that it may have in its group."""
    n, pos = F.col(f"{y}.n"), F.col(f"{y}.pos")
    return (100 + percent) * (n - pos) >= percent * (n + F.greatest(F.col(least), F.ceil(percent * n / 100)))


def once(met: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs a, b of members, each once whatever the groups they met in and whichever came first.

    pa, pb: the least places that they met at, which for linked sets are those of the first
    shingle in common.
    """
    an, bn = F.col(f"{a}.node"), F.col(f"{b}.node")
    turned = an > bn
    low = F.when(turned, F.struct(bn.alias("node"), F.col(f"{b}.pos").alias("pos"))).otherwise(F.struct(an.alias("node"), F.col(f"{a}.pos").alias("pos")))
    high = F.when(turned, F.struct(an.alias("node"), F.col(f"{a}.pos").alias("pos"))).otherwise(F.struct(bn.alias("node"), F.col(f"{b}.pos").alias("pos")))
    flat = met.select(turned.alias("t"), low.alias("l"), high.alias("h")).select("t", F.col("l.node").alias("l"), F.col("h.node").alias("h"), F.col("l.pos").alias("pl"), F.col("h.pos").alias("ph"))
    one = flat.groupBy("l", "h").agg(F.max("t").alias("t"), F.min("pl").alias("pl"), F.min("ph").alias("ph"))
    way = lambda x, y: F.when(F.col("t"), F.col(x)).otherwise(F.col(y))
    return one.select(way("h", "l").alias("a"), way("l", "h").alias("b"), way("ph", "pl").alias("pa"), way("pl", "ph").alias("pb"))


def suffix_filter(pairs: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose suffixes after the first shingle in common leave room for the overlap they need."""
    left, right = (prefix.select(F.col("node").alias(k), *(F.col(c).alias(f"{c}{k}") for c in ("n", "parts", "ahead"))) for k in "ab")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for na, sa, aa, at_a, nb, sb, ab, at_b in zip(*(b.column(c).to_pylist() for c in ("na", "partsa", "aheada", "pa", "nb", "partsb", "aheadb", "pb")), strict=True):
                x, y = suffix_sizes(sa, aa, at_a), suffix_sizes(sb, ab, at_b)
                keep.append(x is None or y is None or (100 + percent) * (1 + suffix_overlap(x, y)) >= percent * (na + nb))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left.hint(GROWING), "a").join(right.hint(GROWING), "b").mapInArrow(run, "a bigint, b bigint")


def band(n: str, percent: int) -> Column:
    """The band of lengths that a set of n shingles is in; linked sets are in one band or in two that follow each other."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)


def open_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs x, y of members of one group (token, k) and of different components c, that pass the filters.

    Members of a group's largest component meet only the others, and all meet in blocks of about
    GROUP_BLOCK members, so that neither a large component nor a hot shingle is paired with itself in one task.
    The join itself compares lengths, places and parities, so that of members that merely share a
    passage hardly a pair comes out of it, let alone into a shuffle.
    """
    per = placed.groupBy("token", "k", "c").agg(F.count("*").alias("n"))
    groups = per.groupBy("token", "k").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("m")).where(F.col("most") < F.col("m"))
    blocks = lambda n: F.ceil(n / GROUP_BLOCK).cast("int")
    groups = groups.select("token", "k", "main", blocks(F.col("m") - F.col("most")).alias("few"), blocks(F.col("m")).alias("all"))
    rest = kept(placed.join(kept(groups, "groups").hint(GROWING), ["token", "k"]), "open")
    own = lambda n: F.pmod(F.xxhash64(F.lit(11), "y.node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = rest.where(F.col("c") != F.col("main")).withColumn("i", own("few")).withColumn("j", every("all")).select("token", "k", "i", "j", F.col("y").alias("x"), F.col("c").alias("d"))
    many = rest.withColumn("j", own("all")).withColumn("i", every("few")).select("token", "k", "i", "j", "y", "c", "main")
    one_way = (F.col("c") == F.col("main")) | (F.col("x.node") < F.col("y.node"))
    # sets of like length share two groups of a shingle: the pair counts in that of the longer one's own band
    one_band = F.col("k") == F.greatest(band("x.n", percent), band("y.n", percent))
    return few.join(many.hint(GROWING), ["token", "k", "i", "j"]).where((F.col("c") != F.col("d")) & one_way & one_band & possible("x", "y", percent) & alike("x", "y", percent))


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs a, b whose whole sets link, each compared once.

    Every member's set goes to its pivots, a; a pivot's set goes out once per FAN members, so
    that no task holds more than two sets, and no pivot's members have to be in one task.
    """
    fans = kept(pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fans")), "fans")
    salted = pairs.join(fans.hint(GROWING), "a").select(F.col("b").alias("doc"), F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), F.col("fans")).cast("int").alias("salt"), F.lit(1).alias("role"))
    own = fans.select(F.col("a").alias("doc"), F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("salt"), F.lit(0).alias("role"))
    roles = salted.unionByName(own).groupBy("doc").agg(F.collect_list(F.struct("pivot", "salt", "role")).alias("roles"))
    texts = docs.join(roles.hint(GROWING), F.col("doc_id") == F.col("doc")).select("doc", "text", "roles")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, where in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = shingle_set(text, width).tobytes()
                for s in range(0, len(where), 64):
                    some = where[s : s + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w["pivot"] for w in some], pa.int64()), pa.array([w["salt"] for w in some], pa.int32()), pa.array([w["role"] for w in some], pa.int32()), pa.array([doc] * len(some), pa.int64()), pa.array([raw] * len(some), pa.binary())],
                        names=["pivot", "salt", "role", "doc", "shingles"],
                    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            out_a, out_b = [], []
            for pivot, salt, role, doc, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.frombuffer(raw, dtype=np.uint64)
                if (pivot, salt) != at:
                    at, held = (pivot, salt), []
                if role == 0:
                    if not any(np.array_equal(s, p) for p in held):  # repeated rows of the pivot
                        held.append(s)
                    continue
                for p in held:
                    small, large = (s, p) if len(s) < len(p) else (p, s)
                    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    common = int(np.count_nonzero(large[place] == small))
                    if (100 + percent) * common >= percent * (len(s) + len(p)):
                        out_a.append(pivot)
                        out_b.append(doc)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    made = texts.mapInArrow(sets, "pivot bigint, salt int, role int, doc bigint, shingles binary")
    dealt = made.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role", "doc")
    return dealt.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles (long) and component_id of every row.

    A text's set holds its distinct `width`-word shingles, or its whole word sequence where it
    has fewer; two documents link when 100 * intersection >= percent * union; component_id is the
    least id reachable by links. Texts without words, null among them, have no set and link with
    nothing. Null ids come back with their set's size and a null component. Rows of one id are
    one document for the links. An empty table gives an empty table; other columns are not carried.

    Equal sets are one class, represented by its least id, so exact copies never meet. Classes
    share a group when they share a prefix shingle (the rarest ones, by a frequency sketch of
    all texts) and are of like length. In a group the most central member is compared with every
    other one, after length, positional and suffix filters; pairs of different components that
    are left in a group are then compared as well, so that no link between components is missed.
    Joins on keys that may be hot are between written tables, so that Spark can split them.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = kept(facts(docs, width), "facts")
    sized = known.where("chunk is null")
    own = sized.where("n > 0 and doc_id is not null")
    classes = kept(own.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    levels = frequency_levels(known)
    prefix = kept(prefixes(docs, width, percent, levels).join(classes.hint(GROWING), ["node", "digest"], "left_semi").drop("digest"), "prefix")

    postings = prefix.select("node", "n", "central", F.posexplode("tokens").alias("pos", "token"))
    live = kept(postings.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token"), "live")
    length = band("n", percent)
    spread = postings.join(live.hint(GROWING), "token").withColumn("k", F.explode(F.array(length, length + 1)))
    member = kept(spread.select("token", "k", F.struct("node", "n", "pos", "central").alias("y")), "members")
    pivots = member.groupBy("token", "k").agg(F.count("*").alias("m"), F.min("y.n").alias("least"), F.max_by("y", F.struct("y.central", -F.col("y.node"))).alias("x")).where("m > 1")
    pivots = kept(pivots, "pivots")
    discard(live)
    near = member.join(pivots.hint(GROWING), ["token", "k"]).where(hopeful("y", "least", percent) & (F.col("x.node") != F.col("y.node")) & possible("x", "y", percent))
    tried = kept(suffix_filter(once(near, "x", "y"), prefix, percent), "tried")
    links = kept(verified(tried, docs, width, percent).union(of_one_id(own, classes)), "links")
    found = components(links)

    # what the pivots left open: members of different components, neither of them the pivot
    rivals = pivots.where("m > 2").select("token", "k", "least", F.col("x.node").alias("pivot"))
    placed = member.join(rivals.hint(GROWING), ["token", "k"]).where((F.col("y.node") != F.col("pivot")) & hopeful("y", "least", percent))
    sides = prefix.select("node", *(F.col("parities")[k].alias(f"p{k}") for k in range(PARITY_LONGS))).join(found.hint(GROWING), "node", "left").withColumnRenamed("node", "__n")
    with_parities = F.struct("y.node", "y.n", "y.pos", *(f"p{k}" for k in range(PARITY_LONGS))).alias("y")
    placed = placed.join(sides.hint(GROWING), F.col("y.node") == F.col("__n")).select("token", "k", with_parities, F.coalesce("component", "y.node").alias("c"))
    again = once(open_pairs(kept(placed, "placed"), percent), "x", "y")
    done = tried.select(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("h"))
    again = again.join(done.hint(GROWING), (F.least("a", "b") == F.col("l")) & (F.greatest("a", "b") == F.col("h")), "left_anti")
    again = kept(suffix_filter(again, prefix, percent), "again")
    discard(member, pivots, prefix)
    if not again.isEmpty():
        more = kept(verified(again, docs, width, percent), "links")
        if not more.isEmpty():
            found = components(links.union(more))

    named = kept(classes.join(found.withColumnRenamed("node", "__n").hint(GROWING), F.col("node") == F.col("__n"), "left").select("digest", F.coalesce("component", "node").alias("component_id")), "named")
    linked = own.join(named.hint(GROWING), "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sized.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def of_one_id(own: DataFrame, classes: DataFrame) -> DataFrame:
    """Links a, b between the classes of the ids that are given with different sets."""
    nodes = own.join(classes.hint(GROWING), "digest").select("doc_id", "node")
    several = nodes.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where(F.col("a") < F.col("z")).select("doc_id", "a")
    return nodes.join(several.hint(GROWING), "doc_id").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct()
