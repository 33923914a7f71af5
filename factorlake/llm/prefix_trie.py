"""The trie of conversations by their turns: which share a prefix, and what sharing it saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.llm.scratch import bounded_batches, kept

#: Turns of a block, the unit by which conversations are grouped first.
BLOCK_TURNS = 4
#: Rows of a key that one window holds, where positions are gapless; longer keys are parted and the parts' sums carried on.
PART_ROWS = 1024
#: Conversation ids of one node that are joined into one text at a time.
ENDS = 1024
#: A node: the turns from the start up to it as two 64-bit hashes, each the xor of its turns' hashes with their places, and how many they are.
NODE = ["u", "v", "depth"]
START = Window.unboundedPreceding


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, at (long, from 0), a, b (128 bits of role and text) and n_bytes (UTF-8 of the text) of every turn.

    Turns come by their number, null first, then role, then text; rows without a conversation
    take no part; null roles and texts are empty. A conversation's turns are ordered in parts of
    PART_ROWS numbers, so that one of any length is no task's alone, unless its turns have one
    number, or none.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / PART_ROWS), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digests = [F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), F.reverse("text"), "role").alias("b")]
    ranked = kept(rows.select("conv_id", "part", (F.row_number().over(inside) - 1).cast("long").alias("at"), *digests, F.octet_length("text").cast("long").alias("n_bytes")), "ranked")
    sizes = ranked.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(START, -1))
    # most conversations have one part, whose first place is 0
    firsts = sizes.withColumn("first", first).where("first > 0").select("conv_id", "part", "first")
    return ranked.join(firsts, ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("first", F.lit(0))).alias("at"), "a", "b", "n_bytes")


def _before(df: DataFrame, key: str, at: str, total, **columns: str) -> DataFrame:
    """df with, for each output name, `total` of that column over the rows of the key before this one; 0 where there are none.

    The key's rows are taken in parts of PART_ROWS places, and the parts' totals carried on.
    """
    df = df.withColumn("__part", F.floor(F.col(at) / PART_ROWS))
    inside = Window.partitionBy(key, "__part").orderBy(at).rowsBetween(START, -1)
    over = Window.partitionBy(key).orderBy("__part").rowsBetween(START, -1)
    parts = df.groupBy(key, "__part").agg(*(total(c).alias(f"__{o}") for o, c in columns.items()))
    parts = parts.select(key, "__part", *(total(f"__{o}").over(over).alias(f"__{o}") for o in columns)).where("__part > 0")
    both = df.withColumns({o: F.coalesce(total(c).over(inside), F.lit(0)) for o, c in columns.items()}).join(parts, [key, "__part"], "left")
    joined: dict[str, Column] = {}
    for o in columns:
        rest = F.coalesce(f"__{o}", F.lit(0))
        joined[o] = F.col(o).bitwiseXOR(rest) if total is F.bit_xor else F.col(o) + rest
    return both.withColumns(joined).drop("__part", *(f"__{o}" for o in columns))


def _blocks(turns: DataFrame) -> DataFrame:
    """conv_id, block, pu, pv (the node before it) and turns, an array of the nodes in it: u, v (of the block alone), depth, n_bytes."""
    tagged = turns.select(
        "conv_id", "at", "n_bytes", F.floor(F.col("at") / BLOCK_TURNS).alias("block"),
        F.xxhash64("at", "a", "b").alias("x"), F.xxhash64(F.lit(11), "b", "a", "at").alias("y"),
    )
    so_far = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(START, 0)
    nodes = tagged.select("conv_id", "block", F.struct((F.col("at") + 1).alias("depth"), F.bit_xor("x").over(so_far).alias("u"), F.bit_xor("y").over(so_far).alias("v"), "n_bytes").alias("t"))
    # at most BLOCK_TURNS of them
    blocks = nodes.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    last = F.element_at("turns", -1)
    return _before(blocks.withColumns({"x": last["u"], "y": last["v"]}), "conv_id", "block", F.bit_xor, pu="x", pv="y").select("conv_id", "block", "pu", "pv", "turns")


def _refined(blocks: DataFrame, *carried: str) -> DataFrame:
    """The nodes of each row's block, with their parents and the columns carried."""
    out = blocks.select("pu", "pv", *carried, "turns", F.posexplode("turns").alias("i", "t"))
    earlier = F.get("turns", F.col("i") - 1)  # null before the first
    up = lambda p, c: F.col(p).bitwiseXOR(F.coalesce(earlier[c], F.lit(0))).alias(f"up_{c}")
    own = lambda p, c: F.col(p).bitwiseXOR(F.col(f"t.{c}")).alias(c)
    return out.select(own("pu", "u"), own("pv", "v"), "t.depth", "t.n_bytes", up("pu", "u"), up("pv", "v"), *carried)


def _nodes(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """NODE, n_bytes of the last text, up_u and up_v (the parent), n_convs and conv_id of each node, the root included.

    Conversations are counted by whole blocks first. A block that is the only one after its
    predecessors has the same members at each of its turns; only where siblings diverge are
    the turns in their blocks grouped.
    """
    groups = kept(blocks.groupBy("block", "pu", "pv", "turns").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")), "blocks")
    kinds = groups.where("block > 0").groupBy("block", "pu", "pv").agg(F.count("*").alias("kinds"))
    marked = kept(groups.where("block > 0").join(kinds, ["block", "pu", "pv"]), "kinds")
    alone = _refined(marked.where("kinds = 1"), "n_convs", "conv_id")
    apart = _refined(groups.where("block = 0").unionByName(marked.where("kinds > 1").drop("kinds")), "n_convs", "conv_id")
    apart = apart.groupBy(*NODE, "n_bytes", "up_u", "up_v").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    nothing = {c: F.lit(0).cast("long") for c in (*NODE, "n_bytes", "up_u", "up_v")}
    return alone.unionByName(apart).unionByName(root.withColumns(nothing))


def _ends(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """NODE, ends_sha256: the SHA-256 of the ids of the conversations that end at each node, ascending, with commas.

    Ids are joined in ranges of ENDS, and the ranges' texts hashed one after another as they
    stream by, so that a node's ids are never held together.
    """
    last = F.element_at("turns", -1)
    place = F.struct(F.col("pu").bitwiseXOR(last["u"]).alias("u"), F.col("pv").bitwiseXOR(last["v"]).alias("v"), last["depth"].alias("depth"))
    ends = blocks.groupBy("conv_id").agg(F.max_by(place, "block").alias("e"))
    ends = convs.select("conv_id").join(ends, "conv_id", "left").select("conv_id", *(F.coalesce(F.col(f"e.{c}"), F.lit(0)).cast("long").alias(c) for c in NODE))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    texts = ends.groupBy(*NODE, F.floor(F.col("conv_id") / ENDS).alias("range")).agg(ids.alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, done = None, None, []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            *keys, hashes = ([r[k] for r in rows] for k in range(4))
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in keys), pa.array(hashes, pa.string())], names=[*NODE, "ends_sha256"])

        for b in batches:
            for *own, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if own == node:
                    digest.update(b"," + text.encode())
                else:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = own, hashlib.sha256(text.encode())
            if done:
                yield out(done)
                done = []
        if node:
            yield out([(*node, digest.hexdigest())])

    dealt = texts.repartition(*NODE).sortWithinPartitions(*NODE, "range").select(*NODE, "ids")
    return dealt.mapInArrow(run, "u bigint, v bigint, depth bigint, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row per distinct sequence of first turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    `turns` is what ordered() returns: rows conv_id, at (0, 1, 2 ... in each conversation), a, b,
    n_bytes. `convs` (conv_id, each once) are all conversations, those without turns included;
    where it is left out, those of the turns.

    A node's members are the conversations that begin with it; conv_id is the least of them and
    stands for the node, together with depth; the root, of depth 0, has no turns and no
    parent_conv_id. n_children are the nodes one turn on, n_leaves the childless ones in its
    subtree (itself, if it has none). saved_tokens sums (n_convs - 1) * n_bytes over its subtree.
    ends_sha256 is the SHA-256 of the members that end there, as decimal numbers, ascending, with
    commas between. Without conversations there are no rows.

    A node is owned by its least member, and what a conversation owns is one path down to its
    end. So sums over a subtree are sums, over its members, of what each owns, less what the
    node's owner owns above it: no node is ever spread over all its ancestors.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    convs = kept(turns.select("conv_id").distinct() if convs is None else convs.select("conv_id"), "convs")
    blocks = kept(_blocks(turns), "chained")
    nodes = kept(_nodes(blocks, convs), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("up_u").alias("u"), F.col("up_v").alias("v"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, NODE, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "weight": (F.col("n_convs") - 1) * F.col("n_bytes")})
    counted = kept(_before(counted, "conv_id", "depth", F.sum, above="weight"), "counted")
    owned = counted.groupBy("conv_id").agg(F.sum("weight").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaves")).where("owned > 0 OR leaves > 0")
    owned = kept(owned, "owned")
    # of all members: those of the root are all there are
    of_blocks = blocks.join(owned, "conv_id").groupBy("pu", "pv", "turns").agg(F.sum("owned").alias("owned"), F.sum("leaves").alias("leaves"))
    of_nodes = _refined(of_blocks, "owned", "leaves").groupBy(*NODE).agg(F.sum("owned").alias("owned"), F.sum("leaves").alias("leaves"))
    of_root = owned.agg(F.sum("owned").alias("owned"), F.sum("leaves").alias("leaves")).where("leaves > 0").withColumns({c: F.lit(0).cast("long") for c in NODE})
    sums = kept(of_nodes.unionByName(of_root), "sums")
    parents = counted.where("n_children > 0").select(F.col("u").alias("up_u"), F.col("v").alias("up_v"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    named = kept(counted.join(parents, ["up_u", "up_v", "depth"], "left"), "named")
    nobody = hashlib.sha256(b"").hexdigest()
    return named.join(sums, NODE).join(_ends(blocks, convs), NODE, "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("owned") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"),
    )
