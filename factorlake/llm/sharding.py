"""Uniform sharding by an exact communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.llm.scratch import kept
from factorlake.llm.slots import numbered

#: Source partitions are at most this many, so that the matrix stays small at every input size.
MAX_PARTS = 4096


def communication_matrix(part_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """Rows that each source partition sends to each shard.

    Row by row a multivariate hypergeometric draw from the room that is left in the shards:
    the law that a uniform shuffle of all rows has, with the exact sizes on both sides.
    """
    rng = np.random.default_rng(seed)
    room = np.array(shard_rows, dtype=np.int64)
    matrix = np.zeros((len(part_rows), len(room)), dtype=np.int64)
    for i, n in enumerate(part_rows):
        # numpy's marginal method allows urns of under 10^9; larger ones are drawn shard by shard, by the same law
        if room.sum() < 10**9:
            matrix[i] = rng.multivariate_hypergeometric(room, n, method="marginals")
        else:
            matrix[i] = _large_draw(rng, room, n)
        room -= matrix[i]
    return matrix


def _large_draw(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """A draw from over 10^9 rows: hypergeometric shard by shard, each given those before."""
    left, rows, out = int(room.sum()), int(n), np.zeros_like(room)
    for j, r in enumerate(room.tolist()):
        out[j] = _hypergeometric(rng, r, left - r, rows)
        rows, left = rows - int(out[j]), left - r
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good + bad are good, by inversion.

    Weights are running products of the law's ratios from its mode outwards, over 12 deviations
    and 100 to either side: what lies beyond is less than a double's uniform draw can tell.
    """
    lo, hi, total = max(0, n - bad), min(n, good), good + bad
    if lo == hi:
        return lo
    mode = min(max((n + 1) * (good + 1) // (total + 2), lo), hi)
    width = 100 + int(12 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5)
    k = np.arange(max(lo, mode - width), min(hi, mode + width) + 1, dtype=np.float64)
    # the weight at k + 1 over that at k
    steps = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    at = mode - int(k[0])
    logs = np.concatenate([-np.cumsum(steps[:at][::-1])[::-1], [0.0], np.cumsum(steps[at:])])
    below = np.cumsum(np.exp(logs))
    return int(k[0]) + int(np.searchsorted(below, rng.random() * below[-1], side="right"))


def random_key(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def shuffle_to_shards(df: DataFrame, id_cols: list[str], n_shards: int, seed: int = 17, part_rows: int = 50_000) -> DataFrame:
    """Deal all rows to shards 0..n_shards-1 by a uniform random permutation of fixed seed.

    Law `rows`: shard sizes differ by at most one row. Returns all columns of `df`, shard (int)
    and slot (long, gapless from 0 in each shard).
    `id_cols` tell rows apart; rows equal in all of them are interchangeable, nulls are values
    like others. An empty table gives an empty table. Columns named shard and slot are
    replaced, and so are names that begin with two underscores.

    Steps: rows fall into source partitions by a hash of the id columns and are counted there
    (with map-side combining); the driver draws the matrix of partition-to-shard counts from
    those at most 4,096 counts; rows are put in random order inside their partition and dealt
    to shards by the matrix row; each shard is put in random order again, in blocks, which
    gives the slots.
    """
    spark = df.sparkSession
    df = df.select(*(c for c in df.columns if not c.startswith("__") and c not in ("shard", "slot")))
    total = df.count()
    n_parts = max(1, min(MAX_PARTS, -(-total // part_rows)))
    dealt = df.withColumn("__part", F.pmod(random_key(seed, *id_cols), F.lit(n_parts)).cast("int"))
    counted = {r["__part"]: r["n"] for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # at most MAX_PARTS rows
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    parts = sorted(counted)
    matrix = communication_matrix([counted[p] for p in parts], sizes, seed)
    ends = spark.createDataFrame([(p, row) for p, row in zip(parts, np.cumsum(matrix, axis=1).tolist(), strict=True)], "__p int, __ends array<long>")
    # at most 4,096 rows of n_shards numbers each
    local = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy(random_key(seed + 1, *id_cols), *id_cols)))
    sent = local.join(F.broadcast(ends), F.col("__part") == F.col("__p")).withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__r"))))
    sent = kept(sent.drop("__part", "__p", "__ends", "__r"), "dealt")
    return numbered(sent, "shard", random_key(seed + 2, *id_cols), "slot", max(sizes, default=0), ties=id_cols)
