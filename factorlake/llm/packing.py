"""Token-budget batches from optimal length buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.llm.scratch import kept
from factorlake.llm.slots import numbered

def optimal_boundaries(tops: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """Bucket tops that minimise padding: the sum over rows of (bucket top - length).

    Dynamic programming over the sorted histogram: best[i] after j rounds is the least cost of
    the first i lengths in j buckets. The cost of a bucket is convex in its start (the quadrangle
    inequality holds), so the best start grows with i and each round is filled by divide and
    conquer, O(k m log m), one level of all halves at a time.
    """
    m, k, never = len(tops), min(k, len(tops)), np.int64(2) ** 62
    tops, counts = tops.astype(np.int64), counts.astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    mass = np.concatenate([[0], np.cumsum(counts * tops)])
    best = np.full(m + 1, never)
    best[0] = 0
    starts = []
    for _ in range(k):
        layer, start = np.full(m + 1, never), np.zeros(m + 1, dtype=np.int64)
        lo, hi, first, last = (np.array([x]) for x in (1, m, 0, m - 1))
        while len(lo):
            mid = (lo + hi) // 2
            tries = np.minimum(mid - 1, last) - first + 1
            begin = np.cumsum(tries) - tries
            s = np.arange(tries.sum()) - np.repeat(begin - first, tries)
            i = np.repeat(mid, tries)
            cost = np.where(best[s] < never, best[s] + tops[i - 1] * (rows[i] - rows[s]) - (mass[i] - mass[s]), never)
            layer[mid] = np.minimum.reduceat(cost, begin)
            hit = np.flatnonzero(cost == np.repeat(layer[mid], tries))
            _, one = np.unique(np.searchsorted(begin, hit, side="right"), return_index=True)
            at = s[hit[one]]
            start[mid] = at
            lo, hi, first, last = np.concatenate([lo, mid + 1]), np.concatenate([mid - 1, hi]), np.concatenate([first, at]), np.concatenate([at, last])
            some = lo <= hi
            lo, hi, first, last = lo[some], hi[some], first[some], last[some]
        starts.append(start)
        best = layer
    out, i = [], m
    for start in reversed(starts):
        out.append(int(tops[i - 1]))
        i = start[i]
        if i == 0:
            break
    return out[::-1]


def pack(df: DataFrame, id_cols: list[str], length: Column, n_buckets: int = 16, budget: int = 65_536, seed: int = 23) -> DataFrame:
    """Put every row into a batch of its length bucket; batches hold at most `budget` padded tokens.

    Returns the id columns, length (long), bucket (int, from 0, by length), padded_length (long,
    the bucket's top), batch (long, gapless from 0 inside a bucket) and slot (int, place in
    the batch). All rows of a batch are padded to padded_length. Buckets minimise the padding of
    all rows of at most `budget` tokens; a longer row can share no batch, so it is alone in one,
    unpadded, in the bucket after the last. Null lengths count as 0. Rows equal in all id columns are
    interchangeable; an empty table gives an empty table; other columns of `df` are not carried,
    and id columns may not have the names of the columns that are added.

    The global histogram of lengths (at most budget + 1 rows) goes to the driver, which finds the
    buckets; every row then finds its bucket from at most n_buckets numbers. Inside a bucket,
    rows are numbered in random order in blocks, never in one task, and numbers become batches.
    """
    lengths = kept(df.select(*id_cols, F.coalesce(length.cast("long"), F.lit(0)).alias("length")), "lengths")
    fits = F.col("length") <= budget
    histogram = lengths.groupBy(F.when(fits, F.col("length")).alias("top")).agg(F.count("*").alias("n")).orderBy("top").collect()
    tops, counts = (np.array([r[c] for r in histogram if r["top"] is not None], dtype=np.int64) for c in ("top", "n"))
    edges = F.array(*(F.lit(e).cast("long") for e in (optimal_boundaries(tops, counts, n_buckets) if len(tops) else [0])))
    bucket = F.when(fits, F.size(F.filter(edges, lambda e: e < F.col("length")))).otherwise(F.size(edges))
    top = F.when(fits, F.element_at(edges, F.least(F.col("bucket") + 1, F.size(edges)))).otherwise(F.col("length"))
    placed = lengths.withColumn("bucket", bucket).withColumn("padded_length", top)
    ranked = numbered(placed, "bucket", F.xxhash64(F.lit(seed), *id_cols, "length"), "__n", sum(r["n"] for r in histogram), ties=[*id_cols, "length"])
    per_batch = F.when(fits, F.floor(F.lit(budget) / F.greatest(F.col("padded_length"), F.lit(1)))).otherwise(1).cast("long")
    return ranked.select(
        *id_cols, "length", F.col("bucket").cast("int"), "padded_length",
        F.floor(F.col("__n") / per_batch).cast("long").alias("batch"), (F.col("__n") % per_batch).cast("int").alias("slot"),
    )


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+"))).cast("long")
