"""Exact top-k search by inner product with bounds from segment statistics, coarse to fine."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlake.llm.scratch import bounded_batches, kept

#: Rows of a block of queries and of a block of candidates; one pair of blocks is one unit of work.
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 8192
#: Segments of the statistics that travel for all rows, and of those taken from the vectors of survivors.
COARSE, FINE = 4, 16
#: Queries whose survivors are scored by one matrix product.
TOGETHER = 64


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Per row the scaled segment means, then the scaled deviations: sqrt(L) * mean, sqrt(L) * deviation.

    For two vectors q and x of segments of length L, q.x = sum of L * mean * mean + the inner
    product of what is left, and that is at most L * deviation * deviation (Cauchy-Schwarz).
    """
    n, d = v.shape
    cuts = np.linspace(0, d, min(segments, d) + 1).astype(int)
    length = np.diff(cuts).astype(float)
    total = np.add.reduceat(v, cuts[:-1], axis=1)
    square = np.add.reduceat(v * v, cuts[:-1], axis=1)
    mean = total / np.sqrt(length)
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0))], axis=1)


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of the vectors that these statistics are of.

    By |q - x|^2 = |q|^2 + |x|^2 - 2 q.x the upper one is a lower bound of their distance.
    The slack is far over what rounding can lose.
    """
    half = a.shape[1] // 2
    near, far = a[:, :half] @ b[:, :half].T, a[:, half:] @ b[:, half:].T
    slack = 1e-6 + 1e-9 * np.sqrt((a * a).sum(axis=1).max(initial=0) * (b * b).sum(axis=1).max(initial=0))
    return near - far - slack, near + far + slack


def is_plain(codes: np.ndarray) -> np.ndarray:
    """Rows of which any two have an inner product that doubles hold exactly."""
    return codes.shape[1] * np.square(np.abs(codes).max(axis=1, initial=0)) < 2.0**52


def whole(v: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of every component, as Python's integers of any size."""
    return np.array([[math.floor(Fraction(x) * Fraction(scale)) for x in row] for row in v.tolist()], dtype=object).reshape(v.shape)


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest scores of each row, and of all that tie with the last of them in id as well; ids break ties."""
    rows, columns = [], []
    for i in range(len(scores)):
        some = np.flatnonzero(allowed[i])
        s = scores[i, some]
        if len(s) > k:
            above = s >= np.partition(s, len(s) - k)[len(s) - k]
            some, s = some[above], s[above]
        order = sorted(range(len(some)), key=lambda j: (-s[j], ids[some[j]]))[:k]
        rows.append(np.full(len(order), i))
        columns.append(some[order])
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, int), np.zeros(0, int))


def survivors_top(q: np.ndarray, x: np.ndarray, xid: np.ndarray, floor: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and score of the k best of each query among plain candidates, less those that can't reach its floor."""
    _, upper = bounds(statistics(q, FINE), statistics(x, FINE))
    seeds = min(k + 1, len(x))
    # the best by this bound are scored exactly: their k-th score is a floor as well
    near = np.argpartition(-upper, seeds - 1, axis=1)[:, :seeds]
    score = np.einsum("qd,qsd->qs", q, x[near])
    score[~np.take_along_axis(other, near, axis=1)] = -np.inf
    if seeds > k:
        floor = np.maximum(floor, np.sort(score, axis=1)[:, -k])
    alive = other & (upper >= floor[:, None])
    order = np.argsort(alive @ np.arange(len(x)), kind="stable")  # queries of like survivors come together
    out = []
    for s in range(0, len(q), TOGETHER):
        rows = order[s : s + TOGETHER]
        columns = np.flatnonzero(alive[rows].any(axis=0))
        exact = q[rows] @ x[columns].T
        r, c = best(exact, xid[columns], alive[np.ix_(rows, columns)], k)
        out.append((rows[r], columns[c], exact[r, c].astype(np.int64)))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def block_top(q: dict, x: dict, scale: float, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Triples of query place, candidate place and score: the k best of each query, plain rows and others apart.

    q and x: id, row, v (the vectors); q also floor. Rows of one `row` never meet.
    """
    codes_q, codes_x = np.floor(q["v"] * scale), np.floor(x["v"] * scale)
    plain_q, plain_x = is_plain(codes_q), is_plain(codes_x)
    out = []
    at_q, at_x = np.flatnonzero(plain_q), np.flatnonzero(plain_x)
    for s in range(0, len(at_q) if len(at_x) else 0, 256):
        some = at_q[s : s + 256]
        other = q["row"][some][:, None] != x["row"][at_x][None, :]
        a, b, score = survivors_top(codes_q[some], codes_x[at_x], x["id"][at_x], q["floor"][some], other, k)
        out.append((some[a], at_x[b], score))
    for some, those in ((np.flatnonzero(~plain_q), np.arange(len(codes_x))), (at_q, np.flatnonzero(~plain_x))):
        if len(some) and len(those):  # what doubles can't hold is scored in whole numbers; a score beyond 64 bits fails
            exact = whole(q["v"][some], scale) @ whole(x["v"][those], scale).T
            a, b = best(exact, x["id"][those], q["row"][some][:, None] != x["row"][those][None, :], k)
            out.append((some[a], those[b], np.array(exact[a, b].tolist(), dtype=np.int64)))
    return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1 if len(flat) else 1).astype(np.float64)


def _statistics_of(scale: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("d").to_numpy()
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                codes = np.floor(matrix(part.column("v")) * scale)
                plain = is_plain(codes)
                s = [row if p else None for row, p in zip(statistics(np.where(plain[:, None], codes, 0.0), COARSE).tolist(), plain, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "d", "query")), pa.array(s, pa.list_(pa.float64()))], names=["row", "d", "query", "s"])

    return run


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (int, from 1), vec_id and score (long) of each query's k best candidates.

    Components are floor(scale * x) of the double x; the score is the inner product of these
    integers; ties go to the smaller vec_id. Queries are the rows whose id is divisible by
    `query_every`, candidates all rows but the query's own: rows of one id are rows like others,
    each its own query and candidate. Vectors that are null, empty, or hold null or non-finite
    components take no part, nor do null ids. Vectors meet only vectors of their own length.
    Scores are exact at any size of components; one that 64 bits can't hold fails the task.
    With fewer than k candidates all are returned; an empty table gives an empty table; other
    columns of `vectors` are not carried.

    Queries are a stated share of all rows, so they are dealt in blocks, as candidates are; a
    pair of blocks is one task's unit. First only statistics of COARSE segments travel: the k-th
    highest lower bound of all candidates is a query's floor. They travel again with the floors,
    and a candidate stays for a block of queries where its upper bound reaches one's floor.
    Then only the vectors that stay travel; bounds of FINE segments prune again, and what is
    left is scored exactly. The k best of each block pair are ranked per query.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    fine = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    clean = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fine)
    clean = clean.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("d"))
    # written, so that a row keeps its number
    clean = kept(clean.withColumns({"row": F.monotonically_increasing_id(), "query": F.col("id") % query_every == 0}), "vectors")
    sizes = clean.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    n_q, n_x = max(1, -(-sizes["q"] // QUERY_BLOCK)), max(1, -(-sizes["n"] // CANDIDATE_BLOCK))
    hashed = F.xxhash64(F.lit(3), "row")
    own_q, own_x = F.pmod(hashed, F.lit(n_q)).cast("int"), F.pmod(hashed, F.lit(n_x)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["i", "j", "d"]

    def as_query(df: DataFrame) -> DataFrame:
        asked = df.where("query").withColumn("i", own_q).withColumn("j", each(n_x)).drop("query")
        return asked.select(*(F.col(c).alias(c) for c in asked.columns))  # columns of their own, since the table meets itself

    stats = kept(clean.mapInArrow(_statistics_of(scale), "row bigint, d int, query boolean, s array<double>"), "statistics")
    candidates = stats.withColumn("j", own_x).withColumn("i", each(n_q)).drop("query")

    def floors_of(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.filter(left.column("s").is_valid()), right.filter(right.column("s").is_valid())
        out = [(np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            own, others, a, b = left.column("row").to_numpy(), right.column("row").to_numpy(), matrix(left.column("s")), matrix(right.column("s"))
            for s in range(0, len(a), 512):
                low, _ = bounds(a[s : s + 512], b)
                low[own[s : s + 512][:, None] == others[None, :]] = -np.inf
                low = -np.partition(-low, min(k, low.shape[1]) - 1, axis=1)[:, :k]
                out.append((np.repeat(own[s : s + 512], low.shape[1]), low.reshape(-1)))
        row, low = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"row": row, "low": low})

    lows = as_query(stats).groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(floors_of, "row bigint, low double")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("low")))
    floors = kept(lows.withColumn("p", place).where(F.col("p") == k).select(F.col("row").alias("r"), F.col("low").alias("floor")), "floors")
    with_floor = lambda df: df.join(floors, F.col("row") == F.col("r"), "left").drop("r").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))

    def stay(left: pa.Table, right: pa.Table) -> pa.Table:
        alive = np.zeros(right.num_rows, dtype=bool)
        if left.num_rows and right.num_rows:
            known_q, known_x = (t.column("s").combine_chunks().is_valid().to_numpy(zero_copy_only=False) for t in (left, right))
            alive = ~known_x | (not known_q.all())
            a, b = (matrix(t.filter(pa.array(known)).column("s")) for t, known in ((left, known_q), (right, known_x)))
            floor, at = left.column("floor").to_numpy()[known_q], np.flatnonzero(known_x)
            for s in range(0, len(a) if len(a) and len(b) else 0, 512):
                _, high = bounds(a[s : s + 512], b)
                alive[at[(high >= floor[s : s + 512][:, None]).any(axis=0)]] = True
        some = right.filter(pa.array(alive))
        return pa.table({"r": some.column("row"), "i": some.column("i")})

    stays = with_floor(as_query(stats)).groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(stay, "r bigint, i int")

    def exact(left: pa.Table, right: pa.Table) -> pa.Table:
        def side(t: pa.Table) -> dict:
            return {"id": t.column("id").to_numpy(), "row": t.column("row").to_numpy(), "v": matrix(t.column("v"))}

        a, b, score = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, np.int64)]
        q, x = side(left) | {"floor": left.column("floor").to_numpy()}, side(right)
        if left.num_rows and right.num_rows:
            found = block_top(q, x, scale, k)
            a, b, score = (list(c) for c in zip(*found, strict=True)) if found else (a, b, score)
        a, b, score = (np.concatenate(c) for c in (a, b, score))
        return pa.table({"row": q["row"][a], "query_id": q["id"][a], "vec_id": x["id"][b], "score": score})

    moved = clean.join(stays, F.col("row") == F.col("r")).drop("r", "query").withColumn("j", own_x)
    asked = with_floor(as_query(clean))
    found = asked.groupBy(*keys).cogroup(moved.groupBy(*keys)).applyInArrow(exact, "row bigint, query_id bigint, vec_id bigint, score bigint")
    by_score = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
