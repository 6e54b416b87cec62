"""Exact top-k by inner product with the no-random-access algorithm, block by block.

Components become integers, floor(scale * x). Candidates are dealt into blocks and so are queries; a block of queries meets a
block of candidates in one task. There each dimension is a list sorted by its component. The lists are read from the end that a
query's weight asks for, deeper in each round; what has been read gives every candidate a lower and an upper bound on its
score, the last value read and the list's far end standing for what hasn't. Candidates whose upper bound is below the query's
threshold are outsiders. Reading stops when few others are left; their final scores are resolved in whole numbers.

A query's threshold is the k-th best lower bound seen. A block's candidates come in slices that double: the k best scores of those
before are the threshold for the next, so that only the first, small one is read to its end. Each block of queries first meets one
block of candidates, its home; the k-th best score from there is the threshold that it brings to all other blocks.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Shorter vectors count as
if filled up with zeros. A score beyond a long becomes the nearest long. Ties go to the smaller id. Rows that share an id are
all candidates, of other ids' queries; as a query the smallest of them counts. Empty tables, and fewer candidates than k, give
fewer rows. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticktide.llm import common

QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 4096
#: Queries of a block that are answered at once.
AT_ONCE = 1024
#: Share of a block's lists that is read in each round, and the share of candidates left at which scores are resolved.
DEPTHS, FEW = (1 / 4, 1 / 2, 5 / 8, 3 / 4, 1), 0.1
#: Candidates of a block's first slice, at least; it has no threshold from the block.
FIRST = 128
LARGEST, SMALLEST = (1 << 63) - 1, -(1 << 63)

def matrix(column: pa.ChunkedArray, width: int, scale: float) -> np.ndarray:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(float))
    return out


class Lists:
    """A block of candidates, one to a row of x, as a sorted list for each dimension."""

    def __init__(self, x: np.ndarray):
        order = np.argsort(-x, axis=0, kind="stable")
        self.x, self.rank = x, np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(x))[:, None], axis=0)
        self.falling = np.take_along_axis(x, order, axis=0)
        self.longest = float(np.sqrt((x * x).sum(axis=1).max(initial=0)))

    def bounds(self, q: np.ndarray, depth: int, upper: bool = True) -> np.ndarray:
        """The largest, or the smallest, score that each query may have with each candidate after `depth` entries of each list."""
        n = len(self.x)
        top, bottom = self.rank < depth, self.rank >= n - depth  # read so far from either end
        weights = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
        high, low = (self.falling[depth - 1], self.falling[n - depth]) if upper else (self.falling[-1], self.falling[0])
        return weights @ np.concatenate([np.where(top, self.x, high), np.where(bottom, self.x, low)], axis=1).T


def resolved(q: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The scores of pairs as longs, from whole numbers."""
    if not len(rows):
        return np.zeros(0, np.int64)
    if x.shape[1] * max(1.0, np.abs(q).max()) * max(1.0, np.abs(x).max()) < 1 << 62:
        qi, xi = q.astype(np.int64), x.astype(np.int64)
        return np.concatenate([np.einsum("ij,ij->i", qi[rows[i : i + 65536]], xi[columns[i : i + 65536]]) for i in range(0, len(rows), 65536)])
    whole = lambda row: [int(v) for v in row]
    qi, xi = {r: whole(q[r]) for r in np.unique(rows).tolist()}, {c: whole(x[c]) for c in np.unique(columns).tolist()}
    scores = (sum(a * b for a, b in zip(qi[r], xi[c])) for r, c in zip(rows.tolist(), columns.tolist()))
    return np.array([max(SMALLEST, min(LARGEST, v)) for v in scores], np.int64)


def block_top(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, thresholds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(query, candidate, score) of what may be among a query's k best of all, as numbers of rows and exact scores, and the share
    of the lists that was read. thresholds: scores that k candidates elsewhere reach; -inf without. The block's candidates come in
    slices, each as many as all before it; the k best scores of those before are thresholds too."""
    if len(x) == 0 or len(q) == 0:
        return (*(np.zeros(0, np.int64),) * 3, 0.0)
    thresholds = np.full(len(q), -np.inf) if thresholds is None else thresholds
    ends = [len(x)]
    while ends[0] > 2 * FIRST:
        ends.insert(0, ends[0] // 2)
    found, read = [], 0.0
    slices = [Lists(x[a:b]) for a, b in zip([0, *ends], ends)]
    for i in range(0, len(q), AT_ONCE):
        some, least, begin, at = q[i : i + AT_ONCE], thresholds[i : i + AT_ONCE], 0, 0
        best = np.full((len(some), k), -np.inf)
        for lists in slices:
            n = len(lists.x)
            known = np.maximum(least, best.min(axis=1))
            rows, columns, scores, depth, begin = _slice_top(some, q_ids[i : i + AT_ONCE], lists, x_ids[at : at + n], k, known, begin)
            found.append((rows + i, columns + at, scores))
            read += depth * n / len(x) * len(some) / len(q)
            made = np.full((len(some), n), -np.inf)
            made[rows, columns] = scores
            best = np.partition(np.concatenate([best, made], axis=1), -k, axis=1)[:, -k:]
            at += n
    return *(np.concatenate(c) for c in zip(*found)), read


def _slice_top(q: np.ndarray, q_ids: np.ndarray, lists: Lists, x_ids: np.ndarray, k: int, least: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """What of a slice reaches the thresholds, with the share of its lists that was read, and at which depth the next slice may begin:
    one before that at which this one ended. Lower bounds are asked for only while a query has no threshold."""
    n, x = len(x_ids), lists.x
    slack = (4 * x.shape[1] + 8) * 2.0**-52 * np.sqrt((q * q).sum(axis=1)) * lists.longest + np.abs(np.where(np.isfinite(least), least, 0)) * 2.0**-51  # of sums in doubles
    own = q_ids[:, None] == x_ids[None, :]
    left = ~own
    for place in range(begin, len(DEPTHS)):
        depth = max(1, int(n * DEPTHS[place]))
        if not np.isfinite(least).all() and k <= n:
            lower = lists.bounds(q, depth, upper=False)
            lower[own] = -np.inf
            least = np.maximum(least, np.partition(lower, -k, axis=1)[:, -k])
        least = np.minimum(least, float(LARGEST))
        least[least <= float(SMALLEST)] = -np.inf
        left &= lists.bounds(q, depth) >= (least - slack)[:, None]
        if left.sum() <= max(FEW * left.size, 2 * k * len(q)):
            break
    rows, columns = np.nonzero(left)
    return rows, columns, resolved(q, x, rows, columns), depth / n, max(0, place - 1)


MET = "query_id long, vec_id long, score long, read double"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. queries: the rows of vectors that ask."""
    found = met(vectors, queries, k, scale, id_column, vector_column, query_block, candidate_block)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def met(vectors: DataFrame, queries: DataFrame, k: int, scale: float, id_column: str, vector_column: str, query_block: int, candidate_block: int) -> DataFrame:
    """query_id, vec_id, score of the k best of each block that may be among the k best of all; read: the share of the block's
    lists that was read for it."""
    usable = F.col("v").isNotNull() & F.col("id").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    named = lambda df: df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where(usable)
    candidates, asking = named(vectors), named(queries).groupBy("id").agg(F.min("v").alias("v"))
    sizes = candidates.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n_queries = asking.count()
    width = max(sizes.width or 0, 1)
    q_blocks, x_blocks = -(-n_queries // query_block) or 1, -(-sizes.n // candidate_block) or 1
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    asking, candidates = asking.withColumn("qb", dealt(q_blocks)), candidates.withColumn("xb", dealt(x_blocks))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        q_ids, x_ids = a.column("id").to_numpy(), b.column("id").to_numpy()
        q, x = matrix(a.column("v"), width, scale), matrix(b.column("v"), width, scale)
        rows, columns, scores, read = block_top(q, q_ids, x, x_ids, k, a.column("threshold").to_numpy())
        order = np.lexsort((x_ids[columns], ~scores, rows))  # ~ turns the order around and never overflows
        rows, columns, scores = rows[order], columns[order], scores[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        best = place < k
        return pa.table({"query_id": pa.array(q_ids[rows[best]], pa.int64()), "vec_id": pa.array(x_ids[columns[best]], pa.int64()), "score": pa.array(scores[best], pa.int64()), "read": pa.array(np.full(best.sum(), read))})

    def over(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.select("qb", "xb", "id", "v", "threshold").groupBy("qb", "xb").cogroup(right.select("qb", "xb", "id", "v").groupBy("qb", "xb")).applyInArrow(meet, MET)

    home = F.pmod(F.col("qb"), F.lit(x_blocks)).cast("int")
    every = lambda n, step=1, start=0: F.explode(F.sequence(F.lit(start), F.lit(n - 1), F.lit(step)))
    at_home = candidates.where(F.col("xb") < q_blocks).withColumn("qb", F.explode(F.sequence("xb", F.lit(q_blocks - 1), F.lit(x_blocks))))
    first = over(asking.withColumn("xb", home).withColumn("threshold", F.lit(float("-inf"))), at_home)
    if x_blocks == 1:
        return first
    first = common.stored(first, "home-scores")
    reached = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("threshold"))
    told = asking.join(reached, "id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("-inf"))))
    rest = over(told.withColumn("xb", every(x_blocks)).where(F.col("xb") != home), candidates.withColumn("qb", every(q_blocks)).where(F.col("xb") != home))
    return first.unionByName(rest)
