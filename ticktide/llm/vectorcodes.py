"""Vectors as codes of four bytes: four codebooks, one for each quarter of the components, fitted in whole numbers.

Components become integers, floor(scale * x); a vector is cut into PARTS equal consecutive parts. Each part's codebook starts as that
part of the SIZE vectors of smallest id; a round assigns every part to the nearest entry and puts the floor of its parts' mean in
each entry's place. Entries that no part chose stay.

The nearest entry is found by lower bounds, coarse to fine. Over a block of m components with means a, b and residuals (what differs
from the mean) of norms r, s, the squared distance is at least m * (a - b)^2 + (r - s)^2. A part meets the entries with one block,
the whole part, then with 2 blocks, 4, and so on; entries whose bound is above the best exact distance so far are out. That best
distance is of the entry of lowest bound at each step. What is left at the end gets its exact distance in whole numbers. Bounds are lowered by what rounding can add, so no entry that is nearest, or as near
as that, is left out, and of equals the lowest index is taken.

A round reads the table once. Tasks send sums and counts of each entry, summed by the shuffle; the driver holds a codebook and its
sums, as many numbers as SIZE vectors have.

Vectors that are null or hold null or non-finite components have no rows. Shorter vectors count as filled up with zeros, to the
longest one's number of components and on to a multiple of PARTS. Scaled components beyond +-2**62 become that, errors beyond a long
the largest long. Rows that share an id all take part; the smaller vector comes first among them. A null id comes after all
others. Fewer than SIZE rows make a codebook of as many entries. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ticktide.llm import common

PARTS, SIZE, ROUNDS = 4, 256, 4
#: Parts that meet a codebook at once, and pairs whose numbers are gathered at once.
AT_ONCE, GATHERED = 2048, 1 << 14
LARGEST = (1 << 63) - 1


def _blocks(width: int, n: int) -> np.ndarray:
    return np.arange(n) * width // n


def features(v: np.ndarray, n: int) -> np.ndarray:
    """For each of n blocks its mean, times the root of its length, and its residual's norm: vectors whose distances are lower bounds."""
    starts = _blocks(v.shape[1], n)
    sizes = np.diff(np.append(starts, v.shape[1]))
    means = np.add.reduceat(v, starts, axis=1) / sizes
    rest = v - np.repeat(means, sizes, axis=1)
    return np.concatenate([means * np.sqrt(sizes), np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))], axis=1)


def exact(x: np.ndarray, entries: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, as longs, or as Python's integers where longs could overflow."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    largest = 4 * x.shape[1] * most * most
    kind = np.int32 if largest < 1 << 31 else np.int64 if largest < LARGEST else object
    x, entries, out = x.astype(kind, copy=False), entries.astype(kind, copy=False), np.empty(len(rows), object if kind is object else np.int64)
    for i in range(0, len(rows), GATHERED):
        d = x[rows[i : i + GATHERED]] - entries[columns[i : i + GATHERED]]
        out[i : i + GATHERED] = (d * d).sum(axis=1) if kind is object else np.einsum("ij,ij->i", d, d)
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, its squared distance) of each part, and how many distances were worked out."""
    found = [_nearest(x[i : i + AT_ONCE], entries) for i in range(0, len(x), AT_ONCE)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    index, distance, made = zip(*found)
    return np.concatenate(index), np.concatenate(distance), sum(made)


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    width, xf, cf = x.shape[1], x.astype(float), entries.astype(float)
    square = lambda v: np.einsum("ij,ij->i", v, v)
    slack = (width + 32) * 2.0**-49 * (square(xf)[:, None] + square(cf))  # what rounding can add to a bound
    every, n, made, best, left = np.arange(len(x)), 1, 0, None, None
    while True:
        a, b = features(xf, n), features(cf, n)
        lower = a @ (-2 * b.T)
        lower += square(a)[:, None]
        lower += square(b)
        lower -= slack
        if left is not None:
            lower[~left] = np.inf
        distance = exact(x, entries, every, lower.argmin(axis=1))  # of the likeliest entry
        best = distance if best is None else np.minimum(best, distance)
        left = lower <= (best.astype(float) * (1 + 2.0**-50))[:, None]
        made, n = made + len(x), 2 * n
        if n >= width or np.count_nonzero(left) <= 2 * len(x):
            break
    rows, columns = np.nonzero(left)  # a row always has an entry left: that of its best distance
    distance = exact(x, entries, rows, columns)
    starts = np.searchsorted(rows, every)
    least = np.minimum.reduceat(distance, starts)
    at = np.flatnonzero(distance == np.repeat(least, np.diff(np.append(starts, len(rows)))))
    at = at[np.append(True, rows[at[1:]] != rows[at[:-1]])]
    return columns[at], least, made + len(rows)


_SUMS = "part int, entry int, place int, n long, total decimal(38,0)"


def _sums(books: list[np.ndarray], width: int, scale: float):
    """What a task adds to each entry: sums and number of the parts that chose it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, made = width // PARTS, [[np.zeros(b.shape, object), np.zeros(len(b), np.int64)] for b in books]
        for batch in batches:
            x = common.whole_numbers(batch.column("v"), width, scale)
            kind = np.int64 if int(np.abs(x).max(initial=0)) * len(x) < LARGEST else object
            for p, book in enumerate(books):
                part = x[:, p * size : (p + 1) * size]
                index = nearest(part, book)[0]
                order = np.argsort(index, kind="stable")
                chosen, starts, counts = np.unique(index[order], return_index=True, return_counts=True)
                if len(chosen):
                    made[p][0][chosen] += np.add.reduceat(part[order].astype(kind), starts, axis=0).astype(object)
                    made[p][1][chosen] += counts
        for p, (totals, counts) in enumerate(made):
            used = np.flatnonzero(counts)
            rows = [(p, int(e), i, int(counts[e]), Decimal(int(totals[e, i]))) for e in used for i in range(size)]
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38)))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "n", "total"])

    return run


def _books(rows: list, width: int) -> list[np.ndarray]:
    whole = np.array(rows, np.int64).reshape(len(rows), PARTS, width // PARTS)
    return [np.ascontiguousarray(whole[:, p]) for p in range(PARTS)]


def fit(named: DataFrame, width: int, scale: float, rounds: int = ROUNDS, size: int = SIZE) -> list[np.ndarray]:
    """The codebooks, one for each part, after so many rounds. named: id, v."""
    first = named.orderBy(F.asc_nulls_last("id"), "v").limit(size).select("v").toArrow().column("v").combine_chunks()
    books = _books(common.whole_numbers(first, width, scale), width)
    for _ in range(rounds):
        sums = named.select("v").mapInArrow(_sums(books, width, scale), _SUMS).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = [b.copy() for b in books]
        for r in sums.toArrow().to_pylist():  # as many rows as the codebooks have numbers
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, scale: float = 1024.0, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (of all rows of an equal label), codebooks_sha256."""
    vector = F.col(vector_column).cast("array<double>")
    named = vectors.select(F.col(id_column).cast("long").alias("id"), vector.alias("v"), F.col(label_column).alias("label")).where(common.finite(F.col("v")))
    widest = named.agg(F.max(F.size("v"))).first()[0] or 1
    width = -(-max(widest, 1) // PARTS) * PARTS
    books = fit(named, width, scale, rounds)
    size, schema = width // PARTS, StructType([StructField("vec_id", LongType()), StructField("code", StringType()), StructField("error", LongType()), named.schema["label"]])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = common.whole_numbers(batch.column("v"), width, scale)
            found = [nearest(x[:, p * size : (p + 1) * size], book) for p, book in enumerate(books)] if len(x) else []
            index = np.stack([f[0] for f in found], axis=1).astype(np.uint8) if found else np.zeros((0, PARTS), np.uint8)
            text = index.tobytes().hex()
            codes = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
            errors = [min(LARGEST, e) for e in sum(f[1].astype(object) for f in found).tolist()] if found else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes, pa.string()), pa.array(errors, pa.int64()), batch.column("label")], ["vec_id", "code", "error", "label"])

    codes = common.stored(named.mapInArrow(coded, schema), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = common.stored(codes.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("n")), "label-errors")
    return common.looked_up(codes, "label", sums, "n").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
