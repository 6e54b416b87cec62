"""Whitening by a tall, skinny QR: no covariance of the vectors is formed.

Components become integers, y = floor(scale * c), and x = y + OFFSET. The fit list has each distinct vector once: n vectors with
sums S for each dimension. Rows are centred from exact sums, (n * x - S) / n with a whole numerator, so neither the offset nor any
other constant costs digits. Each task factors its rows into Q and R and keeps R; R factors are stacked and factored again, up a
tree; the last R has the singular values and right vectors of all centred rows. A right vector divided by its singular value, times
the root of n, whitens. A last pass measures the covariance of the whitened fit list.

The fit list is shuffled and stored as bytes, one to eight a component, as few as a vector's largest needs: equal vectors have equal
bytes. The driver holds one R: a square of a vector's width.

Vectors that are null or hold null or non-finite components have no rows. Shorter vectors count as filled up with zeros. Scaled
components beyond +-2**62 become that, deviations beyond a long the largest long. Rows that share an id, or a vector, each have
their rows. Components along which the fit list has no extent (of copies of one vector: all) are explained 0, or null where there is
no variance at all, and whitened null; they are left out of identity_error, null if none is left. Eigenvectors of equal eigenvalues
are one choice of many. Empty tables, and vectors without components, give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.llm import common

SCALE, OFFSET, COMPONENTS = 64.0, 1_000_000, 16
#: R factors that one task merges, and numbers that are factored at once.
FAN, NUMBERS = 16, 1 << 21
LARGEST = (1 << 63) - 1
_WIDTHS = ((1, 1 << 7), (2, 1 << 15), (4, 1 << 31), (8, 1 << 63))


def packed(y: np.ndarray) -> list[bytes]:
    """Each vector as bytes: how many a number has, then the numbers, little-endian."""
    most = np.maximum(y.max(axis=1, initial=0), -1 - y.min(axis=1, initial=0))
    out: list[bytes] = [b""] * len(y)
    for i, (size, above) in enumerate(_WIDTHS):
        rows = np.flatnonzero((most < above) & (most >= (_WIDTHS[i - 1][1] if i else 0)))
        data, step, mark = y[rows].astype(f"<i{size}").tobytes(), size * y.shape[1], bytes([size])
        for k, row in enumerate(rows.tolist()):
            out[row] = mark + data[k * step : (k + 1) * step]
    return out


def unpacked(vectors: list[bytes], width: int) -> np.ndarray:
    sizes, out = np.array([v[0] for v in vectors], np.int64), np.empty((len(vectors), width), np.int64)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        out[rows] = np.frombuffer(b"".join(vectors[r][1:] for r in rows.tolist()), f"<i{size}").reshape(len(rows), width)
    return out


def numerators(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S: as longs, or Python's integers where longs could overflow. sums: of y, Python's integers."""
    most = max(int(np.abs(y).max(initial=0)) * n, max(map(abs, sums.tolist()), default=0))
    return y * n - sums.astype(np.int64) if 2 * most < LARGEST else y.astype(object) * n - sums


def centred(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    made = numerators(y, n, sums)
    return (made if made.dtype == np.int64 else np.array([[a / n for a in row] for row in made]).reshape(y.shape)) / (n if made.dtype == np.int64 else 1)


def deviations(y: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    made = numerators(y, n, sums)
    if made.dtype == np.int64 and int(np.abs(made).max(initial=0)) ** 2 * made.shape[1] < LARGEST:
        return np.einsum("ij,ij->i", made, made).tolist()
    return [min(LARGEST, sum(int(a) * int(a) for a in row)) for row in made.tolist()]


def factored(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """R of what r stands for and of rows, some at a time."""
    step = max(rows.shape[1], NUMBERS // max(rows.shape[1], 1))
    for i in range(0, len(rows), step):
        r = np.linalg.qr(np.concatenate([r, rows[i : i + step]]), mode="r")
    return r


_R = "at int, r binary"


def _merged(table: pa.Table) -> pa.Table:
    width = int(table.column("width")[0].as_py())
    stack = np.concatenate([np.frombuffer(b, float).reshape(-1, width) for b in table.sort_by("at").column("r").to_pylist()])
    return pa.table({"at": pa.array([table.column("at")[0].as_py() // FAN], pa.int32()), "r": [factored(np.zeros((0, width)), stack).tobytes()]})


def triangle(fit: DataFrame, width: int, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred fit list (u)."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            r = factored(r, centred(unpacked(batch.column("u").to_pylist(), width), n, sums))
        if len(r):
            yield pa.RecordBatch.from_pydict({"at": pa.array([TaskContext.get().partitionId()], pa.int32()), "r": [r.tobytes()]})

    factors = common.stored(fit.mapInArrow(factor, _R), "factors")
    last = factors.agg(F.max("at")).first()[0]
    while last:
        factors = factors.withColumn("width", F.lit(width)).groupBy(F.floor(F.col("at") / FAN).alias("branch")).applyInArrow(_merged, _R)
        last //= FAN
    return np.frombuffer(factors.first()["r"], float).reshape(-1, width)


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, np.zeros(width, object)
        for batch in batches:
            y = unpacked(batch.column("u").to_pylist(), width)
            whole = y if int(np.abs(y).max(initial=0)) * len(y) < LARGEST else y.astype(object)
            n, totals = n + len(y), totals + whole.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(width), pa.int32()), "n": pa.array([n] * width, pa.int64()), "total": pa.array([Decimal(int(t)) for t in totals], pa.decimal128(38))})

    return run


def _products(width: int, n: int, sums: np.ndarray, whitener: np.ndarray):
    """Sums of z_i * z_j and, at j = -1, of z_i over the whitened rows z of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = whitener.shape[1]
        total = np.zeros((k, k + 1))
        for batch in batches:
            z = centred(unpacked(batch.column("u").to_pylist(), width), n, sums) @ whitener
            total += np.concatenate([z.T @ z, z.sum(axis=0)[:, None]], axis=1)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(np.where(j == k, -1, j).ravel(), pa.int32()), "total": total.ravel()})

    return run


def identity_error(fit: DataFrame, width: int, n: int, sums: np.ndarray, whitener: np.ndarray) -> float | None:
    """The largest entry, without its sign, of the whitened fit list's covariance minus the identity."""
    k = whitener.shape[1]
    if not k:
        return None
    found = fit.mapInArrow(_products(width, n, sums, whitener), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).toArrow()
    total = np.zeros((k, k + 1))
    total[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("total").to_numpy()
    mean = total[:, -1] / n
    return float(np.abs(total[:, :-1] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: float = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    named = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where(common.finite(F.col("v")))
    width = named.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return spark.createDataFrame([], schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"u": pa.array(packed(common.whole_numbers(batch.column("v"), width, scale)), pa.binary())})

    fit = common.stored(named.select("v").mapInArrow(pack, "u binary").distinct(), "fit-list")
    found = fit.mapInArrow(_sums(width), "place int, n long, total decimal(38,0)").groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("place").collect()
    n, sums = found[0].n, np.array([int(r.total) for r in found], object)
    _, sigma, right = np.linalg.svd(triangle(fit, width, n, sums), full_matrices=True)
    sigma = np.concatenate([sigma, np.zeros(width - len(sigma))])
    right *= np.where(right[np.arange(width), np.abs(right).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    k, variance = min(components, width), float((sigma * sigma).sum())
    extent = int((sigma[:k] > sigma[0] * max(n, width) * 2.0**-52).sum())
    whitener = right[:extent].T * (np.sqrt(n) / sigma[:extent])
    explained = [float(s * s / variance) if variance else None for s in sigma[:k]]
    error = identity_error(fit, width, n, sums, whitener)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), step := max(1, NUMBERS // width)):
                rows = batch.slice(i, step)
                y = common.whole_numbers(rows.column("v"), width, scale)
                z = np.full((len(y), k), np.nan)
                z[:, :extent] = centred(y, n, sums) @ whitener
                m = len(y)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": rows.column("id").take(pa.array(np.repeat(np.arange(m), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    "n": pa.array(np.full(m * k, n), pa.int64()),
                    "deviation": pa.array(np.repeat(np.array(deviations(y, n, sums), np.int64), k)),
                    "whitened": pa.array(z.ravel(), from_pandas=True),
                    "explained": pa.array(explained * m, pa.float64()),
                    "identity_error": pa.array([error] * (m * k), pa.float64()),
                })

    return named.mapInArrow(project, schema)
