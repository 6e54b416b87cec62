"""What several corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Bits of a bitmap of ids that is sent to every executor: 16 for each id, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 26
#: Ids that the bitmap takes for others and that may be sent along; beyond, the rows in doubt are joined.
EXCEPTIONS = 1_000_000
#: Keys that looked_up() sends along, at most.
SENT_KEYS = 100_000

_scratch: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Gives the memory that a worker holds but doesn't use back to the system, where its allocator can: workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; when they are at an end trim() is called."""
    yield from batches
    trim()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and all runs on one machine (tests) a temporary one is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ticktide-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables that stored() writes inside are removed at the end, but for those stored with last=True, which go with the scratch around
    this one, if there is one."""
    folder = fresh_path(spark, name)
    token = _scratch.set((*_scratch.get(), folder))
    try:
        yield
    finally:
        _scratch.reset(token)
        remove(spark, folder)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Queries that run inside have these settings; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, last: bool = False) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors."""
    folders = _scratch.get()[:-1] if last else _scratch.get()
    path = f"{folders[-1]}/{name}-{uuid.uuid4().hex}" if folders else fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text) -> F.Column:
    """Array of the words of a text column; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def places(bits: int) -> tuple[F.Column, F.Column]:
    """Word and bit of node in a bitmap; null for null."""
    bit = F.when(F.col("node").isNotNull(), F.pmod(F.xxhash64("node"), F.lit(bits)))
    return (bit / 64).cast("int").alias("word"), (bit % 64).cast("long").alias("place")


def _held(bitmap: np.ndarray, word: pa.Array, place: pa.Array) -> np.ndarray:
    known = word.is_valid().to_numpy(zero_copy_only=False)
    at, bit = word.fill_null(0).to_numpy(), place.fill_null(0).to_numpy()
    return known & (bitmap[at] >> bit & 1 == 1)


def membership(docs: DataFrame, ids: DataFrame) -> tuple[int, Callable[[pa.Array, pa.Array, pa.Array], np.ndarray], bool]:
    """(bits, test, exact): test(node, word, place) says which rows have their doc_id in ids (node, distinct, stored). It
    holds a bitmap of the ids' hashes and the ids of docs that it takes for others; where those are too many to be sent it
    isn't exact, and what it lets through must be joined. What is sent is bounded by MOST_BITS and EXCEPTIONS."""
    spark = docs.sparkSession
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(ids.count() * 16 - 1, 1).bit_length()))
    word, place = places(bits)
    rows = ids.select(word, place).select("word", F.expr("shiftleft(1L, cast(place as int))").alias("mask"))
    found = rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    sent = spark.sparkContext.broadcast(bitmap)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_held(sent.value, batch.column("word"), batch.column("place")))).select(["node"])

    passed = docs.select(F.col("doc_id").cast("long").alias("node")).select("node", *places(bits)).mapInArrow(likely, "node long")
    doubtful = passed.join(ids, "node", "left_anti").distinct().limit(EXCEPTIONS + 1).toArrow().column("node").to_numpy()
    exact = len(doubtful) <= EXCEPTIONS
    others = spark.sparkContext.broadcast(np.sort(doubtful) if exact else doubtful[:0])

    def test(node: pa.Array, word: pa.Array, place: pa.Array) -> np.ndarray:
        mask = _held(sent.value, word, place)
        if len(others.value):
            own = node.fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(others.value, own), len(others.value) - 1)
            mask &= others.value[at] != own
        return mask

    return bits, test, exact


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the documents in nodes (node, distinct, stored). Texts are joined only where membership() isn't exact."""
    bits, test, exact = membership(docs, nodes)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            yield batch.filter(pa.array(test(batch.column("node"), batch.column("word"), batch.column("place")))).select(["node", "text"])

    named = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    found = named.select("node", "text", *places(bits)).mapInArrow(likely, "node long, text string")
    return found if exact else found.join(nodes, "node", "left_semi")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't among ids, whatever the columns are called; rows without a doc_id stay."""
    gone = stored(ids.select(F.col("doc_id").cast("long").alias("node")).where("node IS NOT NULL").distinct(), "gone")
    bits, test, exact = membership(docs, gone)
    inner = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.select(F.col("doc_id").cast("long").alias("node"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, inner)])
    schema = renamed.schema

    def having(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in trimmed(batches):
                held = test(batch.column("node"), batch.column("word"), batch.column("place"))
                yield batch.filter(pa.array(held == wanted)).select(["node", *inner])

        return renamed.select("node", *inner, *places(bits)).mapInArrow(run, schema)

    kept = having(False)
    if not exact:
        kept = kept.unionByName(having(True).join(gone, "node", "left_anti"))
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, inner)])


def finite(vector) -> F.Column:
    """Whether a vector column is there and all its components are finite numbers."""
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def whole_numbers(column: pa.Array, width: int, scale: float, most: float = 2.0**62) -> np.ndarray:
    """floor(scale * c) of each component of a column of vectors, as longs, a vector to a row. Shorter vectors are filled up with
    zeros; what is beyond +-most becomes that."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out, rows = np.zeros((len(sizes), width), np.int64), np.repeat(np.arange(len(sizes)), sizes)
    scaled = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.clip(scaled, -most, most).astype(np.int64)
    return out


def looked_up(rows: DataFrame, key: str, found: DataFrame, weight: str) -> DataFrame:
    """rows with the other columns of found (stored, a row for each key) beside them, null where it has none; null keys are equal.
    weight: how many of the rows a key has. The SENT_KEYS heaviest keys are broadcast, so many at most whatever the size of the
    tables. Where there are more, the others are joined by a shuffle, in which none of them has over 1 / SENT_KEYS of the rows."""
    made = [c for c in found.columns if c not in (key, weight)]
    named = found.select(F.col(key).alias("_key"), *made, weight)
    sent, rest = named, None
    if found.count() > SENT_KEYS:
        sent = stored(named.orderBy(F.desc(weight), "_key").limit(SENT_KEYS), "heavy-keys")
        rest = named.join(sent.select(F.col("_key").alias("_sent")), F.col("_key").eqNullSafe(F.col("_sent")), "left_anti")
    same = F.col(key).eqNullSafe(F.col("_key"))
    met = rows.join(F.broadcast(sent.select("_key", *made, F.lit(True).alias("_met"))), same, "left").drop("_key")
    if rest is not None:
        others = met.where("_met IS NULL").drop(*made).join(rest.select("_key", *made), same, "left").drop("_key")
        met = met.where("_met").unionByName(others)
    return met.select(*rows.columns, *made)
