"""Minimum-bin-slack packing of documents into token sequences.

Longer documents are cut into pieces of the capacity; only first pieces may be shorter, so only they need packing: a full piece
is a sequence of its own. How many pieces there are of each length is all that the plan needs, and lengths are at most the
capacity: the plan is made from that small table, whatever the corpus. For each bin the longest length left is taken and a bitset
subset-sum over the lengths available finds the fullest feasible combination; it is removed as often as the counts allow. Pieces
then get their place by their rank among those of their length; ranks are counted in shards, as many as the commonest length
asks for, so that no length is gathered in one task.

Null text: empty. An empty document is one piece holding the end id alone. Long texts are cut like others. Repeated and null
doc_ids: each row is a document. Ties: equal pieces may change places. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticktide.llm import common, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """A row per piece of each document: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens.coder(tokenizer_path)
        end = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                ids, at = code.encode(part.column("text"))
                body, n = memoryview(ids.astype("<u4")).cast("B"), np.diff(at) + 1
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = (n - capacity * (pieces - 1))[doc]
                start = np.where(piece == 0, 0, first + capacity * (piece - 1))
                length = np.where(piece == 0, first, capacity)
                last = piece == pieces[doc] - 1
                lo = at[:-1][doc] + start
                crcs = [zlib.crc32(end, c) if z else c for c, z in zip((zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length - last).tolist())), last.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        batch = part = None
        common.trim()  # the worker waits for its next task with the coder's cache alone

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def fullest(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of the fullest bin that holds the longest length left; counts by length."""
    longest = int(np.flatnonzero(counts)[-1])
    room = capacity - longest
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []  # bit s: the sum s can be made
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        most = min(int(counts[length]) - (length == longest), room // length)
        k = 1
        while most > 0:  # k of them at once: 1, 2, 4, ... and the rest
            k = min(k, most)
            made = (reach | reach << k * length) & full
            if made != reach:
                steps.append((reach, length, k))
                reach = made
            most, k = most - k, 2 * k
        if reach >> room & 1:
            break
    total, found = reach.bit_length() - 1, {longest: 1}
    for before, length, k in reversed(steps):
        if not before >> total & 1:
            total -= k * length
            found[length] = found.get(length, 0) + k
    return sorted(found.items(), reverse=True)


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many bins, what each holds) until no piece is left."""
    counts, plan = counts.copy(), []
    while counts.any():
        bin_ = fullest(counts, capacity)
        times = min(int(counts[length]) // k for length, k in bin_)
        for length, k in bin_:
            counts[length] -= times * k
        plan.append((times, bin_))
    return plan


def place_runs(plan: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, how many of this length in a bin, offset in the bin) sorted by length and rank."""
    used, runs, first_bin = np.zeros(capacity + 1, np.int64), [], 0
    for times, held in plan:
        offset = 0
        for length, k in held:
            runs.append((length, used[length], first_bin, k, offset))
            used[length] += times * k
            offset += length * k
        first_bin += times
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


#: Shards for the pieces of a length: one for so many of the commonest length, within a number that bounds the table of counts.
IN_SHARD, MOST_SHARDS = 1_000, 4096


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece."""
    pieces = common.stored(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.where(F.col("length") < capacity).groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity rows
        counts[row.length] = row.n
    shards = min(max(1, -(-int(counts.max()) // IN_SHARD)), MOST_SHARDS)
    plan = plan_bins(counts, capacity)
    runs, n_bins = place_runs(plan, capacity), sum(times for times, _ in plan)
    keyed = pieces.where(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    if shards > 1:  # what is counted must be what is ranked
        keyed = common.stored(keyed, "sharded")
    held = keyed.groupBy("length", "shard").agg(F.count("*").alias("n"))  # at most capacity * shards rows
    before = held.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).select("length", "shard", F.coalesce("before", F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = keyed.withColumn("rank", rank.cast("long")).join(before, ["length", "shard"]).withColumn("rank", F.col("rank") + F.col("before"))

    key = runs[:, 0] * (1 << 48) + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = runs[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            nth, slot = np.divmod(rank - run[:, 1], run[:, 3])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(run[:, 2] + nth), pa.array(run[:, 4] + slot * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    packed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() + n_bins).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole)
