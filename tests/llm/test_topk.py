"""Exact top-k over several blocks, and that lists aren't read to their ends."""

import random
from pathlib import Path

import numpy as np
import pytest

from ticktide.llm import topk


def vectors(n, width, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plain(x, ids, k):
    whole, want = np.floor(256 * x).astype(np.int64), []
    for q, i in enumerate(ids):
        if i % 50 == 0:
            best = sorted((-int(whole[q] @ whole[c]), j) for c, j in enumerate(ids) if j != i)[:k]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return want


@pytest.mark.parametrize(("query_block", "candidate_block"), [(4, 100), (3, 1000), (100, 64)])
def test_blocks_equal_brute_force(spark, query_block, candidate_block):
    x = vectors(700, 16, query_block)
    x[300:340] = x[10]  # ties across blocks
    ids = random.Random(1).sample(range(5000), 700)
    df = spark.createDataFrame([(i, v.tolist(), "id") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, id string")
    found = topk.top_k(df, df.where("vec_id % 50 = 0"), query_block=query_block, candidate_block=candidate_block)
    assert sorted(map(tuple, found.collect())) == sorted(plain(x, ids, 5))


def test_reading_stops_early(spark):
    """With the threshold of its home block a query's other blocks are read in part; unread entries never change the result."""
    x = np.floor(256 * vectors(4000, 64, 2))
    q, ids = x[:50], np.arange(4000)
    scores = q @ x.T
    scores[np.arange(50), np.arange(50)] = -np.inf
    kth = np.sort(scores, axis=1)[:, -5]
    for a, b in ((0, 1000), (1000, 4000)):
        rows, columns, made, read = topk.block_top(q, ids[:50], x[a:b], ids[a:b], 5, kth)
        assert read < 0.8 and len(rows) < 0.1 * 50 * (b - a)
        assert (made == scores[rows, columns + a]).all()
        got = {(r, c + a) for r, c, s in zip(rows, columns, made) if s >= kth[r]}
        assert got == {(r, c) for r, c in zip(*np.nonzero(scores >= kth[:, None])) if a <= c < b}
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    read = topk.met(df, df.where("vec_id % 50 = 0"), 5, 256.0, "vec_id", "embedding", 100, 500).agg({"read": "min"}).first()[0]
    assert read < 0.8


def test_one_block_is_read_in_part():
    """A table of one block has thresholds too, from its slices."""
    x, ids = np.floor(256 * vectors(2000, 64, 5)), np.arange(2000)
    rows, columns, made, read = topk.block_top(x[:40], ids[:40], x, ids, 5)
    scores = x[:40] @ x.T
    assert read < 0.85 and (made == scores[rows, columns]).all()
    scores[np.arange(40), np.arange(40)] = -np.inf
    kth = np.sort(scores, axis=1)[:, -5]
    assert {(r, c) for r, c, s in zip(rows, columns, made) if s >= kth[r]} == {(r, c) for r, c in zip(*np.nonzero(scores >= kth[:, None]))}


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="needs the test tables")
def test_table_is_read_in_part(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    read = topk.met(df, df.where("vec_id % 50 = 0"), 5, 256.0, "vec_id", "embedding", topk.QUERY_BLOCK, topk.CANDIDATE_BLOCK).agg({"read": "max"}).first()[0]
    assert read < 0.85


def test_bounds_hold_at_every_depth():
    x = np.floor(256 * vectors(300, 8, 3))
    lists, q = topk.Lists(x), x[:20]
    for depth in (1, 7, 150, 299, 300):
        lower, upper = lists.bounds(q, depth, upper=False), lists.bounds(q, depth)
        assert (lower <= q @ x.T + 1e-6).all() and (upper >= q @ x.T - 1e-6).all()
    assert (lower == upper).all()
