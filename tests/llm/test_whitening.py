"""Whitening against eigenvectors of a covariance in exact fractions."""

from fractions import Fraction

import numpy as np
import pytest

from ticktide.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n long, component string, u string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v and [c if c is None else float(c) for c in v], 1, "x", "y") for i, v in rows], SCHEMA)


def exact(rows):
    """n, deviations by row, covariance (rounded once), centred rows."""
    width = max(len(v) for _, v in rows)
    whole = [tuple(int(np.floor(64 * c)) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]) for _, v in rows]
    fit = sorted(set(whole))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    covariance = [[float(Fraction(sum((n * a[i] - sums[i]) * (n * a[j] - sums[j]) for a in fit), n**3)) for j in range(width)] for i in range(width)]
    rest = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in whole])
    return n, [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in whole], np.array(covariance), rest, [whole.index(x) for x in whole]


def check(spark, rows, k=16, offset=None):
    n, deviation, covariance, rest, _ = exact(rows)
    e, w = np.linalg.eigh(covariance)
    e, w = e[::-1], w[:, ::-1]
    found = whitening.whiten(frame(spark, rows)).collect()
    k = min(k, covariance.shape[0])
    assert len(found) == len(rows) * k
    at = {}
    for row, (i, _) in enumerate(rows):
        at.setdefault(i, []).append(row)
    for r in found:
        mine = at[r.vec_id]
        assert r.n == n and r.deviation in [deviation[m] for m in mine] and r.identity_error < 1e-9
        c = r.component - 1
        assert r.explained == pytest.approx(e[c] / np.trace(covariance), rel=1e-9, abs=1e-15)
        want = [abs(rest[m] @ w[:, c]) / np.sqrt(e[c]) for m in mine]
        assert min(abs(abs(r.whitened) - x) for x in want) < 1e-7
    signs = {}  # a component's sign is the same for all rows
    for r in found:
        if len(at[r.vec_id]) == 1:
            plain = rest[at[r.vec_id][0]] @ w[:, r.component - 1]
            if abs(plain) > 1e-6:
                signs.setdefault(r.component, set()).add(np.sign(plain) == np.sign(r.whitened))
    assert all(len(s) == 1 for s in signs.values())


def test_equals_exact_covariance(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 20)) * np.linspace(3, 0.3, 20)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    check(spark, [*rows, *((1000 + i, rows[7][1]) for i in range(200)), (7, rows[8][1])])


def test_tree_of_many_factors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "NUMBERS", 40)
    r = np.random.default_rng(2)
    check(spark, [(i, v.tolist()) for i, v in enumerate(r.normal(size=(200, 6)) * [9, 5, 3, 2, 1, 0.5])])


def test_far_from_zero_and_short_vectors(spark):
    r = np.random.default_rng(3)
    far = [(i, (1e7 + v * [8, 4, 2]).tolist()) for i, v in enumerate(r.normal(size=(90, 3)))]
    check(spark, far)
    check(spark, [(i, v[: 1 + i % 4].tolist()) for i, v in enumerate(r.normal(size=(60, 4)) * 5)])


def test_odd_tables(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [None]), (3, [float("inf")]), (4, [])])).collect() == []
    found = whitening.whiten(frame(spark, [(1, [2.0, 1.0]), (2, [2.0, 1.0]), (None, [2.0, 1.0])])).collect()
    assert len(found) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found} == {(1, 0, None, None, None)}
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert [r.whitened for r in line if r.component == 2] == [None] * 5 and all(r.identity_error < 1e-9 for r in line)
    assert all(r.explained == pytest.approx(1) for r in line if r.component == 1) and all(r.explained < 1e-15 for r in line if r.component == 2)


def test_numbers_beyond_longs(spark):
    found = whitening.whiten(frame(spark, [(i, [1e17 * i, 1.0 * i * i]) for i in range(9)])).collect()
    assert {r.deviation for r in found if r.vec_id != 4} == {(1 << 63) - 1} and all(r.identity_error is None or r.identity_error < 1e-6 for r in found)


def test_packing_round_trip():
    r = np.random.default_rng(4)
    y = np.concatenate([r.integers(-(2 ** b), 2 ** b, (50, 7)) for b in (3, 7, 8, 15, 16, 31, 40, 62)])
    y[0] = [-128, 127] + [0] * 5
    y[1] = [-129, 0] + [0] * 5
    made = whitening.packed(y)
    assert (whitening.unpacked(made, 7) == y).all() and len(made[0]) == 8 and len(made[1]) == 15
