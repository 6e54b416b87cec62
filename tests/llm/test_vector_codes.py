"""Codebooks, codes and errors against plain Python, and lower bounds against all distances."""

import hashlib

import numpy as np
import pytest

from ticktide.llm import common, vectorcodes

SCHEMA = "vec_id long, embedding array<double>, label string, id string, v long, code long, error string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v and [c if c is None else float(c) for c in v], label, "x", 1, 2, "y") for i, v, label in rows], SCHEMA)


def plain(rows, size=256, rounds=4):
    """{row number: (code, error)}, errors by label, SHA-256 of the codebooks."""
    fine = [(i, v, label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = -(-max(len(v) for _, v, _ in fine) // 4) * 4
    whole = [[int(np.floor(1024 * c)) for c in [*v, *[0.0] * (width - len(v))]] for _, v, _ in fine]
    w = width // 4
    parts = [[x[p * w : (p + 1) * w] for x in whole] for p in range(4)]
    first = sorted(range(len(fine)), key=lambda r: (fine[r][0] is None, fine[r][0] or 0, fine[r][1]))[:size]
    books = [[parts[p][r] for r in first] for p in range(4)]

    def assigned(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p])) for x in parts[p]]

    for _ in range(rounds):
        for p in range(4):
            chosen = {}
            for x, (_, e) in zip(parts[p], assigned(p)):
                chosen.setdefault(e, []).append(x)
            for e, xs in chosen.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [assigned(p) for p in range(4)]
    codes = ["".join(f"{found[p][r][1]:02x}" for p in range(4)) for r in range(len(fine))]
    errors = [sum(found[p][r][0] for p in range(4)) for r in range(len(fine))]
    by_label = {}
    for (_, _, label), e in zip(fine, errors):
        by_label[label] = by_label.get(label, 0) + e
    text = ",".join(str(v) for b in books for c in b for v in c)
    most = (1 << 63) - 1
    return sorted(((fine[r][0], codes[r], min(most, errors[r]), min(most, by_label[fine[r][2]]), hashlib.sha256(text.encode()).hexdigest()) for r in range(len(fine))), key=str)


def check(spark, rows):
    assert sorted(map(tuple, vectorcodes.compress(frame(spark, rows)).collect()), key=str) == plain(rows)


def test_equals_plain_python(spark):
    r = np.random.default_rng(0)
    rows = [(int(i), (x / 4).tolist(), ["a", None, "b"][i % 3]) for i, x in enumerate(r.normal(size=(400, 16)))]
    r.shuffle(rows)
    check(spark, [*rows, (1000, rows[3][1], "a"), (1001, rows[3][1], None)])


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "SENT_KEYS", 1)
    good = [(i, [(i * 7 % 5) / 8, -i / 16, 0.5, 1.0, i % 2, -0.001], f"l{i % 4}" if i % 3 else None) for i in range(12)]
    check(spark, [*good, (5, [9.0] * 6, "l1"), (None, [1.0] * 6, None), (77, [], "l2"), (78, [0.25], None), (80, None, "l1"), (81, [1.0, None, 0, 0, 0, 0], "l1"), (82, [float("nan")] * 6, "l1"), (83, [float("-inf")] * 6, None)])
    check(spark, [(i, [float(i % 2)] * 8, None) for i in range(10)])  # ties of every kind


def test_numbers_beyond_longs(spark):
    check(spark, [(i, [1e12 * (i % 7), -3e14 * i, 1e15 / (i + 1), 5.0], "a") for i in range(8)])
    found = vectorcodes.compress(frame(spark, [(i, [1e300 * (-1) ** i] * 4, "a") for i in range(300)])).collect()
    assert {r.error for r in found} == {0}


def test_empty_table(spark):
    assert vectorcodes.compress(frame(spark, [])).collect() == []
    assert vectorcodes.compress(frame(spark, [(1, None, "a")])).collect() == []


@pytest.mark.parametrize("width", [1, 2, 3, 16, 37])
@pytest.mark.parametrize("scale", [3, 300, 10**6, 2**40])
def test_bounds_leave_out_no_nearest(width, scale):
    r = np.random.default_rng(width)
    x, c = r.integers(-scale, scale, (500, width)), r.integers(-scale, scale, (100, width))
    c[50:] = c[:50]
    x[:20] = c[:20]
    index, distance, made = vectorcodes.nearest(x, c)
    all_pairs = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)) for e in c] for v in x]
    assert index.tolist() == [d.index(min(d)) for d in all_pairs] and [int(d) for d in distance] == [min(d) for d in all_pairs]


def test_bounds_spare_distances():
    r = np.random.default_rng(5)
    c = (r.normal(size=(256, 1)) * 300 + r.normal(size=(256, 16)) * 100).astype(np.int64)
    x = c[r.integers(0, 256, 4000)] + r.integers(-40, 40, (4000, 16))
    assert vectorcodes.nearest(x, c)[2] < 0.05 * 4000 * 256
