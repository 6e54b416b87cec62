"""Rates against a plain Newton solution; null, repeated and equal ids; names that clash."""

import math
import random
from collections import Counter, defaultdict

import pytest

from ticktide.llm import common, mixing

SCHEMA = "doc_id long, text string, source string, mark string, nth int, copies int, target string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "m", 1, 2, "t") for i, t, s in rows], SCHEMA)


def plain_targets(sizes, weights=(3, 1, 2), share=1.5):
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight, goal, free = {s: weights[k % 3] for k, s in enumerate(order)}, share * sum(sizes.values()), set(order)
    while free:
        level = (goal - sum(2 * sizes[s] for s in order if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        free -= over
    return {s: weight[s] * level if s in free else 2.0 * sizes[s] for s in order}


def plain_rates(sizes, target, limit=2):
    """Rates of one source's documents by Newton steps on its dual, halved where they lead away."""
    mean, m = sum(sizes) / len(sizes), 0.0
    rate = lambda m: [limit / (1 + (limit - 1) * math.exp(-max(-700, min(700, m * x / mean)))) for x in sizes]
    gap = lambda m: target - sum(r * x for r, x in zip(rate(m), sizes))
    for _ in range(200):
        slope = sum(x * x / mean * r * (1 - r / limit) for r, x in zip(rate(m), sizes))
        step = gap(m) / max(slope, 1e-300)
        while abs(gap(m + step)) > abs(gap(m)) and abs(step) > 1e-12:
            step /= 2
        m += step
    return rate(m)


def test_rates_equal_plain_newton(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randrange(1, 90)), r.choice(["a", "b", "c", None])) for i in range(800)]
    held = defaultdict(dict)
    for i, t, s in rows:
        held[s][i] = len(t.split())
    targets = plain_targets({s: sum(x.values()) for s, x in held.items()})
    want = {}
    for s, x in held.items():
        if targets[s] < 2 * sum(x.values()):
            want.update(zip(x, plain_rates(list(x.values()), targets[s])))
    found = {x.doc_id: x for x in mixing.mix(documents(spark, rows)).collect()}
    assert want and all(abs(found[i].rate - rate) < 1e-5 for i, rate in want.items())
    assert all(math.floor(x.rate) <= x.copies <= math.floor(x.rate) + 1 for x in found.values())


@pytest.mark.parametrize("kind", ["null ids", "one id", "equal rows", "equal rows that hold most"])
def test_targets_are_met(spark, kind):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randrange(1, 40)), "b") for i in range(600)] + [(900 + i, " ".join(["w"] * 20), "c") for i in range(200)]
    say = lambda k: " ".join([f"x{k}"] * 20)
    rows += {"null ids": [(None, say(k), "a") for k in range(400)], "one id": [(7, say(k), "a") for k in range(400)], "equal rows": [(7, say(0), "a")] * 400, "equal rows that hold most": [(7, say(0), "a")] * 2000}[kind]
    docs, sizes, taken = documents(spark, rows), Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    for x in found:
        taken[x.source] += x.taken
        assert 0 <= x.taken <= 2 * x.size
    targets = plain_targets(sizes)
    assert all(abs(taken[s] - targets[s]) <= 20 for s in sizes), (taken, targets)
    if kind.startswith("equal"):
        copied = mixing.mixed(docs)  # solves it all again
        made = Counter((x.doc_id or -1, x.source) for x in copied.select("doc_id", "source").collect())
        assert copied.columns == docs.columns and made == Counter((x.doc_id or -1, x.source) for x in found for _ in range(x.copies))


def test_sources_are_numbered_in_order(spark):
    names = [f"s{i}" for i in range(50)] + ["", "é", "\U0001f600", "z", None]
    random.Random(3).shuffle(names)
    found = {x.source: x.place for x in mixing.numbered(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long")).collect()}
    assert [found[n] for n in sorted(n for n in names if n is not None)] + [found[None]] == list(range(55))
    assert mixing.numbered(spark.createDataFrame([], "source string, source_size long")).count() == 0


def test_without_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 1, 2, "n"), (2, "b", 1, 2, "n"), (None, "c", 1, 2, "n"), (2, "d", 1, 2, "n")], "doc_id long, text string, _word int, place int, node string")
    found = common.without(docs, spark.createDataFrame([(2,), (None,), (9,)], "doc_id long"))
    assert found.columns == docs.columns and sorted(x.text for x in found.collect()) == ["a", "c"]
    named = docs.toDF("doc_id", "text", "word", "c0", "c1")
    assert common.without(named, named.select("doc_id")).columns == named.columns
