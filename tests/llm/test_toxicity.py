"""The noisy-or model against plain sums and a plain gradient; odd rows."""

import math
import random
import re

import pytest

from ticktide.llm import toxicity

SCHEMA = "doc_id long, text string, toxic string, feature string, score double"


def split(text):
    found = []
    for part in re.split(r"(?<=[.!?\n])", text):
        words = {w for w in re.findall(r"[^\W\d_]+", part.lower())}
        if words:
            found.append({f for w in words for f in [w, *(w[:k] + "*" for k in (4, 5, 6, 7) if len(w) >= k)]})
    return found


def plain_score(model, text):
    clean = 1.0
    for sentence in split(text or ""):
        words = {w for w in sentence if not w.endswith("*")}
        total = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features(w))
        clean *= 1 - 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))
    return 1 - clean


def plain_fit(docs, names, steps, rate, penalty):
    """Adam on the mean log likelihood, one document and sentence at a time."""
    w, bias = dict.fromkeys(names, 0.0), -6.0
    mean, square = dict.fromkeys([*names, None], 0.0), dict.fromkeys([*names, None], 0.0)
    for step in range(1, steps + 1):
        g = {f: -penalty * w[f] for f in names} | {None: 0.0}
        for sentences, toxic in docs:
            p = [1 / (1 + math.exp(-(bias + sum(w[f] for f in s if f in w)))) for s in sentences]
            whole = min(max(1 - math.prod(1 - x for x in p), 1e-9), 1)
            pull = ((1 - whole) / whole if toxic else -1.0) / len(docs)
            for s, x in zip(sentences, p):
                g[None] += pull * x
                for f in s:
                    if f in w:
                        g[f] += pull * x
        for f in g:
            mean[f], square[f] = 0.9 * mean[f] + 0.1 * g[f], 0.999 * square[f] + 0.001 * g[f] ** 2
            move = rate * (mean[f] / (1 - 0.9**step)) / (math.sqrt(square[f] / (1 - 0.999**step)) + 1e-8)
            if f is None:
                bias = min(bias + move, 0.0)
            else:
                w[f] += move
    return w, bias


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    made = []
    for i in range(160):
        sentences = [" ".join(f"word{'abcdefgh'[r.randrange(8)] * 2}" for _ in range(5)) + r.choice(".!?\n") for _ in range(r.randrange(1, 5))]
        if i % 3 == 0:
            sentences.insert(r.randrange(len(sentences) + 1), "such vilenames here.")
        made.append((i, " ".join(sentences), int(i % 3 == 0)))
    return made


def test_fit_and_scores_equal_plain_ones(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y", 0.0) for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels, max_features=12, steps=25)
    import zlib

    train = [(split(t), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    w, bias = plain_fit(train, list(model.weights), 25, 0.15, 2e-4)
    assert len(w) == 12 and model.bias == pytest.approx(bias, abs=1e-6) and model.weights == pytest.approx(w, abs=1e-6)
    odd = [(900, None), (901, ""), (902, "... !!"), (903, "word " * 60_000 + "vilenames."), (7, rows[7][1]), (None, "vilenames")]
    some = spark.createDataFrame([(i, t, "x", "y", 0.0) for i, t, *_ in [*rows, *odd]], SCHEMA)
    found = toxicity.score(some, model).collect()
    text = {i: t for i, t, *_ in [*rows, *odd]}
    assert len(found) == len(rows) + len(odd) and all(x.score == pytest.approx(plain_score(model, text[x.doc_id]), abs=1e-9) and x.predicted == (x.score >= 0.5) for x in found)
    kept = toxicity.without_toxic(some, model)
    assert kept.columns == some.columns and kept.count() == sum(x.score < 0.5 for x in found)
    assert toxicity.without_toxic(some.limit(0), model).count() == 0
