"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is logistic in the features that it holds, a document's is the noisy-or of its sentences'. Weights
are fitted by gradient steps on the likelihood of the document labels, so the sentences at fault are found without labels of
their own. Features are words and beginnings of words, chosen by how their document counts differ between the labels.

Fitting uses a sample of labelled documents, MAX_TRAIN at most (a parameter), taken in the order of a hash of doc_id; scoring
covers all. labels rows without toxic are left out; of several for a doc_id the largest counts. Null or empty text: no
sentence, probability 0. Without labels of both kinds: every score is 0. Repeated rows: each is scored. Long texts are scored sentence by sentence, whole. Ties:
of features that tell equally much the first by name is chosen, of equally bad sentences the first is placed. An empty table gives
no rows. Other columns stay as they are, whatever they are called.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.llm import tokens

MAX_TRAIN = 12_000
FEATURES = 4096
#: Lengths of the beginnings of words that are features beside the words.
STEMS = (4, 5, 6, 7)
#: Documents of the sample that must have a feature, unless told otherwise.
LEAST_DOCS = 4

_sentence = re.compile(r"[^.!?\n]*[.!?\n]?")
_word = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word's features: itself and its beginnings, marked with an asterisk."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def sampled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """toxic and text of at most `most` labelled documents that aren't held out. The ids broadcast are at most `most`."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))


def chosen_features(train: DataFrame, most: int, least_docs: int = LEAST_DOCS) -> list[str]:
    """The `most` features, of those that at least so many documents have, whose document counts tell most about the label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                by[toxic > 0].update({f for w in set(_word.findall(text.lower())) for f in features(w)})
        for toxic in (0, 1):
            names = list(by[toxic])
            for i in range(0, len(names), 10_000):
                some = names[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([by[toxic][x] for x in some], pa.int64()), pa.array([toxic] * len(some), pa.int32())], ["feature", "n", "toxic"])

    docs = train.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    of = {int(r.toxic > 0): r.n for r in docs}
    if len(of) < 2:
        return []
    counts = train.mapInArrow(count, "feature string, n long, toxic int").groupBy("feature").agg(*[F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias(f"n{t}") for t in (0, 1)])
    a, b = (F.col("n1") + 0.5) / (of[1] + 1.0), (F.col("n0") + 0.5) / (of[0] + 1.0)
    z = F.log(a / b) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = counts.where(F.col("n0") + F.col("n1") >= least_docs).select("feature", F.abs(z).alias("z")).orderBy(F.desc("z"), "feature").limit(most)
    return [r.feature for r in best.collect()]


class Model:
    """Weights by feature and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words: dict[str, float] = {}

    def word(self, word: str) -> float:
        """The summed weights of a word's features, remembered for words that have any."""
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, probability) of each sentence with a word."""
        remembered = self.words
        for m in _sentence.finditer(text):
            words = set(_word.findall(m[0].lower()))
            if not words:
                continue
            total = self.bias
            for w in words:
                value = remembered.get(w)
                if value is None:
                    if len(remembered) > 200_000:
                        remembered.clear()
                    value = remembered[w] = self.word(w)
                total += value
            yield m.start(), m.end(), 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    def score(self, text: str | None) -> tuple[float, int, int, float]:
        """The document's probability, and start, end and probability of its worst sentence (-1, -1, 0 without one)."""
        clean, worst = 0.0, (-1, -1, 0.0)
        for start, end, p in self.sentences(text or ""):
            clean += math.log1p(-p)
            if p > worst[2]:
                worst = (start, end, p)
        return (-math.expm1(clean), *worst)


def bags(train: DataFrame, names: list[str]) -> DataFrame:
    """doc, toxic, and the chosen features' numbers in each sentence that has any, with how many sentences have none."""
    index = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found, empty = [], 0
                for m in _sentence.finditer(text):
                    words = set(_word.findall(m[0].lower()))
                    has = sorted({index[f] for w in words for f in features(w) if f in index})
                    if has:
                        found.append(has)
                    else:
                        empty += bool(words)
                rows.append((toxic, empty, found))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int32())))], ["toxic", "empty", "sentences"])

    return train.mapInArrow(run, "toxic int, empty long, sentences array<array<int>>")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = FEATURES, least_docs: int = LEAST_DOCS, steps: int = 250, rate: float = 0.15, penalty: float = 2e-4) -> Model:
    """Fits the noisy-or model by Adam on the mean negative log likelihood of the sample."""
    train = sampled(docs, labels, max_train).persist()
    names = chosen_features(train, max_features, least_docs)
    if not names:
        train.unpersist()
        return Model({}, -30.0)
    data = bags(train, names).toArrow()
    train.unpersist()
    toxic = (data.column("toxic").to_numpy() > 0).astype(float)
    empty = data.column("empty").to_numpy().astype(float)
    lists = data.column("sentences").combine_chunks()
    per_doc = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    inner = lists.flatten()
    sizes = inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    feature = inner.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    w, bias = np.zeros(len(names)), -6.0
    mean, square = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sentence, w[feature], len(sizes)), -30, 30)))
        p0 = 1 / (1 + math.exp(-bias))
        clean = np.bincount(doc, np.log1p(-p), len(per_doc)) + empty * math.log1p(-p0)
        p_doc = np.clip(-np.expm1(clean), 1e-9, 1)
        pull = np.where(toxic > 0, (1 - p_doc) / p_doc, -1.0) / len(per_doc)  # of the log likelihood, by -clean
        by_sentence = pull[doc] * p
        gradient = np.append(np.bincount(feature, by_sentence[sentence], len(names)) - penalty * w, by_sentence.sum() + (pull * empty).sum() * p0)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, bias = w + move[:-1], min(bias + move[-1], 0.0)
    return Model({f: float(x) for f, x in zip(names, w)}, float(bias))


SCORES = "doc_id long, held_out boolean, score double, predicted int, sentence_start long, sentence_end long, sentence_score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: its score and the place of its worst sentence (code points; -1 without one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                rows = [model.score(t) for t in part.column("text").to_pylist()]
                p = np.array([r[0] for r in rows], float)
                columns = [part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *(pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64())))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "sentence_start", "sentence_end", "sentence_score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")).mapInArrow(run, SCORES)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with their columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                yield part.filter(pa.array([model.score(t)[0] < threshold for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
