"""Perplexities against a plain Kneser-Ney model in dictionaries, other scripts included."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ticktide.llm import language_model as lm

TRUSTED = [
    "The cat sat on the mat. The dog sat on the log, and the cat ran.",
    "Привет мир, кошка сидела на коврике; собака сидела на бревне.",
    "猫は敷物に座った。犬は丸太に座った。",
    "The dog ran on the mat 42 times, the cat 7.",
    "القط جلس على السجادة والكلب جلس على الخشب",
    "the the the cat cat sat",
]
OTHERS = ["The cat ran on the log.", "кошка сидела на бревне", "犬は敷物に座った", "zyx wvu 99 $$ !", "الكلب جلس على السجادة", "The dog the dog. The DOG"]


def cuts(counts):
    n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), top) for d, top in ((1 - 2 * y * n2 / n1, 1.0), (2 - 3 * y * n3 / n2, 2.0), (3 - 4 * y * n4 / n3, 3.0))]


def cut(d, n):
    return min(d[min(n, 3) - 1], n)


class Characters:
    """p(symbol | up to three before) of all trusted texts."""

    def __init__(self, texts):
        table, counts, self.orders = lm.symbol_table(), Counter(), {}
        for t in texts:
            s = [0] * (lm.ORDER - 1) + [int(table[ord(c)]) for c in t]
            counts.update(tuple(s[i : i + lm.ORDER]) for i in range(len(t)))
        for k in range(lm.ORDER, 0, -1):
            d, total, passed = cuts(counts.values()), Counter(), Counter()
            for g, n in counts.items():
                total[g[:-1]] += n
                passed[g[:-1]] += cut(d, n)
            self.orders[k] = {g: (n - cut(d, n)) / total[g[:-1]] for g, n in counts.items()}, {c: passed[c] / total[c] for c in total}
            counts = Counter(g[1:] for g in counts)

    def p(self, gram):
        if not gram:
            return 1 / lm.SYMBOLS
        shares, lefts = self.orders[len(gram)]
        return shares.get(gram, 0.0) + lefts.get(gram[:-1], 1.0) * self.p(gram[1:])


def words(text):
    kind, lower, _ = lm.character_tables()
    found, run = [], ""
    for c in text:
        k = kind[ord(c)]
        if k == lm._INSIDE:
            run += chr(lower[ord(c)])
            continue
        found += [run] if run else []
        run = ""
        found += [chr(lower[ord(c)])] if k == lm._ALONE else []
    return found + ([run] if run else [])


class Words:
    def __init__(self, texts):
        self.characters, pairs = Characters(texts), Counter()
        for t in texts:
            w = ["<", *words(t), ">"]
            pairs.update(zip(w, w[1:]))
        met, self.pairs, total, passed, d = Counter(w for _, w in pairs), {}, Counter(), Counter(), cuts(pairs.values())
        for (a, _), n in pairs.items():
            total[a] += n
            passed[a] += cut(d, n)
        self.pairs = {g: (n - cut(d, n)) / total[g[0]] for g, n in pairs.items()}
        self.left = {a: passed[a] / total[a] for a in total}
        d = cuts(met.values())
        self.words = {w: (n - cut(d, n)) / sum(met.values()) for w, n in met.items()}
        self.unknown = sum(cut(d, n) for n in met.values()) / sum(met.values())

    def spelled(self, word):
        if word == ">":
            return 1 / lm.SYMBOLS
        share, table = lm.character_tables()[2], lm.symbol_table()
        s = [lm._SPACE] * 3 + [int(table[ord(c)]) for c in word] + [lm._SPACE]
        return math.prod(self.characters.p(tuple(s[i - 3 : i + 1])) for i in range(3, len(s))) * math.prod(math.exp(share[ord(c)]) for c in word)

    def log_perplexity(self, text):
        w, total = ["<", *words(text), ">"], 0.0
        for a, b in zip(w, w[1:]):
            p = self.words.get(b, 0.0) + self.unknown * self.spelled(b)
            total += math.log(self.pairs.get((a, b), 0.0) + self.left.get(a, 1.0) * p)
        return -total / len(text)


def test_perplexities_equal_a_plain_model(spark):
    rows = [(i, t, "x", "e") for i, t in enumerate(TRUSTED)] + [(100 + i, t, "x", "e") for i, t in enumerate(OTHERS)] + [(200, None, "x", "e"), (201, " \n", None, "e"), (103, OTHERS[3], "x", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, key string")
    found = lm.classify(docs, docs.where("doc_id < 100").select("doc_id")).collect()
    assert len(found) == len(rows)
    plain, got = Words(TRUSTED), defaultdict(set)
    for x in found:
        got[x.doc_id].add(x.log_perplexity)
    for i, t in enumerate(OTHERS):
        assert list(got[100 + i]) == pytest.approx([plain.log_perplexity(t)], abs=1e-4), t
    assert got[200] == got[201] == {None}


def test_long_texts_and_blocks():
    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(n)) for n in (0, 5, 400_000, 3)]
    before, word, _, owner = lm.pairs_of(texts, None)
    assert [int((owner == i).sum()) for i in range(4)] == [0, 6, 400_001, 4]
    assert (before[1:][owner[1:] == owner[:-1]] == word[:-1][owner[1:] == owner[:-1]]).all()
    assert len(np.unique(word)) <= 51


@pytest.mark.parametrize("heavy", [0, 12, 500_000])
def test_rounds_and_rare_words_equal_a_plain_model(spark, monkeypatch, heavy):
    """Whether a word's values are held or joined, and in however many rounds pairs are met; what only a trusted text has is unseen for it."""
    monkeypatch.setattr(lm, "HEAVY", heavy)
    monkeypatch.setattr(lm, "ROUNDS", 3)
    trusted = [*TRUSTED, TRUSTED[0]]
    rows = [(i, t, "x") for i, t in enumerate(trusted)] + [(100 + i, t, None) for i, t in enumerate(OTHERS)] + [(100, OTHERS[0], None), (None, OTHERS[1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = defaultdict(set)
    for x in lm.classify(docs, docs.where("doc_id < 100").select("doc_id")).collect():
        got[x.doc_id].add(x.log_perplexity)
    plain = Words(trusted)
    for i, t in [*enumerate(OTHERS, 100), (None, OTHERS[1]), (0, TRUSTED[0]), (6, TRUSTED[0])]:
        assert list(got[i]) == pytest.approx([plain.log_perplexity(t)] * len(got[i]), abs=1e-4), (i, t)
    assert got[1].pop() > plain.log_perplexity(TRUSTED[1]) + 0.1


def test_rounds_leave_no_exchanges_or_tables(spark, tmp_path, monkeypatch):
    """Pairs aren't stored, and a round's shuffle files are gone before the next round."""
    from pathlib import Path

    from ticktide.llm import common

    folder, most, plain = Path(common.shared_folder(spark).removeprefix("file:")), [], common.stored
    local = Path(spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf()))
    shuffles = lambda: {p for p in local.parent.rglob("shuffle_*.data")}

    def stored(df, name, last=False):
        there = shuffles()
        found = plain(df, name, last)
        most.append(len(shuffles() - there))
        return found

    monkeypatch.setattr(common, "stored", stored)
    before = set(folder.iterdir())
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TRUSTED + OTHERS)], "doc_id long, text string, lang string")
    assert lm.classify(docs, docs.where("doc_id < 6").select("doc_id")).count() == 12
    assert len(most) > 2 * lm.ROUNDS and not any(most)
    assert [p.name.rpartition("-")[0][:12] for p in set(folder.iterdir()) - before] == ["perplexities"]
