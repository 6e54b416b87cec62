"""License matches of damaged passages against containment of every window, counted plainly."""

import random

import pytest

from ticktide.llm import licenses

SCHEMA = "doc_id long, text string, license string, containment string, cell long"


def damaged(r, words):
    words = list(words)
    for _ in range(r.randrange(0, max(2, len(words) // 8))):
        at = r.randrange(len(words))
        kind = r.randrange(3)
        if kind == 0:
            words[at] = f"x{r.randrange(999)}"
        elif kind == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, "and")
    return words


def contained(text, threshold):
    """Each license's largest share of a template in a window, where that reaches the threshold."""
    words, best = licenses.words(text or ""), {}
    for group in licenses.groups(licenses.TEMPLATES, threshold):
        for first in range(0, max(0, len(words) - group.size + 1), group.step):
            window = words[first : first + group.blocks * group.step + group.size - 1]
            held = {tuple(window[i : i + group.size]) for i in range(len(window) - group.size + 1)}
            for (name, _), wanted in zip(group.templates, group.shingles):
                share = len(wanted & held) / len(wanted)
                if share >= threshold:
                    best[name] = max(share, best.get(name, 0.0))
    return best


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_matches_equal_plain_containment(spark, threshold):
    r = random.Random(3)
    texts = [t for some in licenses.TEMPLATES.values() for t in some]
    filler = lambda n: [f"f{r.randrange(999)}" for _ in range(n)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "rights"), (4, " ".join(licenses.words(" ".join(texts))))]
    for i in range(5, 125):
        words = filler(r.choice([0, 2, 60, 700]))
        for t in r.sample(texts, r.choice([1, 1, 2, 3])):
            words += damaged(r, licenses.words(t)) + filler(r.choice([0, 1, 30]))
        rows.append((i, r.choice([" ", "\n", ", "]).join(words)))
    rows += [rows[10], (500, " ".join(filler(60_000)) + " All rights reserved. " + " ".join(filler(9)))]
    docs = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], SCHEMA)
    found = licenses.scan(docs, threshold=threshold).collect()
    got = sorted((x.doc_id, x.license, round(x.containment, 9)) for x in found)
    assert got == sorted((i, name, round(share, 9)) for i, t in rows for name, share in contained(t, threshold).items())
    text = {i: licenses.words(t or "") for i, t in rows}
    assert all(0 <= x.word_start < x.word_end <= len(text[x.doc_id]) for x in found)


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "one two three four", "", "", 0)], SCHEMA)
    assert [(x.license, x.word_start) for x in licenses.scan(docs, {"mine": ["two three"]}).collect()] == [("mine", 1)]
    assert licenses.scan(docs.limit(0)).count() == 0
