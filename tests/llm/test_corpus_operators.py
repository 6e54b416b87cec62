"""Each corpus operator against a plain version, and on nulls, empty, long, tied and repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from ticktide.llm import language_model, licenses, mixing, near_dups, packing, pii, quality, tokens, tokenstore, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n long, rank string"
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """rows: (doc_id, text, source); with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 7, "x") for i, t, s in rows], SCHEMA)


def odd_rows():
    r = random.Random(5)
    say = lambda n: " ".join(r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(r.randrange(40)) for _ in range(n))
    base = say(120)
    rows = [(0, None, "a"), (1, "", None), (2, " \n\t ", "a"), (3, "one two", "b"), (4, base, "a"), (5, base.upper(), "a"), (6, base + " tail end", "a"), (7, say(20_000), "b"), (8, "x" * 100_000, "b"), (9, "one\x0btwo", None), (9, "one\x0btwo", None)]
    return rows + [(i, say(r.randrange(1, 90)), r.choice("abc")) for i in range(10, 60)] + [(i, base, "c") for i in range(60, 75)]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def test_token_ids_equal_the_librarys(docs):
    r = random.Random(1)
    pieces = [" ", "  ", "\n", "'", "'s", "'re", "'ll", "a", "B", "é", "中", "1", "²", " ", "\x1c", "!", "_", "😀", "<|endoftext|>", "\r\n", "٣"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(25))) for _ in range(3000)] + [None, "", "z" * 50_000]
    coder = tokens.BatchCoder(PATH)
    ids, at = coder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == coder.whole([t or "" for t in texts])


@pytest.mark.parametrize(("cache", "buckets"), [(50, None), (500, None), (300, 50), (10**6, 7)])
def test_token_ids_with_small_caches_and_equal_hashes(monkeypatch, cache, buckets):
    """Pieces are forgotten and met again, and pieces that share a hash are told apart by their bytes."""
    r, plain = random.Random(cache), tokens.run_hashes
    if buckets:
        monkeypatch.setattr(tokens, "run_hashes", lambda *a: plain(*a) % np.uint64(buckets))
    pieces = [" ", "\n", "'s", "'ll", "B", "é", "中", "1", "!", "😀", "<|endoftext|>", " word", " wörd", "abc"]
    coder = tokens.BatchCoder(PATH, cache)
    for _ in range(20):
        texts = ["".join(r.choice(pieces) for _ in range(r.randrange(25))) for _ in range(100)] + [None, ""]
        ids, at = coder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == coder.whole([t or "" for t in texts])


def base_spans(text):
    """The contract's expressions as they stand."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    found = []
    for order, (kind, e) in enumerate(kinds.items()):
        for m in re.finditer(e, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and luhn) or (kind == "phone" and 9 <= len(digits) <= 15):
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def test_pii_base_spans_equal_the_expressions():
    r = random.Random(2)
    pieces = ["a", "b.c", "@", ".", "é", "1", "25", "256", "4111 1111 1111 1111", "-", " ", "+1", "(45)", "192.168.0.1", "x@y.zz", "%", "0" * 20, "5500-0000-0000-0004"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(14)))
        spans = pii.find(text)
        assert [f"{s.kind}:{s.start}:{s.end}" for s in spans if s.order < 4] == base_spans(text), text


def test_pii_other_kinds_and_masks():
    text = "my iban GB82 WEST 1234 5698 7654 32 and social security 123-45-6789, not 123-45-6780"
    assert [s.kind for s in pii.find(text)] == ["iban", "ssn", "ssn"]
    assert [s.kind for s in pii.find("number 123-45-6789 GB83 WEST 1234 5698 7654 32")] == []
    assert pii.masked("to a@b.cc or 10.0.0.1!", pii.find("to a@b.cc or 10.0.0.1!")) == "to <EMAIL> or <IP>!"


def test_pii_rows(docs, none):
    rows = {r.doc_id: r for r in pii.detect(docs).collect()}
    assert len(rows) == docs.select("doc_id").distinct().count() and pii.detect(docs).count() == docs.count()
    assert rows[0].spans == "" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.detect(none).count() == 0 and pii.redact(docs).schema == docs.schema and pii.redact(docs).count() == docs.count()


def test_quality_measures(docs, none):
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    for doc_id, text, _ in odd_rows():
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        r = found[doc_id]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.base_failed and r.kept)
    assert quality.judge(docs).count() == docs.count() and quality.judge(none).count() == 0


def test_quality_lines_symbols_and_hosts(spark):
    good = "The quick brown fox jumps over the lazy dog near the old river bank today.\nSecond line here #1."
    rows = [(i, good + f" n{i}", "good") for i in range(30)] + [(i, "no", "bad") for i in range(30, 60)] + [(60, good + "\nSecond line here #1.\n\nSecond line here #1.", "bad")]
    found = {r.doc_id: r for r in quality.judge(documents(spark, rows)).collect()}
    assert found[0].kept and found[0].n_symbols == 1 and found[60].n_dup_lines == 2
    assert found[60].host_rejected and not found[60].kept and not found[0].host_rejected


def brute_components(rows, words, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    top = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) and top[a] != top[b]:
                    top[a] = top[b] = min(top[a], top[b])
                    changed = True
    return {i: (len(sets[i]), top[i]) for i in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, percent):
    r = random.Random(words)
    rows = [x for x in odd_rows() if x[0] != 7]
    text = [f"w{r.randrange(300)}" for _ in range(150)]
    for i in range(100, 160):  # a chain whose ends are far apart, and near copies of its start
        own = list(text)
        own[r.randrange(150)] = f"v{i}"
        rows.append((i, " ".join(own), "c"))
        if i < 130:
            text = own
    found = near_dups.near_duplicates(documents(spark, rows), words, percent).collect()
    assert len(found) == len(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == brute_components(rows, words, percent)
    assert all(x.kept == (x.doc_id == x.component_id) for x in found)


def test_near_duplicates_of_nothing(none):
    assert near_dups.near_duplicates(none).count() == 0


def test_top_k_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], i) for i in range(400)] + [(400, None, 0), (401, [float("nan")] * 8, 0), (402, [1.0, None] + [0.0] * 6, 0), (450, rows_tie := [0.5] * 8, 0), (451, rows_tie, 0), (452, rows_tie, 0), (None, rows_tie, 0), (500, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    found = [tuple(x) for x in topk.top_k(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    ok = {i: np.floor(256 * np.array((v + [0.0] * 8)[:8])) for i, v, _ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    want = []
    for q in sorted(ok):
        if q % 50 == 0:
            best = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q)[:5]
            want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    assert found == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_beyond_doubles(spark):
    df = spark.createDataFrame([(0, [1.0e7, 1.0]), (50, [1.3e7, 7.0]), (51, [-2.0e8, 7.0])], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    assert found[0, 50] == int(256 * 1.0e7) * int(256 * 1.3e7) + 256 * 7 * 256 > 1 << 62
    assert found[0, 51] == -(1 << 63)  # -1.3e20 isn't a long


def test_toxicity_learns_and_places(spark, none):
    r = random.Random(4)
    rows, marks = [], []
    for i in range(600):
        sentences = [" ".join(f"word{r.randrange(60)}" for _ in range(8)) + "." for _ in range(r.randrange(1, 6))]
        toxic = i % 4 == 0
        if toxic:
            sentences[r.randrange(len(sentences))] = "you are a vileword indeed."
        rows.append((i, " ".join(sentences), "s"))
        marks.append((i, 1, int(toxic)))
    docs = documents(spark, rows + [(900, None, "s"), (901, "", None)])
    labels = spark.createDataFrame(marks + [(900, 1, 0), (5, 0, None)], "doc_id long, quality int, toxic int")
    found = {x.doc_id: x for x in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    wrong = [i for i, _, y in marks if found[i].held_out and found[i].predicted != y]
    assert not wrong and found[900].score == found[901].score == 0.0
    text = dict((i, t) for i, t, _ in rows)[8]
    assert "vileword" in text[found[8].sentence_start : found[8].sentence_end]
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in found.items())
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert toxicity.without_toxic(docs, toxicity.Model({}, -30.0)).count() == docs.count()


def test_token_store_round_trip(spark, docs, none, tmp_path):
    store = tokenstore.TokenStore.write(docs, PATH, str(tmp_path / "a"))
    coder, start, want = tokens.BatchCoder(PATH), 0, {}
    for i, t, _ in sorted(odd_rows(), key=lambda x: x[0]):
        ids = coder.whole([t or ""])[0] + [2]
        want[i, start] = ids
        start += len(ids)
    sums = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in store.checksums().collect()}
    assert sums == {k: (len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for k, v in want.items()}
    assert {(r.doc_id, r.start): r.ids for r in store.read().collect()} == want
    assert {r.doc_id for r in store.read(spark.createDataFrame([(4,)], "doc_id long")).collect()} == {4}
    keys = store.chunks().select("key")
    assert keys.count() == keys.distinct().count() < store.references().count()
    assert sum(r.n_documents for r in store.manifest().collect()) == len(want)
    assert tokenstore.TokenStore.write(none, PATH, str(tmp_path / "b")).checksums().count() == 0


def test_merkle_roots_agree():
    for n in range(20):
        leaves, growing = [tokenstore.digest(bytes([i])) for i in range(n)], tokenstore.GrowingRoot()
        for leaf in leaves:
            growing.add(leaf)
        assert growing.root() == tokenstore.merkle_root(leaves)


def test_mixing_meets_targets(spark, none):
    r = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(r.randrange(0, 60))), r.choice(["a", "b", "c", "d", None] + ["hot"] * 5)) for i in range(3000)] + [(3001, None, "a"), (3002, "w w", "tiny")]
    found = mixing.mix(documents(spark, rows)).collect()
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    goal, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        level = (goal - sum(2 * sizes[s] for s in order if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        free -= over
    target = {s: weight[s] * level if s in free else 2.0 * sizes[s] for s in order}
    taken = Counter()
    for x in found:
        assert x.source_size == sizes[x.source] and abs(x.target - target[x.source]) < 1e-6 * goal and 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)
    docs = documents(spark, rows)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == sum(x.copies for x in found)
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect())) == sorted((x.doc_id, x.taken) for x in found)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_packing_is_whole_and_tight(docs, none):
    capacity = 64
    found = packing.pack(docs, PATH, capacity).toPandas().sort_values(["sequence_id", "offset"])
    coder, want = tokens.BatchCoder(PATH), Counter()
    for i, t, _ in odd_rows():
        ids, start = coder.whole([t or ""])[0] + [2], 0
        first = (len(ids) - 1) % capacity + 1
        for p, n in enumerate([first] + [capacity] * ((len(ids) - first) // capacity)):
            want[i, p, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            start += n
    assert Counter(map(tuple, found[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == want
    ends = found.groupby("sequence_id").length.cumsum()
    assert (found.offset == ends - found.length).all() and found.groupby("sequence_id").length.sum().max() <= capacity
    assert found.sequence_id.nunique() <= -(-found.length.sum() // capacity) * 1.02 + 1
    assert packing.pack(none, PATH).count() == 0


def test_fullest_bin_is_the_fullest():
    r = random.Random(7)
    for _ in range(200):
        counts = np.zeros(31, np.int64)
        for _ in range(r.randrange(1, 8)):
            counts[r.randrange(1, 31)] += 1
        longest = max(np.flatnonzero(counts))
        rest = [n for n in range(31) for _ in range(counts[n] - (n == longest))]
        sums = {0}
        for n in rest:
            sums |= {s + n for s in sums}
        bin_ = packing.fullest(counts, 30)
        assert sum(n * k for n, k in bin_) == longest + max(s for s in sums if s + longest <= 30)
        assert all(k <= counts[n] for n, k in bin_)


def test_kneser_ney_is_a_distribution(spark):
    text = "the cat sat on the mat. the dog sat on the log. " * 20
    model = language_model.train(documents(spark, [(1, text, "a"), (2, "la maison est là. " * 9, "a")]), "test")
    p = np.exp(model.logs().reshape(-1, language_model.SYMBOLS).astype(float)).sum(axis=1)
    assert np.abs(p - 1).max() < 1e-3


def test_perplexity_parts_junk_from_text(spark, docs, none):
    r = random.Random(8)
    syllables = "the cat sat mat dog log on in at bar fee dim sun".split()
    say = lambda n: " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows = [(i, say(60), "a") for i in range(300)] + [(1000, "$$$ %%% @@@ ~~~ " * 20, "a"), (1001, None, "a"), (1002, "", None)]
    some = documents(spark, rows)
    found = {x.doc_id: x for x in language_model.classify(some, some.where("doc_id < 200 AND doc_id % 2 = 0").select("doc_id")).collect()}
    assert sum(found[i].kept for i in range(300)) >= 294 and not any(found[i].kept for i in (1000, 1001, 1002))
    assert found[1001].log_perplexity is None
    assert language_model.classify(none, none.select("doc_id")).count() == 0
    assert language_model.classify(docs, none.select("doc_id")).where("kept").count() > 0


def test_licenses_found_and_placed(spark, docs, none):
    r = random.Random(9)
    filler = lambda n: " ".join(f"f{r.randrange(9999)}" for _ in range(n))
    rows, want = [], set()
    i = 0
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            for before in (0, 3, 500):
                rows.append((i, f"{filler(before)}\n{text.upper() if i % 2 else text}\n{filler(40)}", "a"))
                want.add((i, name))
                i += 1
    broken = licenses.TEMPLATES["MIT"][1].split()
    rows += [(900, " ".join(broken[:70]), "a"), (901, " ".join(broken[:20]), "a"), (902, filler(3000), "a")]
    found = licenses.scan(documents(spark, rows)).collect()
    got = {(x.doc_id, x.license) for x in found}
    assert want <= got and (900, "MIT") in got and not {d for d, _ in got} & {901, 902}
    assert {(d, n) for d, n in got if d < i} == want
    place = next(x for x in found if x.doc_id == 2)
    assert (place.word_start, place.word_end) == (500, 503)
    assert licenses.scan(none).count() == 0 and licenses.scan(docs).count() == 0


def test_perplexity_depends_on_words(spark):
    """Real words in a new order, also of other scripts, are less likely than texts like the trusted ones."""
    r = random.Random(12)
    follows = {w: r.sample(range(60), 3) for w in range(60)}
    names = {"en": [f"{a}{b}" for a in "bdfgklmn" for b in ("an", "or", "ist", "el", "um", "ap", "ing", "et")], "ru": [f"{a}{b}" for a in "бдфгклмн" for b in ("ан", "ор", "ист", "ел", "ум", "ап", "инг", "ет")]}

    def say(lang, ordered):
        w, said = r.randrange(60), []
        for _ in range(80):
            said.append(names[lang][w])
            w = r.choice(follows[w]) if ordered else r.randrange(60)
        return " ".join(said)

    rows = [(1000 * k + i, say(lang, i < 300), lang) for k, lang in enumerate(names) for i in range(340)]
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {x.doc_id: x.log_perplexity for x in language_model.classify(some, some.where("doc_id % 1000 < 200").select("doc_id")).collect()}
    for k in range(2):
        good = [found[1000 * k + i] for i in range(200, 300)]
        assert max(good) < min(found[1000 * k + i] for i in range(300, 340))
        assert abs(np.mean(good) - np.mean([found[1000 * k + i] for i in range(200)])) < 0.05  # trusted texts don't know themselves


def test_word_model_is_a_distribution(spark):
    """The words after each word, with what is left to unknown ones, have probabilities that sum to 1."""
    some = documents(spark, [(i, f"the {a} sat on the {b}.", "a") for i, (a, b) in enumerate((a, b) for a in "cat dog cow hen".split() for b in "mat log rug".split() if a < b or b == "log")])
    model = language_model.train(some, "test")
    values, left = language_model.word_model(some, model)
    bits = (1 << 64) - 1
    value = {x.key & bits: x.value for x in values.collect()}
    pairs = [(x.before & bits, x.word & bits, x.n, x.spelled) for x in language_model.word_counts(some, model).collect()]
    count = lambda ns: language_model.discounts(spark.createDataFrame([(n,) for n in ns], "n long"))
    cut = lambda d, n: min(d[min(n, 3) - 1], n)
    met, spelled = Counter(w for _, w, _, _ in pairs), {w: s for _, w, _, s in pairs}
    one, two, total = count(list(met.values())), count([n for _, _, n, _ in pairs]), len(pairs)
    p = {w: (n - cut(one, n)) / total + np.exp(left + spelled[w]) for w, n in met.items()}
    for v in {b for b, _, _, _ in pairs}:
        after = [n for b, _, n, _ in pairs if b == v]
        passed = sum(cut(two, n) for n in after) / sum(after)
        key = lambda w: int(language_model.key_of(np.array([v], np.uint64), np.array([w], np.uint64))[0])
        known = sum(passed * p[w] * np.exp(value.get(key(w), 0.0)) for w in p)
        unknown = passed * np.exp(left) * (1 - sum(np.exp(s) for s in spelled.values()))
        assert abs(known + unknown - 1) < 1e-4
