"""Quality by the perplexity of an interpolated modified Kneser-Ney model of the words of trusted text.

Words are runs of letters, digits and marks in lower case, single characters of scripts that don't part words, and single other
characters but blanks; they stand as 64-bit hashes. The model is over pairs of words, then words by how many different ones they
follow, then how a word is spelled, so that an unknown word has a probability too. Its tables grow with the trusted texts and
are never collected, and the table of pairs is nowhere stored: it is met in rounds, each over the keys of one remainder, whose
exchanges are dropped before the next round's. The first rounds count pairs and sum up what words and contexts need of them; from
that come discounts, weights of contexts and probabilities of words. The other rounds deal out the pairs of all documents, count
them among the trusted again, and sum a document's log probability: one number for each pair and word that the model has (how
much likelier it is than by the next order alone). Every task holds the values of the commoner words, so many at most; those of
others are joined. What only the scored, trusted document itself has
counts as unseen for it; otherwise trusted documents would look better than equally good other ones.

Spelling is a Kneser-Ney model over characters mapped to 64 symbols, four at a time (64**4 entries at most, one table lookup a character);
a symbol that many characters share is divided among them.

A language's limits are quantiles of its trusted documents' perplexities, with slack for short texts; languages with few trusted
documents take those of all.

Null, empty or blank text: no perplexity, not kept. Null language: a language of its own. Repeated rows: each counts and is scored.
Without trusted text words are as likely as their spelling of equally likely symbols, and nothing but those texts is dropped. Long
texts are cut into words in blocks. An empty table gives no rows. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.llm import common, tokens

ORDER, SYMBOLS = 4, 64
_LISTED = "abcdefghijklmnopqrstuvwxyz" + "áéíóúñüöäßàèêçëïôùûœ" + ".,;:!?'\"-()/"
_DIGIT, _SPACE, _LINE, _LETTER, _REST = range(len(_LISTED) + 1, len(_LISTED) + 6)

_symbols: np.ndarray | None = None


def symbol_table() -> np.ndarray:
    """The symbol of each code point; 0 stands before a text only."""
    global _symbols
    if _symbols is None:
        kinds = {"L": _LETTER, "N": _DIGIT, "Z": _SPACE}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _REST) for c in range(0x110000)), np.uint8, 0x110000)
        table[ord("\n")], table[[9, 11, 12, 13]] = _LINE, _SPACE
        for i, c in enumerate(_LISTED, 1):
            table[ord(c)] = i
            if len(c.upper()) == 1:
                table[ord(c.upper())] = i
        _symbols = table
    return _symbols


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A code per character, of it and the three before it, and where each text's begin, with the end."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.append(0, np.cumsum(sizes))
    pad = ORDER - 1
    s = np.zeros(len(points) + pad * len(texts), np.int32)
    place = np.arange(len(points)) + np.repeat(np.arange(1, len(texts) + 1) * pad, sizes)
    s[place] = symbol_table()[points]
    code = s[place]
    for k in range(1, ORDER):
        code = code + s[place - k] * np.int32(SYMBOLS**k)
    return code, at


def counted(texts: DataFrame) -> DataFrame:
    """code, n of all n-grams; a task sums what it reads before it is dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                new, n = np.unique(ngrams([t or "" for t in part.column("text").to_pylist()])[0], return_counts=True)
                codes, back = np.unique(np.concatenate([codes, new]), return_inverse=True)
                sums = np.bincount(back, np.concatenate([sums, n]), len(codes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(sums, pa.int64())], ["code", "n"])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """The discounts of counts 1, 2 and 3 or more from how many n-grams have counts 1 to 4."""
    have = {r.n: r["count"] for r in counts.where("n <= 4").groupBy("n").count().collect()}
    return _discounts(*(have.get(i, 0) for i in (1, 2, 3, 4)))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), top) for d, top in ((1 - 2 * y * n2 / n1, 1.0), (2 - 3 * y * n3 / n2, 2.0), (3 - 4 * y * n4 / n3, 3.0))]


def shares(counts: DataFrame) -> DataFrame:
    """code, share (discounted, of its context) and context, left (what the context passes to the order below)."""
    d = discounts(counts)
    n = F.col("n")
    cut = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
    keyed = counts.withColumn("context", F.expr(f"code div {SYMBOLS}").cast("int"))
    totals = keyed.groupBy("context").agg(F.sum("n").alias("total"), F.sum(F.least(cut, n.cast("double"))).alias("passed"))
    return keyed.join(totals, "context").select("code", (F.greatest(n - cut, F.lit(0.0)) / F.col("total")).alias("share"), "context", (F.col("passed") / F.col("total")).alias("left"))


class Model:
    """shares and lefts of each order as arrays; dense log probabilities are made once in each process."""

    def __init__(self, orders: list[dict[str, np.ndarray]]):
        self.orders = orders
        self.dense: np.ndarray | None = None

    def __getstate__(self):
        return {"orders": self.orders, "dense": None}

    def logs(self) -> np.ndarray:
        if self.dense is None:
            p = np.full(SYMBOLS, 1 / SYMBOLS, np.float32)  # each symbol, whatever came before
            for k, o in enumerate(self.orders, 1):
                size = SYMBOLS ** (k - 1)
                left = np.ones(size, np.float32)
                left[o["context"]] = o["left"]
                lower = p.reshape(-1, SYMBOLS)  # by the shorter context
                p = (left.reshape(-1, len(lower), 1) * lower[None]).reshape(-1) if k > 1 else left[0] * p
                p[o["code"]] += o["share"]
            self.dense = np.log(np.maximum(p, 1e-12, out=p), out=p)
            _dense.append(self)
        return self.dense


#: Models that hold dense log probabilities.
_dense: list[Model] = []


def release() -> None:
    """Lets the process's dense log probabilities go: workers outlive stages, and those that don't spell shouldn't hold them."""
    while _dense:
        _dense.pop().dense = None


def train(trusted: DataFrame, name: str = "lm") -> Model:
    """The model of a DataFrame with text. What is collected is bounded by SYMBOLS**ORDER, and far smaller for real text."""
    counts, orders = common.stored(counted(trusted), f"{name}-counts"), []
    for k in range(ORDER, 0, -1):
        found = shares(counts).toArrow()
        context, at = np.unique(found.column("context").to_numpy(), return_index=True)
        orders.append({"code": found.column("code").to_numpy(), "share": found.column("share").to_numpy().astype(np.float32), "context": context, "left": found.column("left").to_numpy()[at].astype(np.float32)})
        if k > 1:  # how many different symbols come before: the counts of the order below
            counts = common.stored(counts.groupBy((F.col("code") % SYMBOLS ** (k - 1)).alias("code")).agg(F.count("*").alias("n")), f"{name}-counts")
    return Model(orders[::-1])


#: Scripts that don't put blanks between words: each of their characters is a word.
_UNPARTED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x30FF), (0x31C0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_INSIDE, _ALONE = 1, 2  # kinds of characters: in runs, each a word; 0 parts words
#: What stands before and after a text.
BEGIN, END = np.uint64(1), np.uint64(2)

_characters: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def character_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: its kind, itself in lower case, the log of its share of its symbol."""
    global _characters
    if _characters is None:
        kind = np.fromiter((_INSIDE if unicodedata.category(c)[0] in "LNM" else 0 if c.isspace() else _ALONE for c in map(chr, range(0x110000))), np.uint8, 0x110000)
        for low, high in _UNPARTED:
            part = kind[low : high + 1]
            part[part == _INSIDE] = _ALONE
        lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in map(chr, range(0x110000))), np.uint32, 0x110000)
        symbols = symbol_table()
        held = np.bincount(symbols[lower == np.arange(0x110000)], minlength=SYMBOLS)
        share = 1 / np.maximum(held, 1)[symbols]
        share[48:58] = 0.05 + share[48:58] / 2  # half of all digits are ASCII's
        share[[c for c in range(0x110000) if symbols[c] == _DIGIT and not 48 <= c < 58]] /= 2
        _characters = kind, lower, np.log(share).astype(np.float32)
    return _characters


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys lie together, ascending, and where each key begins in it, with the end."""
    order = np.argsort(key)
    own = key[order]
    return order, np.flatnonzero(np.concatenate([[len(key) > 0], own[1:] != own[:-1], [True]]))


def word_stream(texts: list[str], logs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, the log probability of each one's spelling (0 without logs), and the index of its text."""
    kind, lower, share = character_tables()
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(kind[points])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[at]
    held = points[at]
    k = kind[held]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (k[1:] == _ALONE) | (k[:-1] == _ALONE) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(fresh)
    length = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at), dtype=np.int64) - np.repeat(starts, length)
    small = lower[held]
    hashes = common.mix(np.add.reduceat(common.mix((place.astype(np.uint64) << np.uint64(21)) + small + np.uint64(1)), starts) + np.uint64(3))
    owner = owner[starts].astype(np.int64)
    if logs is None:
        return hashes, np.zeros(len(starts), np.float32), owner
    order, new = grouped(hashes)  # each different word is spelled once
    once = order[new[:-1]]
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(once)), np.diff(new))
    starts, length = starts[once], length[once]
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    small = small[np.repeat(starts, length) + place]
    starts = np.cumsum(length) - length
    s = symbol_table()[small].astype(np.int32)
    code = s.copy()
    for back in range(1, ORDER):
        before = np.full(len(s), _SPACE, np.int32)
        before[back:][place[back:] >= back] = s[:-back][place[back:] >= back]
        code += before * np.int32(SYMBOLS**back)
    last = starts + length - 1
    end = (code[last] % np.int32(SYMBOLS ** (ORDER - 1))) * np.int32(SYMBOLS) + _SPACE
    spelled = np.add.reduceat((logs[code] + share[small]).astype(np.float64), starts) + logs[end]
    return hashes, spelled.astype(np.float32)[which], owner


#: Characters that are cut into words at once, but for a longer text.
AT_ONCE = 1 << 20


def pairs_of(texts: list[str], logs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word and each text's end, with the word or the beginning before it: before, word, spelling's log, index of the text.
    Texts without words have none."""
    groups = np.cumsum([len(t) for t in texts]) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(texts)]
    found = [(w, p, o + a) for a, b in zip(cuts, cuts[1:]) for w, p, o in [word_stream(texts[a:b], logs)]]
    words, spelled, owner = (np.concatenate(x) for x in zip(*found))
    if not len(words):
        return words, words, spelled, owner
    ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) + 1
    word, logp, text = np.insert(words, ends, END), np.insert(spelled, ends, np.float32(-np.log(SYMBOLS))), np.insert(owner, ends, owner[ends - 1])
    before = np.append(BEGIN, word[:-1])
    before[before == END] = BEGIN
    return before, word, logp, text


def key_of(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return common.mix(before * np.uint64(0x9E3779B97F4A7C15) + common.mix(word))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def word_counts(texts: DataFrame, model: Model) -> DataFrame:
    """key, before, word, spelled, n of all pairs; a task sums a slice of what it reads before it is dealt out."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value.logs()
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                before, word, logp, _ = pairs_of([t or "" for t in part.column("text").to_pylist()], logs)
                key, first, n = np.unique(key_of(before, word), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(key), _signed(before[first]), _signed(word[first]), pa.array(logp[first]), pa.array(n)], ["key", "before", "word", "spelled", "n"])

    made = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, before long, word long, spelled float, n long")
    return made.groupBy("key").agg(F.min("before").alias("before"), F.min("word").alias("word"), F.min("spelled").alias("spelled"), F.sum("n").alias("n"))


def word_model(trusted: DataFrame, model: Model) -> tuple[DataFrame, float]:
    """The model as a table, for other uses: key, value (what a pair or word adds to a text's log probability), raw (how often the
    trusted texts have it); and the log of what the words leave to spelling."""
    words, d, left = vocabulary(trusted, model)
    n, pairs = F.col("n"), word_counts(trusted, model)
    kept = n - F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
    met = pairs.join(words.select(F.col("word").alias("before"), "after"), "before").join(words.select("word", "logp"), "word")
    values = met.select("key", F.log1p(kept * F.exp(F.col("after") + F.col("logp"))).alias("value"), n.alias("raw"))
    return values.unionByName(words.select(F.col("word").alias("key"), "value", "raw")), left


#: Pairs are met in so many rounds, each over the keys of one remainder, so that a round's exchange is gone before the next one's.
ROUNDS = 4
#: So many rounds count the pairs of trusted texts.
COUNT_ROUNDS = 2
#: Words whose values every task holds, at most, whatever the corpus: the commoner ones. Values of the others are joined.
HEAVY = 500_000
#: Bytes of text, and texts, whose pairs are summed before they are dealt out.
SLICE, TEXTS = 3 << 20, 60_000
#: Texts that a worker gets at once, at most.
BATCH = 2500
_BLOCK = "part int, keys binary, befores binary, words binary, ns binary, gains binary, values binary, raws binary, met binary, owners binary, rows binary, sures binary"
_BLOCKS = {"keys": "<u8", "befores": "<u8", "words": "<u8", "ns": "<u4", "gains": "<f4", "values": "<f8", "raws": "<i8", "met": "<u2", "owners": "<u2", "rows": "<i8", "sures": "?"}


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(batch), TEXTS):
        yield from tokens.slices(batch.slice(a, TEXTS), "text", size=SLICE)


def _texts(part: pa.RecordBatch) -> list[str]:
    return [t or "" for t in part.column("text").to_pylist()]


def _cuts(key: np.ndarray, parts: int) -> np.ndarray:
    """Where the keys of each part begin, with the end. key: sorted; a part has a range of keys."""
    return np.searchsorted((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))


def _blocks(found: list[tuple[int, dict[str, np.ndarray]]]) -> pa.RecordBatch:
    """A row for each part with the bytes of its arrays."""
    columns = [pa.array([x[c].astype(t, copy=False).tobytes() if c in x else None for _, x in found], pa.binary()) for c, t in _BLOCKS.items()]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), *columns], ["part", *_BLOCKS])


def _read(batches: Iterator[pa.RecordBatch]) -> list[dict[str, np.ndarray]]:
    return [{c: np.frombuffer(x, _BLOCKS[c]) for c, x in row.items() if c != "part" and x is not None} for batch in batches for row in batch.to_pylist()]


def _joined(blocks: list[dict[str, np.ndarray]], column: str) -> np.ndarray:
    """The arrays of a column, one behind the other; the blocks don't hold them any more."""
    return np.concatenate([np.zeros(0, _BLOCKS[column]), *(x.pop(column) for x in blocks)]).astype(_BLOCKS[column], copy=False)


def _parts(df: DataFrame, rounds: int) -> int:
    """Partitions of a round: together the rounds have half as many again as one exchange, but a round enough for all cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-3 * common.shuffle_partitions(df.sparkSession) // (2 * rounds)))


def spellings(texts: DataFrame, model: Model) -> DataFrame:
    """word, spelled of each slice's words."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value.logs()
        for batch in common.trimmed(batches):
            for part in _slices(batch):
                _, word, logp, _ = pairs_of(_texts(part), logs)
                order, new = grouped(word)
                word, first = word[order[new[:-1]]], order[new[:-1]]
                yield pa.RecordBatch.from_arrays([_signed(word), pa.array(logp[first])], ["word", "spelled"])

    return texts.select("text").mapInArrow(run, "word long, spelled float")


_COUNTS = ("n", "raw", "total", "pairs", "c1", "c2", "c3", "c4")


def counts_of_words(texts: DataFrame, round_: int) -> DataFrame:
    """By word, of the pairs of a round: n (different words before it), raw (occurrences), total (occurrences as the word before),
    pairs (different words after it), c1 to c4 (those met once to four times). A word has a row from each partition that has it."""
    parts, rounds = _parts(texts, COUNT_ROUNDS), COUNT_ROUNDS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.trimmed(batches):
            for part in _slices(batch):
                before, word, _, _ = pairs_of(_texts(part), None)
                key = key_of(before, word)
                at = np.flatnonzero(key % np.uint64(rounds) == np.uint64(round_))
                order, new = grouped(key[at])
                n, at = np.diff(new), at[order[new[:-1]]]
                before, word, cut = before[at], word[at], _cuts(key[at], parts)
                yield _blocks([(p, {"befores": before[a:b], "words": word[a:b], "ns": n[a:b]}) for p, (a, b) in enumerate(zip(cut, cut[1:])) if a < b])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _read(common.trimmed(batches))
        before, word, ns = (_joined(held, c) for c in ("befores", "words", "ns"))
        order, new = grouped(key_of(before, word))
        first = order[new[:-1]]
        n = np.add.reduceat(ns[order].astype(np.int64), new[:-1]) if len(ns) else np.zeros(0, np.int64)
        name, at = np.unique(np.concatenate([word[first], before[first]]), return_inverse=True)
        own, context = at[: len(first)], at[len(first) :]
        sums = [np.bincount(own, minlength=len(name)), np.bincount(own, n, len(name)), np.bincount(context, n, len(name)), np.bincount(context, minlength=len(name))]
        sums += [np.bincount(context[n == k], minlength=len(name)) for k in (1, 2, 3, 4)]
        yield pa.RecordBatch.from_arrays([_signed(name), *(pa.array(x.astype(np.int64)) for x in sums)], ["word", *_COUNTS])

    dealt = texts.select("text").mapInArrow(deal, _BLOCK).repartitionById(parts, F.col("part"))
    return dealt.mapInArrow(count, "word long, " + ", ".join(f"{c} long" for c in _COUNTS))


def vocabulary(texts: DataFrame, model: Model) -> tuple[DataFrame, list[float], float]:
    """word, weight (the occurrences), value (what the word adds to a text's log probability), raw (-1 for what is only before
    others), after and logp (a pair's gain is log1p(its discounted count * exp(after of the first + logp of the second))); the
    discounts of pairs; the log of what the words leave to spelling."""
    with common.scratch(texts.sparkSession, "counts"):
        counts = [common.stored(counts_of_words(texts, k).groupBy("word").agg(*(F.sum(c).alias(c) for c in _COUNTS)), "word-counts") for k in range(COUNT_ROUNDS)]
        spelled = common.stored(spellings(texts, model).groupBy("word").agg(F.min("spelled").alias("spelled")), "spellings")
        rows = spelled.select("word", "spelled", *(F.lit(0).cast("long").alias(c) for c in _COUNTS))
        for x in counts:
            rows = rows.unionByName(x.withColumn("spelled", F.lit(None).cast("float")))
        words = common.stored(rows.groupBy("word").agg(F.min("spelled").alias("spelled"), *(F.sum(c).alias(c) for c in _COUNTS)), "words")
        met = words.where("n > 0")
        d, of_pairs = discounts(met), words.agg(*(F.sum(f"c{k}") for k in (1, 2, 3, 4))).first()
        two = _discounts(*(x or 0 for x in of_pairs))
        n = F.col("n")
        cut = F.least(F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2]), n.cast("double"))
        total, passed = met.agg(F.sum("n"), F.sum(cut)).first()
        left = float(np.log(passed / total)) if total else 0.0
        base = F.col("spelled") + F.lit(left)
        logp = F.when(n > 0, F.log((n - cut) / F.lit(float(total or 1)) + F.exp(base)))
        after = F.when(F.col("total") > 0, F.log((two[0] * F.col("c1") + two[1] * F.col("c2") + two[2] * (F.col("pairs") - F.col("c1") - F.col("c2"))) / F.col("total")))
        made = words.select("word", F.greatest("raw", "total").alias("weight"), F.when(n > 0, F.col("raw")).otherwise(-1).alias("raw"), logp.alias("logp"), base.alias("base"), after.alias("left"), "total")
        value = F.coalesce(F.col("logp") - F.col("base"), F.lit(0.0)) + F.coalesce("left", F.lit(0.0))
        return common.stored(made.select("word", "weight", value.alias("value"), "raw", (-F.log(F.col("total").cast("double")) - F.col("left")).alias("after"), (-F.col("logp")).alias("logp")), "vocabulary", last=True), two, left


class Heavy:
    """Values of the commoner words, in arrays by word."""

    def __init__(self, found: pa.Table):
        word = found.column("word").to_numpy().view(np.uint64)
        order = np.argsort(word)
        self.word = word[order]
        self.shift = np.uint64(63 - max(len(word), 1).bit_length())
        self.begins = np.searchsorted(self.word >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)  # of the words with equal first bits
        self.raw = found.column("raw").to_numpy()[order]
        self.value, self.after, self.logp = (found.column(c).to_numpy(zero_copy_only=False).astype(float)[order] for c in ("value", "after", "logp"))  # nan for null

    def at(self, word: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for others."""
        found, slot = np.full(len(word), -1), (word >> self.shift).astype(np.int64)
        place, end = self.begins[slot], self.begins[slot + 1]
        open_ = np.flatnonzero(place < end)
        place, end = place[open_], end[open_]
        while len(open_):
            same = self.word[place] == word[open_]
            found[open_[same]] = place[same]
            more = np.flatnonzero(~same & (place + 1 < end))
            open_, place, end = open_[more], place[more] + 1, end[more]
        return found


def parted(words: DataFrame) -> tuple[Heavy, DataFrame | None]:
    """The words that every task holds, and the others, or None. Words are parted by weight, to an eighth of a power of 2."""
    level = F.floor(F.log2(F.col("weight").cast("double")) * 8)
    levels = sorted(((x.level, x["count"]) for x in words.groupBy(level.alias("level")).count().collect()), reverse=True)
    sums = np.cumsum([n for _, n in levels])
    taken = int(np.searchsorted(sums, HEAVY, side="right"))
    if taken == len(levels):
        return Heavy(words.toArrow()), None
    least = levels[taken - 1][0] if taken else float("inf")
    return Heavy(words.where(level >= least).toArrow()), words.where(level < least)


def rare_keys(texts: DataFrame, heavy, rare: DataFrame) -> DataFrame:
    """key, gain, value, raw: gain (after and logp, added up) of the pairs of texts with a word of rare, value and raw of those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held = heavy.value
        for batch in common.trimmed(batches):
            for part in _slices(batch):
                before, word, _, _ = pairs_of(_texts(part), None)
                a, b = held.at(before), held.at(word)
                at = np.flatnonzero((a < 0) | (b < 0))
                key, first = np.unique(key_of(before[at], word[at]), return_index=True)
                before, word, a, b = (x[at[first]] for x in (before, word, a, b))
                for own, other, values, name in ((a, b, held.logp, before), (b, a, held.after, word)):
                    x = np.flatnonzero(own < 0)
                    has = other[x] >= 0
                    plus = np.zeros(len(x))
                    plus[has] = values[other[x][has]]
                    yield pa.RecordBatch.from_arrays([_signed(key[x]), _signed(name[x]), pa.array(np.full(len(x), own is a)), pa.array(plus)], ["key", "word", "first", "plus"])

    found = texts.select("text").mapInArrow(run, "key long, word long, first boolean, plus double").groupBy("key", "first").agg(F.min("word").alias("word"), F.min("plus").alias("plus"))
    gains = found.join(rare, "word").groupBy("key").agg(F.sum(F.col("plus") + F.when(F.col("first"), F.col("after")).otherwise(F.col("logp"))).cast("float").alias("gain"))
    return gains.select("key", "gain", F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("raw")).unionByName(rare.select(F.col("word").alias("key"), F.lit(None).cast("float").alias("gain"), "value", "raw"))


def marked(docs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch], np.ndarray]]:
    """row (a hash of doc_id and text), node, lang, text and what says, of a batch of these, which rows are trusted. Texts are joined
    only where membership() isn't exact."""
    bits, test, exact = common.membership(docs, trusted)
    text = F.col("text").cast("string")
    named = docs.select(F.xxhash64("doc_id", text).alias("row"), F.col("doc_id").cast("long").alias("node"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    if exact:
        return named.select("*", *common.places(bits)), lambda batch: test(batch.column("node"), batch.column("word"), batch.column("place"))
    sure = trusted.select("node", F.lit(True).alias("sure"))
    return named.join(sure, "node", "left").withColumn("sure", F.coalesce("sure", F.lit(False))), lambda batch: batch.column("sure").to_numpy(zero_copy_only=False)


def gains(docs: DataFrame, sure: Callable[[pa.RecordBatch], np.ndarray], heavy, rare: DataFrame | None, d: list[float], round_: int) -> DataFrame:
    """row, gain: what the pairs and rare words of a round add to the log probability of each document, a row from each partition that
    has any. docs: of marked(). Pairs are counted and scored in one exchange: a pair's count is what the trusted among its documents have."""
    parts, rounds, some = _parts(docs, ROUNDS), ROUNDS, rare is not None

    def of_round(key: np.ndarray) -> np.ndarray:
        return np.flatnonzero(key % np.uint64(rounds) == np.uint64(round_))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held = heavy.value
        for batch in common.trimmed(batches):
            for part in _slices(batch.append_column("trust", pa.array(sure(batch)))):
                trust, row = part.column("trust").to_numpy(zero_copy_only=False), part.column("row").to_numpy()
                before, word, _, text = pairs_of(_texts(part), None)
                key = key_of(before, word)
                at = of_round(key)
                singles = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                if some:  # words whose values aren't held, and the beginnings of texts
                    for x, owner in ((word, text), (np.full(len(begins := np.unique(text)), BEGIN), begins)):
                        own = of_round(x)
                        own = own[held.at(x[own]) < 0]
                        singles[0].append(x[own])
                        singles[1].append(owner[own])
                key, owner, before, word = np.concatenate([key[at], *singles[0]]), np.concatenate([text[at], *singles[1]]), before[at], word[at]
                if not len(key):
                    continue
                order, new = grouped(key)
                key, source = key[order[new[:-1]]], order[new[:-1]]
                both = np.sort(np.repeat(np.arange(len(key)) << 16, np.diff(new)) | owner[order])  # key and text, which is below TEXTS
                first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1], [True]]))
                n, both = np.diff(first), both[first[:-1]]
                owner = both & 0xFFFF
                bounds = np.searchsorted(both, np.arange(len(key) + 1) << 16)
                gain = np.full(len(key), np.nan, np.float32)
                asked = np.flatnonzero(np.logical_or.reduceat(trust[owner], bounds[:-1]) & (source < len(before)))
                a, b = held.at(before[source[asked]]), held.at(word[source[asked]])
                there = (a >= 0) & (b >= 0)
                gain[asked[there]] = held.after[a[there]] + held.logp[b[there]]
                found, cut = [], _cuts(key, parts)
                for p, (i, j) in enumerate(zip(cut, cut[1:])):
                    if i < j:
                        whose = owner[bounds[i] : bounds[j]]
                        there = np.zeros(len(part), bool)
                        there[whose] = True
                        found.append((p, {"keys": key[i:j], "gains": gain[i:j], "met": np.diff(bounds[i : j + 1]), "owners": (np.cumsum(there) - 1)[whose], "ns": n[bounds[i] : bounds[j]], "rows": row[there], "sures": trust[there]}))
                yield _blocks(found)

    def deal_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            at = of_round(key)
            at = at[np.argsort(key[at])]
            gain, value = (batch.column(c).to_numpy(zero_copy_only=False).astype(float)[at] for c in ("gain", "value"))
            key, raw, cut = key[at], batch.column("raw").to_numpy()[at], _cuts(key[at], parts)
            yield _blocks([(p, {"keys": key[i:j], "gains": gain[i:j], "values": value[i:j], "raws": raw[i:j]}) for p, (i, j) in enumerate(zip(cut, cut[1:])) if i < j])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _read(common.trimmed(batches))
        held, known = [x for x in read if "rows" in x], [x for x in read if "raws" in x]
        key = _joined(held, "keys")
        order, new = grouped(key)
        at = np.empty(len(key), np.int32)
        at[order] = np.repeat(np.arange(len(new) - 1, dtype=np.int32), np.diff(new))
        key = key[order[new[:-1]]]
        base = np.cumsum([0, *(len(x["rows"]) for x in held)])[:-1]
        owner = np.concatenate([np.zeros(0, np.int32), *(x.pop("owners") + np.int32(b) for x, b in zip(held, base))])
        n, trust = _joined(held, "ns"), _joined(held, "sures")
        which = np.repeat(at, _joined(held, "met"))
        raw = np.bincount(which, n * trust[owner], len(key)).astype(np.int64)
        gain, value, found = np.full(len(key), np.nan), np.zeros(len(key)), _joined(held, "gains")
        gain[at[~np.isnan(found)]] = found[~np.isnan(found)]
        if len(key) and known:
            name = _joined(known, "keys")
            place = np.minimum(np.searchsorted(key, name), len(key) - 1)
            met = key[place] == name
            own, plus, words = _joined(known, "gains"), _joined(known, "values"), _joined(known, "raws")
            is_pair = met & ~np.isnan(own)
            gain[place[is_pair]] = own[is_pair]
            is_word = met & ~np.isnan(plus)
            value[place[is_word]], raw[place[is_word]] = plus[is_word], words[is_word]
        pair = np.flatnonzero(~np.isnan(gain) & (raw > 0))
        with np.errstate(divide="ignore"):
            left = np.log(np.maximum(raw[pair] - np.array(d)[np.minimum(raw[pair], 3) - 1], 0.0))
        value[pair] = np.logaddexp(0.0, left + gain[pair])
        adds = np.where(trust[owner] & (n == raw[which]), 0.0, n * value[which])
        sums, row = np.bincount(owner, adds, len(trust)), _joined(held, "rows")
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(row[some]), pa.array(sums[some])], ["row", "gain"])

    dealt = docs.mapInArrow(deal, _BLOCK)
    if some:
        dealt = dealt.unionByName(rare.mapInArrow(deal_rare, _BLOCK))
    return dealt.repartitionById(parts, F.col("part")).mapInArrow(score, "row long, gain double").groupBy("row").agg(F.sum("gain").alias("gain"))


def bases(docs: DataFrame, sure: Callable[[pa.RecordBatch], np.ndarray], model, heavy, left: float) -> DataFrame:
    """row, doc_id, lang, n_chars, sure, base (the log probability by spelling and by the words that every task holds): a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, held = model.value.logs(), heavy.value
        begin = held.at(np.array([BEGIN]))[0]
        for batch in common.trimmed(batches):
            for part in tokens.slices(batch.append_column("trust", pa.array(sure(batch))), "text"):
                trust, texts = part.column("trust").to_numpy(zero_copy_only=False), _texts(part)
                _, word, logp, text = pairs_of(texts, logs)
                n = np.bincount(text, minlength=len(texts))
                order, new = grouped(word)
                at = np.empty(len(word), np.int64)
                at[order] = np.repeat(np.arange(len(new) - 1), np.diff(new))
                word = word[order[new[:-1]]]
                place = held.at(word)
                value, raw = np.zeros(len(word)), np.full(len(word), -1)
                value[place >= 0], raw[place >= 0] = held.value[place[place >= 0]], held.raw[place[place >= 0]]
                base = np.bincount(text, logp, len(texts)) + left * n + np.bincount(text, value[at], len(texts))
                own = np.flatnonzero(trust[text] & (raw[at] > 0) & (raw[at] <= n[text]))  # words that only this document may have
                both, times = np.unique(text[own] * len(word) + at[own], return_counts=True)
                both, times = (x[times == raw[both % max(len(word), 1)]] for x in (both, times))
                base -= np.bincount(both // max(len(word), 1), times * value[both % max(len(word), 1)], len(texts))
                if begin >= 0:
                    base += held.value[begin]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("node"), part.column("lang"), pa.array([len(t) for t in texts], pa.int64()), pa.array(trust), pa.array(base, mask=n == 0)], ["row", "doc_id", "lang", "n_chars", "sure", "base"])

    return docs.mapInArrow(run, "row long, doc_id long, lang string, n_chars long, sure boolean, base double")


def perplexities(docs: DataFrame, model: Model, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, log_perplexity (a character's, null without words), sure (among the trusted): a row per document.
    trusted: node."""
    context, texts = docs.sparkSession.sparkContext, common.texts_of(docs, trusted)
    words, d, left = vocabulary(texts, model)
    held, others = parted(words)
    heavy = context.broadcast(held)
    rare = None if others is None else common.stored(rare_keys(texts, heavy, others), "rare-keys")
    named, sure = marked(docs, trusted)
    based = common.stored(bases(named, sure, context.broadcast(model), heavy, left), "bases")
    sums = based.select("row", F.lit(0.0).alias("gain"), F.lit(1).alias("copies"))
    for k in range(ROUNDS):
        sums = sums.unionByName(common.stored(gains(named, sure, heavy, rare, d, k), "gains").withColumn("copies", F.lit(0)))
    sums = sums.groupBy("row").agg((F.sum("gain") / F.sum("copies")).alias("gain"))
    return based.join(sums, "row").select("doc_id", "lang", "n_chars", (-(F.col("base") + F.col("gain")) / F.col("n_chars")).alias("log_perplexity"), "sure")


def classify(docs: DataFrame, trusted_ids: DataFrame, low: float = 0.002, high: float = 0.99, least: int = 50, margin: float = 0.05, slack: float = 3.0) -> DataFrame:
    """doc_id, lang, n_chars, log_perplexity, perplexity, low, high, kept. trusted_ids: doc_id of the trusted documents."""
    spark = docs.sparkSession
    # the shuffle files of a query go when it ends, not when the driver happens to collect its garbage
    with common.settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH)}):
        with common.scratch(spark, "language-model"):
            ids = common.stored(trusted_ids.select(F.col("doc_id").cast("long").alias("node")).where("node IS NOT NULL").distinct(), "trusted")
            scored = common.stored(perplexities(docs, train(common.texts_of(docs, ids)), ids), "perplexities", last=True)
    sure = scored.where("sure AND log_perplexity IS NOT NULL")
    scored = scored.drop("sure")
    limits = lambda df: df.agg(F.count("*").alias("n"), F.percentile_approx("log_perplexity", F.array(F.lit(low), F.lit(high)), 10_000).alias("q"))
    every = limits(sure).first()
    lo, hi = every.q if every.q else (float("-inf"), float("inf"))
    by_lang = limits(sure.groupBy("lang")).where(F.col("n") >= least).select(F.col("lang").alias("_lang"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    joined = scored.join(by_lang, scored["lang"].eqNullSafe(by_lang["_lang"]), "left").drop("_lang")
    room = F.lit(margin) + F.lit(slack) / F.sqrt(F.greatest("n_chars", F.lit(1)).cast("double"))
    joined = joined.withColumns({"low": F.coalesce("low", F.lit(lo)) - room, "high": F.coalesce("high", F.lit(hi)) + room})
    return joined.withColumn("perplexity", F.exp("log_perplexity")).withColumn("kept", F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False)))
