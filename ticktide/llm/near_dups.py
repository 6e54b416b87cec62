"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct word shingles; documents with equal sets are one class and only its smallest doc_id goes on.
1. Sketch: the K smallest shingle hashes. Similar documents share some number of sketch values, least_shared(), but for a chance
   below MISS a pair at the threshold (sets of up to K shingles surely), so each needs inverted lists only for its rarest
   values beyond that number: two such lists must meet. Values that one document alone has need no list at all.
2. Candidates from the lists in rounds that never pair all members: first each list's smallest member with the others, then
   a member picked by hash, each time only across components not yet linked, and of those a member meets the ones with which it
   shares most lists. In the end short lists are paired, and in long
   ones members are told apart by how they differ from a central member, one whose lists are long: two that are similar, of
   which one isn't similar to that member, must share differences, so their rarest differences meet in lists of their own. How
   many differences each has, and how many of them any other has, bounds a pair's similarity before it is taken up. Long
   lists are dealt out in parts, so that no value's members meet in one task.
3. The count of common values in the union's sketch drops candidates with the same chance of a mistake, exact Jaccard of the
   full sets decides on the rest. Links are joined into components by label propagation with pointer jumping.

Null, empty or blank text: no shingles, linked with nothing. Fewer words than a shingle: the whole sequence is the one shingle.
Long texts are hashed in blocks of words. Rows that share a doc_id count as one document with each of their texts; each row is
returned, rows without a doc_id too, unlinked. Ties: the smallest doc_id stands for its class and component. An empty table
gives no rows. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticktide.llm import common, tokens

K = 64
#: The chance, a pair at the threshold, that sketches hide its similarity.
MISS = 1e-9
#: Words of a shingle and the least Jaccard similarity in hundredths, unless told otherwise.
WORDS, PERCENT = 5, 80
#: Lists up to this long are paired in the end; longer ones are told apart by differences, which finds the same links.
SHORT = 8
#: Pivots that a member is compared with in each round before the last steps.
PIVOTS = 2
#: Members of a list that meet its pivot in one task.
PART = 256

_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def least_shared(k: int, percent: int) -> int:
    """How many of the k smallest values of a union two sets of that similarity have in common, but for a chance of MISS."""
    p, below, m = percent / 100, 0.0, 0
    while m <= k and (below := below + math.comb(k, m) * p**m * (1 - p) ** (k - m)) <= MISS:
        m += 1
    return m


def word_hashes(texts: pa.Array, blank: np.ndarray = _blank) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z as a-z, and where each text's begin, with the end. blank: bytes between words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.append(True, ~inside[:-1])))
    ends = np.flatnonzero(inside & (edge[1:] | np.append(~inside[1:], True))) + 1
    return tokens.run_hashes(_lower[data], starts, ends, inside), np.searchsorted(starts, at)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending (63 bits)."""
    hashes, at = word_hashes(texts)
    sets = []
    rolled = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(rolled)]
    rolled = common.mix(rolled) >> np.uint64(1)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            sets.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = b - a
            for h in hashes[a:b].tolist():
                short = (short * 0x9E3779B97F4A7C15 + h) % (1 << 64)
            sets.append(common.mix(np.array([short], np.uint64)) >> np.uint64(1))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, print (of the whole set), sketch: a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        tokens.release()
        for batch in common.trimmed(batches):
            for part in tokens.slices(batch, "text", size=1 << 20):
                sets = shingle_sets(part.column("text"), words)
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                sketches = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(min(len(s), K) for s in sets)]), pa.int32()), pa.array(np.concatenate([s[:K] for s in sets] or [np.zeros(0, np.uint64)]).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), sketches], ["doc_id", "n_shingles", "print", "sketch"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, print binary, sketch array<long>")


def inverted_lists(sets: DataFrame) -> DataFrame:
    """value, node, n, held, met, size: lists in which two sets that share at least `least` values are sure to meet: those of
    the rarest held - least + 1 values of each. met: how many of its values any other set has; size: sets that have the value.
    sets: node, n, held (values), least, values."""
    keyed = sets.withColumn("id", F.xxhash64("node", "held", F.element_at(F.concat("values", F.array(F.lit(0))), 1)))
    exploded = keyed.select("id", "node", "n", "held", "least", F.explode("values").alias("value"))
    shared = exploded.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    met = exploded.join(shared, "value")  # values of one set alone come first in the order and are only counted
    by_set = met.groupBy("id", "node", "n", "held", "least").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("some"))  # of one document
    rare = by_set.select("node", "n", "held", F.size("some").alias("met"), F.explode(F.slice("some", 1, F.greatest(F.size("some") - F.col("least") + 1, F.lit(0)))).alias("x"))
    return rare.select("node", "n", "held", "met", "x.value", F.col("x.df").alias("size")).distinct()


def _parts() -> F.Column:
    return F.ceil(F.col("size") / PART)


def dealt(lists: DataFrame) -> DataFrame:
    """lists with the part of its list that each member is in."""
    return lists.withColumn("part", F.pmod(F.xxhash64("node"), _parts()))


def to_all_parts(values: DataFrame) -> DataFrame:
    """A row per value (value, size) for each part of its list."""
    return values.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), _parts() - 1))).drop("size")


def slope_of(percent: int) -> float:
    """Similar sets x and y differ in at most slope * (|x| + |y|) values."""
    return (100 - percent) / (100 + percent)


def differences(stars: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """How nodes differ from their pivots: node, pivot, n, held, linked (similar to the pivot), values (of the symmetric
    difference, told apart by pivot), least (how many of them it must share with whatever it may be linked to)."""
    t = percent / 100
    slope = slope_of(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        held: tuple = (None, None)
        for batch in common.trimmed(batches):
            for part in tokens.slices(batch, "ta", "tb"):
                own, rows = shingle_sets(part.column("ta"), words), []
                for x, pivot, text in zip(own, part.column("b").to_pylist(), part.column("tb").to_pylist()):
                    if held[0] != text:
                        held = (text, shingle_sets(pa.array([text], pa.string()), words)[0])
                    p = held[1]
                    inter = len(np.intersect1d(x, p, assume_unique=True))
                    union = len(x) + len(p) - inter
                    linked = 100 * inter >= percent * union
                    d = np.setxor1d(x, p, assume_unique=True)
                    least = len(d) - slope * len(x) * (1 + 1 / t)
                    if linked:  # partners aren't similar to the pivot
                        least = max(least, (len(d) - slope * (len(x) - len(p))) / 2)
                    own_values = (common.mix(d ^ common.mix(np.array([pivot], np.int64).view(np.uint64))) >> np.uint64(1)).astype(np.int64)
                    rows.append((len(x), len(d), linked, own_values, max(1, int(np.ceil(least - 1e-9)))))
                n, size, linked, values, least = zip(*rows) if rows else ((),) * 5
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(n, pa.int64()), pa.array(size, pa.int32()), pa.array(linked, pa.bool_()), pa.array(least, pa.int32()), lists], ["node", "pivot", "n", "held", "linked", "least", "values"])

    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    pairs = stars.select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "node long, pivot long, n long, held int, linked boolean, least int, values array<long>")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes with links. Both directions needn't be given."""
    both = common.stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = common.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(around, labels["node"] == around["a"]).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = lower.select(F.col("node").alias("via"), F.col("component").alias("top"))
        labels = common.stored(lower.join(up, lower["component"] == up["via"]).select("node", "was", F.least("component", "top").alias("component")), "labels")
        if labels.where("component < was").isEmpty():
            return labels.select("node", "component")
        labels = labels.drop("was")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after links (a, b) between nodes are added: only the components that they join are labelled anew."""
    if links.isEmpty():
        return labels
    side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    between = links.join(side("a"), "a").join(side("b"), "b").where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("top"))
    return common.stored(labels.join(joined, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "node-labels")


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches don't speak against the threshold: Jaccard among the K smallest of the union."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    common_values = F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb")))
    least = F.element_at(F.array(*[F.lit(least_shared(k, percent)) for k in range(1, K + 1)]), F.size(union))
    return both.where(common_values >= least).select("a", "b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        held: tuple = (None, None)
        for batch in common.trimmed(batches):
            for part in tokens.slices(batch, "ta", "tb"):
                own = shingle_sets(part.column("ta"), words)
                keep = []
                for i, text in enumerate(part.column("tb").to_pylist()):
                    if held[0] != text:  # pairs come sorted by b
                        held = (text, shingle_sets(pa.array([text], pa.string()), words)[0])
                    inter = len(np.intersect1d(own[i], held[1], assume_unique=True))
                    union = len(own[i]) + len(held[1]) - inter
                    keep.append(union > 0 and 100 * inter >= percent * union)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per document."""
    with common.scratch(docs.sparkSession, "near-duplicates"):
        return common.stored(_near_duplicates(docs, words, percent), "near-duplicates", last=True)


def _near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    sets = common.stored(sketched(docs, words), "sketches")
    held = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = common.stored(held.groupBy("print").agg(F.min("doc_id").alias("node")), "classes")
    classes = held.join(first, (held["print"] == first["print"]) & (held["doc_id"] == first["node"]), "left_semi").select(F.col("doc_id").alias("node"), "print", F.col("n_shingles").alias("n"), "sketch")
    classes = common.stored(classes.dropDuplicates(["print", "node"]).drop("print"), "nodes")
    least = F.least(F.lit(max(least_shared(K, percent), 1)), F.ceil(F.col("n") * percent / 100.0)).cast("int")
    lists = common.stored(inverted_lists(classes.select("node", "n", F.size("sketch").alias("held"), least.alias("least"), F.col("sketch").alias("values"))).drop("held", "met"), "rare")
    lists = common.stored(lists.drop("size").join(lists.groupBy("value").agg(F.count("*").alias("size")).where("size > 1"), "value"), "lists")
    nodes = common.stored(lists.select("node").distinct(), "listed")
    texts = common.stored(common.texts_of(docs, nodes), "texts")
    sketches = common.stored(classes.join(nodes, "node", "left_semi").select("node", "sketch"), "listed-sketches")
    labels, tried = nodes.select("node", F.col("node").alias("component")), None

    def across(some: DataFrame) -> DataFrame:
        """Those of the lists whose members aren't in one component, with each member's component."""
        named = some.join(labels, "node")
        mixed = named.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("size").alias("size")).where("lo < hi").select("value", "size")
        return common.stored(dealt(named).join(to_all_parts(mixed), ["value", "part"], "left_semi").drop("part"), "open-lists")

    def tested(met: DataFrame, how: str) -> tuple[DataFrame, DataFrame]:
        """What is left to verify, and the links, among pairs of nodes with their sizes and components."""
        fits = (100 * F.col("n") >= percent * F.col("pn")) & (100 * F.col("pn") >= percent * F.col("n"))
        pairs = met.where((F.col("component") != F.col("pc")) & fits).select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
        new = pairs.join(tried, ["a", "b"], "left_anti") if tried else pairs
        new = common.stored(estimated(new, sketches, percent), f"candidates-{how}")
        return new.union(tried) if tried else new, new if new.isEmpty() else common.stored(verified(new, texts, words, percent), f"links-{how}")

    def best(met: DataFrame) -> DataFrame:
        """Of each node's pivots those with which it shares most lists. What is left out here later steps find."""
        shared = met.where("component != pc").groupBy("node", "n", "component", "pivot", "pn", "pc").agg(F.count("*").alias("overlap"))
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("overlap"), "pivot"))
        return shared.withColumn("place", place).where(F.col("place") <= PIVOTS)

    other = lambda some, *more: some.select("value", F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("component").alias("pc"), *more)
    open_ = lists.withColumn("component", F.col("node"))
    for how, order in (("smallest", F.struct("node")), ("hashed", F.struct(F.xxhash64("node", "value"), F.col("node")))):
        pivots = open_.groupBy("value").agg(F.min_by(F.struct("node", "n", "component"), order).alias("p"), F.max("size").alias("size")).select("value", "p.node", "p.n", "p.component", "size")
        tried, links = tested(best(dealt(open_).join(to_all_parts(other(pivots, "size")), ["value", "part"])), how)
        labels = merged(labels, links)
        open_ = across(lists)
    short, long = open_.where(F.col("size") <= SHORT), open_.where(F.col("size") > SHORT)
    tried, links = tested(short.join(other(short), "value").where("node > pivot"), "short")
    central = lists.groupBy("node").agg(F.sum("size").alias("weight"))
    pivots = long.join(central, "node").groupBy("value").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("pivot"), F.max("size").alias("size"))
    stars = dealt(long).join(to_all_parts(pivots), ["value", "part"]).where("node != pivot").select("node", "pivot").distinct()
    apart = common.stored(differences(stars, texts, words, percent), "differences")
    labels = merged(labels, links.union(apart.where("linked").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b"))))
    if not apart.isEmpty():
        inner = across(inverted_lists(apart))
        partners = other(inner, F.col("held").alias("ph"), F.col("met").alias("pm"))
        differ = F.col("held") + F.col("ph") - 2 * F.least("met", "pm")  # at least
        near = differ <= slope_of(percent) * (F.col("n") + F.col("pn")) + 1e-9
        tried, links = tested(inner.join(partners, "value").where((F.col("node") > F.col("pivot")) & near), "long")
        labels = merged(labels, links)
    named = first.join(labels, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    found = sets.join(named, (sets["print"] == named["print"]) & (sets["n_shingles"] > 0), "left").drop(named["print"])
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
