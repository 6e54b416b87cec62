"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Document rates r between 0 and the limit minimise the entropy relative to one copy each,
under one constraint a source: the rates times the sizes sum to the target. In the dual each source has one multiplier m and
a document of relative size x has r = limit / (1 + (limit - 1) * exp(-m * x)), an exponential tilt of the odds r / (limit - r).
Newton steps, kept inside a bracket, solve all sources' duals at once over the table of (source, size) counts. Rates become
copies by their floor and one more where a hash of doc_id and text is low enough; the bound on that hash is set for each source,
in two rounds of binned sums and then hash by hash, so that the words taken meet the target to about half a document. Of equal
rows (id, text and source) at the bound as many get one more as are needed; they are numbered in shards.

Null text: size 0. Null source: a source of its own, last in order. Size 0, of texts without words: nothing taken. Null and
repeated doc_ids: each row counts. Long texts count by their words. An empty table gives no rows. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticktide.llm import common


def with_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """left and the one row of right that has its source, null matching null."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, left["source"].eqNullSafe(right["_source"])).drop("_source")


def numbered(sources: DataFrame) -> DataFrame:
    """Adds place, from 0 by code point order of source, null last: counted in ranges, whatever the number of sources."""
    spark, order = sources.sparkSession, F.col("source").asc_nulls_last()
    ranged = common.stored(sources.repartitionByRange(common.shuffle_partitions(spark), order).withColumn("slot", F.spark_partition_id()), "ordered-sources")
    before, upto = [], 0
    for r in ranged.groupBy("slot").count().orderBy("slot").collect():  # as many as shuffle partitions
        before.append((r.slot, upto))
        upto += r["count"]
    placed = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("slot").orderBy(order)) - 1)
    return placed.join(F.broadcast(spark.createDataFrame(before, "slot int, upto long")), "slot").withColumn("place", F.col("upto") + F.col("nth")).drop("slot", "nth", "upto")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2) -> DataFrame:
    """Adds target to (source, source_size): weights repeat by code point order, null last; what exceeds limit is shared again."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    weighed = common.stored(numbered(sources).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))).drop("place"), "weights")
    goal, top = share * total, F.col("source_size") * float(limit)
    level, capped = 0.0, -1
    while True:  # a source once at its limit stays there, so this ends
        at_limit = F.col("weight") * F.lit(level) >= top
        row = weighed.agg(F.sum(F.when(at_limit, 1).otherwise(0)).alias("n"), F.sum(F.when(at_limit, top).otherwise(0.0)).alias("held"), F.sum(F.when(at_limit, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if row.n is None or row.n == capped or not row.free:
            break
        capped, level = row.n, (goal - row.held) / row.free
    return weighed.withColumn("target", F.least(top, F.col("weight") * F.lit(level))).drop("weight")


def rates(hist: DataFrame, targets: DataFrame, limit: int, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """The multiplier of each source: columns source, mean, multiplier. hist: source, size, n."""
    base = F.lit(float(limit - 1))
    rate = lambda m: F.lit(float(limit)) / (1.0 + base * F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), m * F.col("size") / F.col("mean")))))
    state = common.stored(
        with_source(targets, hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")))
        .select("source", "target", "source_size", F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("mean"), F.lit(0.0).alias("multiplier"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high"), F.lit(False).alias("done")),
        "duals",
    )
    for _ in range(rounds):
        joined = with_source(hist, state).withColumn("r", rate(F.col("multiplier")))
        words = F.col("n") * F.col("size")
        step = joined.groupBy("source", "target", "source_size", "mean", "multiplier", "low", "high").agg(
            F.sum(words * F.col("r")).alias("made"), F.sum(words * F.col("r") * (1 - F.col("r") / limit) * F.col("size") / F.col("mean")).alias("slope")
        )
        low, high = F.when(F.col("made") < F.col("target"), F.col("multiplier")).otherwise(F.col("low")), F.when(F.col("made") >= F.col("target"), F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") + (F.col("target") - F.col("made")) / F.greatest(F.col("slope"), F.lit(1e-300))
        bound = (F.col("target") >= limit * F.col("source_size")) | (F.col("target") <= 0)  # all or nothing: no multiplier is needed
        done = bound | (F.abs(F.col("made") - F.col("target")) <= tolerance * F.greatest(F.col("source_size").cast("double"), F.lit(1.0))) | (high - low < 1e-12)
        state = common.stored(
            step.select("source", "target", "source_size", "mean", low.alias("low"), high.alias("high"), done.alias("done"), F.when(done, F.col("multiplier")).when((newton > low) & (newton < high), newton).otherwise((low + high) / 2).alias("multiplier")),
            "duals",
        )
        if not state.where(~F.col("done")).limit(1).count():
            break
    return state.select("source", "target", "source_size", "mean", "multiplier")


def sizes(docs: DataFrame) -> F.Column:
    """Words of a text: its size."""
    return F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def marks() -> F.Column:
    """A hash of doc_id and text, by which rows are told apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def rated(sized: DataFrame, solved: DataFrame, limit: int, bins: int) -> DataFrame:
    """Adds rate, floor, bin, part and open to rows with source, size and mark. Lower bins, and parts of them, come first
    for one more copy; open: whether one more is possible."""
    full = F.col("target") >= limit * F.col("source_size")  # no tilt reaches the limit itself
    tilt = F.lit(float(limit)) / (1.0 + (limit - 1) * F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("multiplier") * F.col("size") / F.col("mean")))))
    found = with_source(sized, solved).withColumn("rate", F.when(F.col("size") == 0, 0.0).when(full, float(limit)).when(F.col("target") <= 0, 0.0).otherwise(tilt))
    unit = F.shiftrightunsigned("mark", 11) / float(1 << 53)
    found = found.withColumn("floor", F.floor("rate").cast("long")).withColumn("fraction", (unit - (F.col("rate") - F.col("floor")) + 1) / 2 * bins)
    found = found.withColumn("bin", F.least(F.floor("fraction"), F.lit(bins - 1)))
    found = found.withColumn("part", F.least(F.floor((F.col("fraction") - F.col("bin")) * bins), F.lit(bins - 1)))
    return found.withColumn("open", (F.col("floor") < limit) & (F.col("size") > 0) & (F.col("target") > 0)).drop("fraction")


def _crossed(sums: DataFrame, by: str, *more: str) -> DataFrame:
    """For each source the row in whose mass what is left ends, with what is left of it. sums: source, by, mass, left."""
    upto = F.sum("mass").over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    over = sums.withColumn("upto", upto).where((F.col("upto") > F.col("left")) & (F.col("mass") > 0))
    row = F.struct(by, *more, (F.col("left") - F.col("upto") + F.col("mass")).alias("left"))
    return over.groupBy("source").agg(F.min_by(row, by).alias("e")).select("source", "e.*")


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2, bins: int = 1024) -> tuple[DataFrame, DataFrame]:
    """A row per source (source_size, target, mean, multiplier; edge_bin, edge_part and edge_mark, before which one more copy is
    made, and edge_take of the edge_rows rows at edge_mark) and, stored, the doc_id, source, size and mark of each document."""
    sized = common.stored(docs.select("doc_id", "source", sizes(docs).alias("size"), marks().alias("mark")), "sizes", last=True)
    hist = common.stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    sources = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    solved = common.stored(rates(hist, source_targets(sources, weights, share, limit), limit), "rates")
    by_bin = rated(sized, solved, limit, bins)
    binned = by_bin.groupBy("source", "bin").agg(F.sum(F.col("floor") * F.col("size")).alias("made"), F.sum(F.when(F.col("open"), F.col("size")).otherwise(0)).alias("mass"))
    binned = common.stored(binned, "bins")  # at most bins rows a source
    gap = with_source(solved, binned.groupBy("source").agg(F.sum("made").alias("made"))).select("source", (F.col("target") - F.col("made")).alias("left"))
    edge = common.stored(_crossed(with_source(binned, gap), "bin"), "edges")
    inside = with_source(by_bin.where("open"), edge.withColumnRenamed("bin", "edge_bin")).where(F.col("bin") == F.col("edge_bin"))
    inside = common.stored(inside.groupBy("source", "bin", "part", "mark", "size", "left").agg(F.count("*").alias("n")), "edge-rows")  # about 1 in bins, and equal rows as one
    part = common.stored(_crossed(inside.groupBy("source", "part", "left").agg(F.sum(F.col("n") * F.col("size")).alias("mass")), "part"), "edge-parts")
    last = with_source(inside.drop("left"), part.withColumnRenamed("part", "edge_part")).where(F.col("part") == F.col("edge_part"))
    mark = _crossed(last.withColumn("mass", F.col("n") * F.col("size")), "mark", "n", "size")
    take = F.floor(F.col("left") / F.col("size") + 0.5)
    ends = [edge.select("source", F.col("bin").alias("edge_bin")), part.select("source", F.col("part").alias("edge_part")), mark.select("source", F.col("mark").alias("edge_mark"), take.alias("edge_take"), F.col("n").alias("edge_rows"))]
    made = solved
    for i, x in enumerate(ends):
        made = made.join(x.withColumnRenamed("source", f"_{i}"), made["source"].eqNullSafe(F.col(f"_{i}")), "left").drop(f"_{i}")
    made = made.withColumns({"edge_bin": F.coalesce("edge_bin", F.lit(bins)), "edge_part": F.coalesce("edge_part", F.lit(-1)), "edge_mark": F.coalesce("edge_mark", F.lit(0)), "edge_take": F.coalesce("edge_take", F.lit(0)), "edge_rows": F.coalesce("edge_rows", F.lit(0))})
    return common.stored(made, "mixing-plan", last=True), sized


SHARDS = 256  #: in which equal rows are numbered


def with_copies(sized: DataFrame, made: DataFrame, limit: int = 2, bins: int = 1024) -> DataFrame:
    """Rows with source, size, mark and what else they have, with source_size, target, rate and copies by plan()'s rows."""
    found = rated(sized, made, limit, bins).withColumn("nth", F.lit(0).cast("long"))
    tie = F.col("open") & (F.col("bin") == F.col("edge_bin")) & (F.col("part") == F.col("edge_part")) & (F.col("mark") == F.col("edge_mark"))
    torn = tie & (F.col("edge_take") > 0) & (F.col("edge_take") < F.col("edge_rows"))
    if not made.where((F.col("edge_take") > 0) & (F.col("edge_take") < F.col("edge_rows"))).isEmpty():
        equal = common.stored(found.where(torn).withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(SHARDS))), "equal-rows", last=True)
        counts = equal.groupBy(F.col("source").alias("_s"), F.col("shard").alias("_n")).agg(F.count("*").alias("n"))
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("_s").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
        nth = F.row_number().over(Window.partitionBy("source", "shard").orderBy("mark")) - 1
        equal = equal.withColumn("nth", nth).join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_n")))  # SHARDS rows a source at most
        found = found.where(~torn).unionByName(equal.withColumn("nth", F.col("nth") + F.col("before")).drop("shard", "before", "_s", "_n"))
    before = (F.col("bin") < F.col("edge_bin")) | ((F.col("bin") == F.col("edge_bin")) & ((F.col("part") < F.col("edge_part")) | ((F.col("part") == F.col("edge_part")) & (F.col("mark") < F.col("edge_mark")))))
    more = (F.col("open") & before) | (tie & (F.col("nth") < F.col("edge_take")))
    found = found.withColumn("copies", (F.col("floor") + F.when(more, 1).otherwise(0)).cast("int"))
    return found.drop("floor", "bin", "part", "open", "mean", "multiplier", "edge_bin", "edge_part", "edge_mark", "edge_take", "edge_rows", "nth", "mark")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2, bins: int = 1024) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken: a row per document."""
    with common.scratch(docs.sparkSession, "mixing"):
        made, sized = plan(docs, weights, share, limit, bins)
        return with_copies(sized, made, limit, bins).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2, bins: int = 1024) -> DataFrame:
    """The documents with their columns, each as often as the mix takes it."""
    names = [f"_{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    keyed = docs.select("source", sizes(docs).alias("size"), marks().alias("mark"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    with common.scratch(docs.sparkSession, "mixing"):
        copies = with_copies(keyed, plan(docs, weights, share, limit, bins)[0], limit, bins).where("copies > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
