"""Quality rules with host verdicts, in DataFrame functions alone.

Each document is measured and tested against rules on its own text. Failures are then summed for each host (the source
column), each host's rate of failure is shrunk towards the others' with a beta prior fitted to the hosts by moments, and a
host whose shrunken rate is above the limit is rejected with all its documents.

Null or empty text: no words, so the document fails. A text of any length is measured whole. Null source: a host of its own.
Repeated rows: each is measured and counted. Windows that tie by hash count as equal, see repeated_words(). An empty table gives
no rows. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.llm import common

WINDOW = 5
#: Rules beside the base ones: name, and the condition on which a document fails.
RULES = {
    "symbols": "10 * n_symbols > 3 * n_words",
    "line_copies": "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars > 25 * n_words OR word_chars < 2 * n_words",
}


def window_hashes(words: F.Column) -> F.Column:
    """A 64-bit hash of each window of five words."""
    n = F.greatest(F.size(words) - WINDOW + 1, F.lit(0))
    shifted = F.arrays_zip(*[F.slice(words, k + 1, n).alias(f"w{k}") for k in range(WINDOW)])
    return F.transform(shifted, lambda w: F.xxhash64(w))


def repeated_words(hashes: F.Column) -> F.Column:
    """How many words lie in windows that occur twice or more. Windows are equal if their hashes are: among a text's windows,
    n of them, the chance of a mistake is n * n / 2**65."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("window"), i.alias("at"))))
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice(ordered["window"], 1, F.size(ordered) - 1))
    after = F.concat(F.slice(ordered["window"], 2, F.size(ordered)), F.array(F.lit(None).cast("long")))
    marked = F.filter(F.arrays_zip(ordered.alias("o"), before.alias("b"), after.alias("a")), lambda x: F.coalesce(x["o"]["window"] == x["b"], F.lit(False)) | F.coalesce(x["o"]["window"] == x["a"], F.lit(False)))
    at = F.sort_array(F.transform(marked, lambda x: x["o"]["at"]))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered["n"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words: a row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    split = docs.select("doc_id", "source", text.alias("text"), common.words(F.col("text")).alias("words"), lines.alias("lines"))
    split = split.withColumn("hashes", window_hashes(F.col("words")))
    long = lambda c: c.cast("long")
    return split.select(
        "doc_id",
        "source",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.concat_ws("", "words"))).alias("word_chars"),
        long(F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(repeated_words(F.col("hashes"))).alias("n_repeat_words"),
    )


def host_verdicts(tested: DataFrame, limit: float = 0.5) -> DataFrame:
    """source, host_docs, host_rate, host_rejected. tested: source and failed, a row per document."""
    hosts = common.stored(tested.groupBy("source").agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")), "hosts")
    share = F.col("n_failed") / F.col("host_docs")
    m = hosts.agg(F.avg(share).alias("mean"), F.var_samp(share).alias("var"), F.avg(1 / F.col("host_docs")).alias("noise")).first()
    mean = min(max(m.mean or 0.0, 1e-6), 1 - 1e-6)
    spread = max((m.var or 0.0) - mean * (1 - mean) * (m.noise or 0.0), mean * (1 - mean) * 1e-4)  # between hosts, without what counting adds
    strength = max(mean * (1 - mean) / spread - 1, 1.0)
    rate = (F.col("n_failed") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.select("source", "host_docs", rate.alias("host_rate"), (rate > limit).alias("host_rejected"))


def judge(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """What measured() gives and base_failed, failed_rules, host_rate, host_rejected, kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rules = F.filter(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items()]), lambda x: x.isNotNull())
    tested = common.stored(measured(docs).withColumn("base_failed", base).withColumn("failed_rules", rules).withColumn("failed", F.col("base_failed") | (F.size("failed_rules") > 0)), "measured")
    hosts = host_verdicts(tested, host_limit).withColumnRenamed("source", "_source")
    joined = tested.join(hosts, tested["source"].eqNullSafe(hosts["_source"])).drop("_source")
    return joined.withColumn("kept", ~(F.col("failed") | F.col("host_rejected"))).drop("failed")
