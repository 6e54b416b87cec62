"""From raw documents to packed training sequences: five stages, each an operator of ticktide.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but the
last return the columns of documents. Null texts are empty texts to every stage; texts of any length are read whole. Rows without a
doc_id are scored, masked, mixed and packed like others and are near copies of nothing. Rows that share a doc_id go together: all are
near copies if one is, and each is packed. Among near copies the smallest doc_id stays; ties in mixing go by a mark of the row's
values. An empty table passes every stage and gives no rows; other columns of documents are carried up to packing, whatever they are
called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktide.llm import common, mixing, near_dups, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that a model of the labels finds toxic."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near-duplicates."""
    return common.without(docs, near_dups.near_duplicates(docs).where(~F.col("kept")).select("doc_id"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts kinds in place of personal data; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their weights."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a sequence of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("pii", mask_personal_data), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Trained scores, sketches and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
