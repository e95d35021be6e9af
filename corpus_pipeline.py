"""A corpus made ready for training, stage by stage, each over all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharescope.llm.common import store, table
from sharescope.llm.decontamination import contained
from sharescope.llm.packing import pack
from sharescope.llm.simhash import one_of_each
from sharescope.llm.substring_dedup import remove_repeats
from sharescope.llm.toxicity import score, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Learned models, hash links and packings are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the machine learns from the labels of the others' fold."""
    machine = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine).filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints, the document with the smallest id stays."""
    return one_of_each(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start elsewhere too are cut out; texts without any stay as they are, and all documents stay."""
    done = remove_repeats(docs)
    cut = done.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def reject_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Texts are told apart by their hash, so rows without an id are judged too."""
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    leaks = contained(keyed, table(spark, sf_dir, "benchmark"), doc_id="_key").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(leaks, "_key", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", reject_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
