"""The training-text pipeline: five stages from documents to tokens.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of documents. NULLs, empty
and very long texts, repeated rows and empty tables are handled as each operator states; rows that
share an id are one document and stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import bpe, line_dedup, mixing, near_dedup, quality_classifier
from kindred.llm.words import word_count, written
from kindred.session import configure

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Below even odds a document goes; in doubt it stays.
REJECT_BELOW = 0.5
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.train(docs, labels)
    scored = docs.select(*COLUMNS, quality_classifier.score(spark, model, F.col("text")).alias("score"))
    return scored.filter(F.col("score") >= REJECT_BELOW).drop("score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a smaller id holds."""
    lines = line_dedup.drop_repeated_lines(docs.select(*COLUMNS))
    return lines.select(
        "doc.doc_id", "text", "doc.lang", "doc.source", F.length("text").cast("long").alias("n_chars")
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    found = near_dedup.near_duplicates(docs)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone.hint("shuffle_hash"), "doc_id", "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of the schedule's slots; where the mix
    ends inside a document, all of it.

    Equal rows share their number of copies evenly, rounded up. A copy stands where its first words
    are drawn.
    """
    documents, pieces = mixing.mix(docs)
    at, keys = ["place", "piece", "number"], ["doc_id", "size", "source"]
    copies = pieces.groupBy(*at, "round").agg(F.min("slot").alias("slot"))
    # At most one row per key and round, however many rows are equal.
    rounds = (
        documents.select(*at, *keys)
        .join(copies, at, "left")
        .groupBy(*keys, "round")
        .agg(F.min("slot").alias("slot"), F.count("slot").alias("taken"), F.count_distinct(*at).alias("rows"))
    )
    slots = (
        rounds.groupBy(*keys)
        .agg(
            F.sort_array(F.collect_list("slot")).alias("slots"),
            F.ceil(F.sum("taken") / F.max("rows")).cast("int").alias("copies"),
        )
        .filter("copies > 0")
        .withColumnsRenamed({key: f"of_{key}" for key in keys})
    )
    sized = docs.select(*COLUMNS, word_count(F.col("text")).alias("size"))
    same = [F.col(key).eqNullSafe(F.col(f"of_{key}")) for key in keys]
    taken = sized.join(slots.hint("shuffle_hash"), same).select(
        *COLUMNS, F.explode(F.slice("slots", 1, F.col("copies"))).alias("slot")
    )
    return taken.repartitionByRange("slot", "doc_id").sortWithinPartitions("slot", "doc_id").select(*COLUMNS)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text that they decode to."""
    return bpe.encode_documents(docs, VOCABULARY, decode=True)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_and_decode),
]

# Classifiers, signatures and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
