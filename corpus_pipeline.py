"""Corpus pipeline: the training-data operators in a row, each stage on all that its predecessor kept.

Defined results of all stages: an empty table gives an empty table; rows without ``doc_id``, ``lang`` or ``source`` are handled like others; further
columns of the input, whatever their names, are neither read nor kept.
"""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import bpe, mixing, quality, recompression, similar
from quire.session import shared_folder

#: No stage but the mixing could be said in SQL: the whole is tested against a brute-force version.
ORACLE_SQL = None
#: Rows that go to Python at once: whole texts are long.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null, empty or blank text gets the score of the bias alone; repeated rows get equal scores and stay or go together; without labels of
    both kinds all scores are equal.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.model_of(quality.train(docs, labels.filter(~quality.held_out())))
    return quality.score(docs.withColumn("__body", F.col("text")), model, text="__body", drop=("__body",)).filter("score >= 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles alike by 0.8 or more), the one of the smallest id.

    Texts without words are alike, nulls included; a null id is the last; of rows that repeat an id and a text one stays; ties of ids go by
    the text's hash.
    """
    return similar.keep_first(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; a text that loses nothing stays as it was, one that loses all goes.

    A text without words loses nothing; the passage of the smallest id (then of the text's hash, then the first place) stays.
    """
    out = recompression.remove_repeats(docs)
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))
    return out.filter("n_removed = 0 OR n_removed < n_words").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight: each document with the words each pass takes of it.

    A text without words is taken by no pass; a null source is a source of its own; repeated rows are documents of their own.
    """
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of what they decode to.

    A null text counts as an empty one, which has no ids; repeated rows stay.
    """
    docs = docs.select("doc_id", "source", "lang", "text")
    coded = bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, drop=("text",), decoded=True)
    return coded.select("doc_id", "source", "lang", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", classify), ("SimHash near-dedup", near_dedup), ("substring dedup", cut_repeats),
          ("mixing sources to target weights", mix_sources), ("byte-level BPE encoding and decoding", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = spark.conf.get(BATCH)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        spark.conf.set(BATCH, 1000)
        try:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        finally:
            spark.conf.set(BATCH, given)
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
