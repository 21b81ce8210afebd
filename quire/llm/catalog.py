"""Queries of this folder's operators and of the pipeline, with their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, licenses, mixing, quality, recompression, resample, rules, simhash, spelling, toxicity, trie, warc, winnow

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

BPE, UNIGRAM = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_quality_rules", rules.DECISIONS_SQL)
def _(spark, sf_dir):
    return rules.decisions(table(spark, sf_dir, "documents"))


@query("op2_mixing")
def _(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op3_warc", warc.derivatives_sql())
def _(spark, sf_dir):
    return warc.derivatives(table(spark, sf_dir, "pages"))


@query("op4_recompression", recompression.DIGESTS_SQL)
def _(spark, sf_dir):
    return recompression.digests(table(spark, sf_dir, "documents"))


@query("op5_winnowing")
def _(spark, sf_dir):
    return winnow.edited(table(spark, sf_dir, "documents"))


@query("op6_token_counts")
def _(spark, sf_dir):
    return trie.counts(table(spark, sf_dir, "documents"), UNIGRAM)


@query("op7_simhash")
def _(spark, sf_dir):
    return simhash.classes(table(spark, sf_dir, "documents"))


@query("op8_quality")
def _(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_licenses", licenses.labels_sql())
def _(spark, sf_dir):
    return licenses.labels(table(spark, sf_dir, "documents"))


@query("op10_bpe")
def _(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), BPE, P.PATTERN)


@query("op11_spelling", spelling.GROUPED_SQL)
def _(spark, sf_dir):
    return spelling.grouped(table(spark, sf_dir, "documents"))


@query("op12_resampling", resample.RESAMPLED_SQL)
def _(spark, sf_dir):
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_toxicity")
def _(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
