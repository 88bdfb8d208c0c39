"""The corpus pipeline: five stages, each over all that the one before kept.

1. toxicity: documents whose deobfuscated text scores as toxic go;
2. n-gram Jaccard join: one document of each group of near copies stays (its smallest id);
3. benchmark decontamination: documents into which a benchmark item leaks go;
4. secret scan: every span found is replaced by a mark; no document goes;
5. byte-level BPE: what is left is encoded, and decoded again.

Defined cases, the same for all stages: a null or empty text is clean, links with nothing, leaks nothing, holds no
secret and has no tokens, so its row stays; a row without an id stays; of repeated rows (one id) the second stage
keeps one, the first by its columns in order; of a group of near copies the smallest id stays, so ties cannot
arise; very long texts are worked through whole; an empty table gives no rows; further columns are kept as they are
up to the last stage, which returns its digests instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import bpe, jaccard_join, latent_leaks, secrets, toxicity
from ledgerlens.llm.base import read
from ledgerlens.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return latent_leaks.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scan", redact),
    ("byte_level_bpe", tokenize),
]

#: SQL expresses none of the learned stages; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = out
    return docs
