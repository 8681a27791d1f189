"""Documents to packed training batches: language ID, near-duplicates, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from touchline.llm.language import keep_identified, learn
from touchline.llm.mixing import mix
from touchline.llm.packing import pack
from touchline.llm.queries import MIX_TARGETS, importable, mix_dimensions
from touchline.llm.simhash import drop_near_duplicates
from touchline.llm.token_counts import count_tokens
from touchline.session import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and an identified language; learned from the labelled ones."""
    return keep_identified(docs, learn(docs, background=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by SimHash: four words, four bits."""
    return drop_near_duplicates(docs, words=4, distance=4)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to flattened source, language and topic weights, half of all tokens."""
    return mix(docs, mix_dimensions(), MIX_TARGETS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each document by its token count."""
    return pack(count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [(f.__name__, importable(f)) for f in (language, near_duplicates, mixing, packing)]

#: The stages learn a network and fingerprint texts, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
