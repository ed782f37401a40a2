"""A corpus pipeline of five operators: language, near-duplicates, repeats, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage
before it kept.  All but the last return the columns of ``documents``; a stage
that changes texts keeps ``n_chars`` in step.

Defined results: null and empty texts, and texts without a letter, go in the first
stage; any other column may be null.  Rows that repeat an id count as one document
and stay or go together; of equal or linked texts the smallest id stays; rows with a
null id are kept and packed, and affect no other row.  Further columns go through all
stages but the last, whatever their names, with or without ``n_chars``.  Empty tables
give an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontamination, language_id, packing, simhash, substring_dedup
from glyphmill.llm.common import ensure_checkpoint_dir, table


def _recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no learned language, go."""
    return language_id.keep_languages(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has go."""
    return _recount(substring_dedup.drop_repeats(docs))


def remove_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans shared with benchmark items go; documents that are mostly such spans go whole."""
    return _recount(decontamination.remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", remove_benchmark_items),
    ("packing", pack_sequences),
]

#: Language models, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
