"""Corpus pipeline: quality rules, exact dedup, n-gram Jaccard join, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's ``docs``. Every stage but the last
returns the columns of ``documents``. Other columns than doc_id and text are
carried along; null texts count as empty, null doc_ids are rows like others,
repeated rows are rows of their own until a dedup stage takes them for copies,
very long texts are worked on whole, empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import exact, jaccard, packing, repetition, substring
from ledgerlens.llm.common import discard, documents, stored

#: The stages use tokenizers, hashing of word windows and packing, which SQL cannot express;
#: tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; the others go."""
    return repetition.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest (then smallest doc_id) stays."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle Jaccard of 0.8 or more, the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from all texts but the first; n_chars follows. All rows stay."""
    return substring.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in 2048-token sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup),
          ("substring dedup", substring_dedup), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table. A stage's table goes when the next one's is written."""
    docs, path = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, new = stored(stage(spark, docs, sf_dir), name)
        if path:
            discard(spark, path)
        path = new
    return STAGES[-1][1](spark, docs, sf_dir)
