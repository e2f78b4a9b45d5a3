"""A corpus pipeline of five stages; each is written as Parquet and reread as the next one's documents.

All stages take documents with nulls in any column, repeated rows, no rows, and further columns; all but the last return
the columns they got. What a stage does with such rows is in its docstring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import exact_dedup, ngram_join, packing, pii, quality
from knotwork.llm.common import written
from knotwork.llm.tokens import BYTE_TOKENIZER, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are multivariate outliers of their language and source go. Null and empty
    texts fail; null languages and sources are groups of their own; rows that share a doc_id stay if one of them passes."""
    return quality.keep_good(docs).select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest stays, then the smallest doc_id (none last); rows that repeat it
    stay with it."""
    return exact_dedup.drop_copies(docs).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the smallest doc_id stays (none last; of
    its rows one text, and the rows that repeat that). Documents without words stay."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become placeholders and n_chars follows; null texts stay null."""
    return pii.redacted(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full windows of at most 1024 tokens; null and empty texts are one end id."""
    return packing.packed(docs, tokenizer_path(BYTE_TOKENIZER), cache=PACK_CACHE)


#: Pieces whose ids a worker keeps: fewer than when packing runs alone, for executors have the earlier stages' heap as well.
PACK_CACHE = 150_000

STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("ngram_jaccard_join", near_copies), ("pii", personal_data), ("packing", pack)]

#: The tagger and the tokenizer cannot be expressed in SQL; tests/llm/test_edges.py and test_operators.py hold the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
