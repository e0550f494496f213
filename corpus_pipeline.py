"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but
the last return the columns of documents.  ``run`` writes each stage's rows to the shared
folder before the next reads them, so a lost executor costs one stage's tasks at most.

Rows of null or empty text and of null doc_id are judged by every stage like others (see
the operators; all texts without words are one group of near duplicates); texts are read
whole at any length; repeated rows share a fate; an empty table stays empty; columns
besides text and n_chars stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, mixing, simhash, substring, toxicity
from factloom.llm.common import stored, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id stays."""
    return simhash.deduplicated(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur anywhere else leave the text; no row goes."""
    return substring.without_repeats(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains above their target share are thinned; what is surely clean stays."""
    return mixing.resampled(docs, table(spark, sf_dir, "labels"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every text."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("mixing_to_targets", mix_to_targets),
    ("byte_level_bpe", encode_tokens),
]

#: Classifiers, trees and tokenizers cannot be said in SQL; tests/llm/test_pipeline.py
#: holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
