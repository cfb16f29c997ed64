"""A training-data pipeline over documents: quality rules, language ID, near-duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it works on all that its predecessor kept.
All but the last return the columns of documents, whatever further ones there are.

An empty table gives an empty table in every stage; texts are read whole, however long; only the id and text columns
(and ``lang``, to learn languages from) decide, so nulls in others do not matter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, packing, quality, simhash
from tessera.llm.common import documents, materialize

TOKENIZER = "word_bpe_49k.json"
#: Words that a worker remembers: half as many as in packing alone, as its memory also serves the other stages.
MEMO = 150_000
#: Near-duplicate groups, a trained classifier and a packing can't be stated in SQL.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition and base rules reject go, null and empty texts among them; repeated rows are judged each on their own."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null texts, too) or with a narrow margin between languages go; without any label all go."""
    return langid.keep_known(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest id.

    Of rows that repeat id and text one stays; rows without an id can't be told apart and all stay.
    """
    return simhash.keep_first(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in a training sequence; null texts count as empty and repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), memo=MEMO)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
