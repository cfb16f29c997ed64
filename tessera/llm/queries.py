"""The registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprints, langid, lm, packing, prefixes, quality, simhash, tokencount, toxicity, urls, warc, whitening
from tessera.llm.common import documents, fold, materialize, tables_dir
from tessera.llm.sql import ORACLE_SQL
from tessera.sources.tables import table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
#: Of so many pages four differ in the replica that operator 10 audits.
DAMAGE = 50


def hex16(column: str) -> F.Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.codec(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.train(docs))
    return found.withColumn("held_out", fold("doc_id") == 0).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    # a cache of its own: the query counts everything once
    cache = f"{tables_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    return tokencount.count_tokens(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), cache)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(fingerprints.with_next(documents(spark, sf_dir)), "fingerprints")
    with_class = fingerprints.near_classes(found)
    return with_class.select("doc_id", "n_chars", "edited_sha256", hex16("fp").alias("fingerprint"), hex16("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "class_id", "n_links")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of ``pages``, and what an audit of a replica finds: of every 50 pages one has another last character,
    one is longer, one is missing, and one was added."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    kind = F.col("page_id") % DAMAGE
    changed = F.when(kind == 7, F.expr("concat(substring(html, 1, length(html) - 1), '~')")).when(kind == 27, F.concat("html", F.lit("~"))).otherwise(F.col("html"))
    added = pages.where(kind == 37).withColumn("page_id", -F.col("page_id"))
    replica = pages.where(kind.isNull() | (kind != 17)).withColumn("html", changed).unionByName(added)
    ours, theirs = (materialize(warc.keyed(rows), "records") for rows in (pages, replica))
    depth = warc.digits(ours.count())
    found = materialize(warc.audit(ours, theirs, depth), "findings")
    here = found.where("state <> 'added'").select(F.col("id").alias("found_id"), F.col("digest").alias("found_digest"), "state")
    # pages without an id have their state, too
    laid = warc.records(ours, depth).join(here, (F.col("digest") == F.col("found_digest")) & F.col("id").eqNullSafe(F.col("found_id")), "left")
    columns = [F.col("id").alias("page_id"), "segment", "seq", "offset", "length", "digest", F.coalesce("state", F.lit("intact")).alias("state")]
    none = [F.lit(None).cast(k).alias(n) for n, k in (("segment", "string"), ("seq", "long"), ("offset", "long"), ("length", "long"), ("digest", "string"))]
    return laid.select(*columns).unionByName(found.where("state = 'added'").select(F.col("id").alias("page_id"), *none, "state"))


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_bpe, op2_langid, op3_urls, op4_simhash, op5_quality, op6_lm, op7_tokens, op8_packing, op9_fingerprints, op10_warc, op11_prefixes, op12_toxicity, op13_whitening)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
