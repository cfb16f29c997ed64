"""Operator 7: token counts with a digest cache.

Every text is reduced to the digest of its normalised content; digests are joined to the counts stored for the
tokenizer version (the digest of its file).  Only one text of each missing digest is encoded; its count is
appended to the cache, and all rows take their counts from there.

Normalising replaces null by the empty text and nothing else, as any other change could change the count.

Defined results: a null text counts as empty (0 bytes, 0 tokens); copies of a text, repeated rows included, are
encoded once; rows that share an id, or have none, are told apart by their digests; very long texts are encoded whole; a missing cache counts as empty; an empty table gives an empty
table and appends nothing; only the id and text columns are read, so further columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe
from tessera.llm.common import materialize

#: Texts with more tokens are over the limit.
TOKEN_LIMIT = 1024
#: Digests that a task remembers, so that rows that repeat both id and text are mostly encoded once.
RECENT = 1 << 16
CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """The digest of a tokenizer file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def stored(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """``digest`` and ``n_tokens`` stored for a tokenizer version, one row for each digest."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    return cache.where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row; what was missing is in the cache afterwards."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    keyed = materialize(rows.select("id", digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    first = keyed.groupBy("digest").agg(F.min(F.struct("id")).alias("first"))
    misses = first.join(stored(spark, cache_path, version), "digest", "left_anti").select(F.col("first.id").alias("miss_id"), F.col("digest").alias("miss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, met = bpe(tokenizer_path), {}
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key in met:
                    continue  # a row that repeats both id and text
                if len(met) >= RECENT:
                    met.clear()
                met[key] = None
                out.append((key, len(coder.encode(text.as_py())) // 4))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["digest", "n_tokens"])

    # one text for each missing digest, joined by digest and id, so that rows of one id or without any are spread
    hashed = rows.withColumn("digest", digest)
    texts = hashed.join(misses.hint("shuffle_hash"), (hashed["digest"] == misses["miss"]) & hashed["id"].eqNullSafe(misses["miss_id"])).select("miss", "text")
    fresh = texts.mapInArrow(run, "digest string, n_tokens long")
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    # written first, so that the join has plain shuffles on both sides and a digest with very many copies is split
    counted = keyed.join(materialize(stored(spark, cache_path, version), "counts"), "digest")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
