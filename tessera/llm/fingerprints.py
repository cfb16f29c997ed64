"""Operator 9: document fingerprints (SimHash) with permuted block tables.

Terms are word shingles; each term's hash votes on the signed bits with the term's weight, one plus the
logarithm of its count.  A search key holds two of the fingerprint's five blocks, one table for each of the ten
choices: fingerprints at most three bits apart differ in at most three blocks, so some table has both
remaining blocks in common.

Defined results: a null text counts as empty and has fingerprint zero; fewer words than a shingle give one term;
equal texts have equal fingerprints; of rows with equal ids the next one is the next in order of text, nulls
first; rows of one id, and those without any, are one range, which is sorted on disk and read row by row;
ids must be numbers (others raise a TypeError); a single row is its own next document; null ids come last; very long texts are read whole; an empty table
gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessera.llm.neighbours import link_counts
from tessera.llm.simhash import COUNT_CHUNK, components, shingle_hashes, words

#: Words in a term.
TERM_WORDS = 2
SEED = 9
#: Blocks of the fingerprint, and how many of them one table's key holds.
BLOCKS = (13, 13, 13, 13, 12)
KEY_BLOCKS = 2
RADIUS = 3
#: Documents in one range of ids, about, and ranges at most: with more rows the ranges are longer, and are still
#: sorted on disk and read row by row.
RANGE_ROWS = 2_000
MAX_RANGES = 65_536
#: Ranges between quantiles of the ids; each is cut evenly where more are wanted.
QUANTILES = 1_024


def fingerprint(text: str | None) -> int:
    """The weighted SimHash of a whole text."""
    hashes = shingle_hashes(words(text), TERM_WORDS, SEED)
    if not len(hashes):
        return 0
    terms, counts = np.unique(hashes, return_counts=True)
    weights = (1 + np.log2(counts)).astype(np.float32)
    votes = np.zeros(64, np.float64)
    for s in range(0, len(terms), COUNT_CHUNK):
        bits = np.unpackbits(np.ascontiguousarray(terms[s : s + COUNT_CHUNK]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weights[s : s + COUNT_CHUNK] @ bits.astype(np.float32)
    return int(np.packbits(votes * 2 > weights.sum(dtype=np.float64), bitorder="little").view("<u8")[0])


def likeness(a: int, b: int) -> float:
    """The cosine that the differing bits of two fingerprints stand for; 0 if they differ in half the bits or more."""
    return max(0.0, float(np.cos(np.pi * (a ^ b).bit_count() / 64)))


def block_keys(fingerprints: np.ndarray) -> np.ndarray:
    """(n, 10) keys of the permuted block tables."""
    blocks, at = [], 0
    for bits in BLOCKS:
        blocks.append(fingerprints >> np.uint64(at) & np.uint64((1 << bits) - 1))
        at += bits
    return np.stack([(blocks[i] << np.uint64(13) | blocks[j]) | np.uint64((n + 1) << 32) for n, (i, j) in enumerate(itertools.combinations(range(len(BLOCKS)), KEY_BLOCKS))], axis=1)


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as many first characters (or all) of the next one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt by ranges of descending id, each range in order and closed by a guest: the first row of the next.

    Columns: ``bucket``, ``id``, ``text``, ``guest``.  The texts are shuffled once; the driver only gets one id
    and one boundary for each range.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    if not isinstance(rows.schema["id"].dataType, NumericType):
        raise TypeError(f"ids must be numbers to be dealt by ranges, not {rows.schema['id'].dataType.simpleString()}")
    n = rows.count()
    ranges = min(MAX_RANGES, max(1, -(-n // RANGE_ROWS)))
    coarse = min(ranges, QUANTILES)
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    fine = 1 if high is None else -(-ranges // coarse)
    bounds = sorted(set(rows.stat.approxQuantile("id", [i / coarse for i in range(1, coarse)], 1 / (20 * coarse))), reverse=True) if coarse > 1 else []

    def place(first: int, last: int) -> Column:
        """The number of bounds at or above the id, found by halves."""
        if first == last:
            return F.lit(first)
        mid = (first + last) // 2
        return F.when(F.col("id") > F.lit(bounds[mid]), place(first, mid)).otherwise(place(mid + 1, last))

    # bucket 0 has the largest ids; null ids sort below every other and so come last
    bucket = place(0, len(bounds))
    if fine > 1:
        edges = F.array(*map(F.lit, [float(high), *map(float, bounds), float(low) - 1]))
        top, bottom = F.get(edges, bucket), F.get(edges, bucket + 1)
        part = F.floor((top - F.col("id")) * fine / F.greatest(top - bottom, F.lit(1.0)))
        bucket = bucket * fine + F.least(F.greatest(part, F.lit(0)), F.lit(fine - 1)).cast("int")
    buckets = (len(bounds) + 1) * fine
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(buckets - 1)).otherwise(bucket))
    heads = {r["bucket"]: r["head"] for r in rows.groupBy("bucket").agg(F.max("id").alias("head")).collect()}
    filled = sorted(heads)
    # the guest of each range is the first row of the next filled range; the last range's is that of the first
    guests = [(heads[b], filled[i - 1]) for i, b in enumerate(filled)]
    spark = docs.sparkSession
    table = spark.createDataFrame(guests, f"head {dict(rows.dtypes)['id']}, target int")
    visiting = rows.drop("bucket").join(F.broadcast(table), F.col("id").eqNullSafe(F.col("head"))).select(F.col("target").alias("bucket"), "id", "text", F.lit(True).alias("guest"))
    both = rows.select("bucket", "id", "text", F.lit(False).alias("guest")).unionByName(visiting)
    dealt = both.repartitionById(buckets, "bucket")  # one range a task
    return dealt.sortWithinPartitions("bucket", "guest", F.col("id").desc_nulls_last(), F.col("text").asc_nulls_first())


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next document's are."""
    names = ["id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # bucket, id, text, fingerprint of the row that waits for the next one
        met = None  # the bucket whose guest has been met

        def result(row: tuple, text: str, fp: int) -> tuple:
            _, key, own, mine = row
            changed = edited(own, text)
            theirs = fingerprint(changed)
            return key, len(own), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), mine, theirs, likeness(mine, theirs), likeness(mine, fp)

        for batch in batches:
            out = []
            buckets, ids, guests = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for b, key, guest, text in zip(buckets, ids, guests, batch.column(2)):
                if guest and met == b:
                    continue  # further rows of the guest's id
                text = text.as_py() or ""
                fp = fingerprint(text)
                if held is not None and held[0] == b:
                    out.append(result(held, text, fp))
                held, met = (None, b) if guest else ((b, key, text, fp), met)
            columns = list(zip(*out)) or [[]] * len(names)
            kinds = [batch.schema.field(1).type, pa.int64(), pa.string(), pa.uint64(), pa.uint64(), pa.float64(), pa.float64()]
            arrays = [pa.array(v, k) for v, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([a.view(pa.int64()) if a.type == pa.uint64() else a for a in arrays], names=names)

    ordered = in_order(docs, id_col, text_col)
    kind = dict(ordered.dtypes)["id"]
    out = ordered.mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def search(asked: DataFrame, prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Every row of ``prints`` within ``radius`` bits of each row of ``asked``: ``query_id``, ``id_col``, ``distance``.

    Both have ``id_col`` and ``fp``.  Equal fingerprints are searched once; a table of the ten keys is joined
    and verified, and what is found is expanded to the rows that have the fingerprints.
    """
    if radius > len(BLOCKS) - KEY_BLOCKS:
        raise ValueError(f"the tables cover {len(BLOCKS) - KEY_BLOCKS} bits at most")

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(0).to_numpy(zero_copy_only=False)
                keys = block_keys(values.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(values, keys.shape[1]))], names=["key", name])

        return rows.select("fp").distinct().mapInArrow(run, f"key long, {name} long")

    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = keyed(asked, "a").join(keyed(prints, "b"), "key").where(bits <= radius).select("a", "b", bits.cast("int").alias("distance")).distinct()
    named = asked.select(F.col(id_col).alias("query_id"), F.col("fp").alias("a")).join(pairs, "a")
    return named.join(prints.select(id_col, F.col("fp").alias("b")), "b").select("query_id", id_col, "distance")


def near_classes(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``prints`` (``id_col``, ``fp``) with ``class_id``, the smallest id reachable over fingerprints within ``radius``, and
    ``n_links``, the other rows whose fingerprints are within it.

    The block tables find every fingerprint within three bits.  ``prints`` is read more than once.
    """
    if radius > len(BLOCKS) - KEY_BLOCKS:
        raise ValueError(f"the tables cover {len(BLOCKS) - KEY_BLOCKS} bits at most")
    classed = components(prints, id_col, radius, block_keys).drop("root").withColumnRenamed("component_id", "class_id")
    counts = link_counts(prints.groupBy("fp").agg(F.count("*").alias("n")), block_keys, radius)
    return classed.join(counts, "fp").withColumn("n_links", F.col("n_near") - 1).drop("n_near")
