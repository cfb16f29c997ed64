"""Operator 4: SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has 64 majority bits over the hashes of its word shingles.  The fingerprint is cut in
three segments; each segment, padded to 23 bits, is decoded with the binary Golay code, and so is every word
one bit away from it, which gives up to six codeword indices.  Two segments at most two bits apart share one.
Of three errors, some two segments hold at most one each, so a pair of documents always shares one of these keys:

* fuzzy index of one segment with the exact value of another (errors 3,0,0 and 2,1,0 in any order), or
* fuzzy indices of the first two segments (errors 1,1,1).

Fingerprints that share a key are verified by their exact distance; links make components.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; fewer words than a
shingle give one shingle of them all; equal fingerprints are searched once, so repeated rows and large groups of
copies cost one entry; rows with equal ids stay separate rows; a null id is kept and never names a component
unless all ids in it are null; an empty table gives an empty table; very long texts are read whole, their shingles
counted in pieces; ``keep_first`` keeps all columns of the documents, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import similar
from tessera.llm.common import in_pieces, materialize, spread
from tessera.llm.neighbours import classes, links

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Bits of the fingerprint's three segments, from the lowest.
SEGMENTS = (22, 21, 21)
#: Fixed value: a generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY_POLYNOMIAL = 0b110001110101
#: Hashes counted at a time.
COUNT_CHUNK = 1 << 14
#: Copies that the contract's radius misses: this similarity of the sets of shingles of so many words.
SIMILAR, SIMILAR_WORDS = 0.8, 5


def words(text: str | None) -> list[bytes]:
    """Words of anything but ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingle_hashes(found: list[bytes], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    if not found:
        return np.empty(0, np.uint64)
    hashed = functools.partial(xxhash.xxh64_intdigest, seed=seed)
    if len(found) < size:
        return np.array([hashed(b" ".join(found))], np.uint64)
    return np.fromiter(map(hashed, map(b" ".join, zip(*(found[i:] for i in range(size))))), np.uint64, len(found) - size + 1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, from the lowest."""
    total = np.zeros(64, np.int64)
    for s in range(0, len(hashes), COUNT_CHUNK):
        part = np.ascontiguousarray(hashes[s : s + COUNT_CHUNK]).astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def majority(counts: np.ndarray, n: float) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    hashes = shingle_hashes(words(text))
    return majority(bit_counts(hashes), len(hashes)) if len(hashes) else 0


@functools.lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 23-bit words by byte, and by remainder the changes that reach a word's codewords.

    The code is perfect: each of the 2048 remainders belongs to one error pattern of at most three bits.  The
    changes of a remainder are the decoded errors of the word itself and of its 23 neighbours, repeats included.
    """
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY_POLYNOMIAL << (bit - 11)
        return word

    single = [remainder(1 << i) for i in range(23)]
    error = np.full(2048, -1, np.int64)
    error[0] = 0
    for i in range(23):
        error[single[i]] = 1 << i
        for j in range(i):
            error[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                error[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    if (error < 0).any():
        raise ValueError("not a perfect code")
    most, reach = 6, []
    for r in range(2048):
        changes = sorted({int(error[r]), *(int(error[r ^ single[i]]) ^ 1 << i for i in range(23))})
        reach.append(changes + [changes[0]] * (most - len(changes)))
    by_byte = np.array([[functools.reduce(lambda x, i: x ^ (single[8 * p + i] if b >> i & 1 and 8 * p + i < 23 else 0), range(8), 0) for b in range(256)] for p in range(3)], np.int64)
    return by_byte, np.array(reach, np.int64)


def codeword_indices(segment: np.ndarray) -> np.ndarray:
    """(n, 6) 12-bit indices of the codewords that a segment or a neighbour of it decodes to."""
    by_byte, reach = golay_tables()
    word = segment.astype(np.int64)
    rest = by_byte[0][word & 255] ^ by_byte[1][word >> 8 & 255] ^ by_byte[2][word >> 16]
    return (word[:, None] ^ reach[rest]) >> 11


def golay_keys(fingerprints: np.ndarray) -> np.ndarray:
    """(n, 96) search keys; any two fingerprints at most three bits apart share one."""
    at, segments = 0, []
    for bits in SEGMENTS:
        segments.append(fingerprints >> np.uint64(at) & np.uint64((1 << bits) - 1))
        at += bits
    fuzzy = [codeword_indices(s).astype(np.uint64) for s in segments]
    keys = [((fuzzy[0][:, :, None] << np.uint64(12)) | fuzzy[1][:, None, :]).reshape(len(fingerprints), 36) | np.uint64(1 << 56)]
    for n, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        keys.append(fuzzy[i] << np.uint64(22) | segments[j][:, None] | np.uint64((n + 2) << 56))
    return np.concatenate(keys, axis=1)


def shingle_set(found: list[bytes]) -> np.ndarray:
    """The distinct hashes of the shingles that similarity is measured on, in order."""
    return np.unique(shingle_hashes(found, SIMILAR_WORDS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequency: np.ndarray | None = None) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint as a signed long) of every row.

    With the ``frequency`` of shingles, also ``text_digest`` (SHA-256; empty for a null text), and what the search for
    similar sets of shingles needs: ``set`` (a digest), ``n``, ``odd`` (parities), ``counts`` and ``prefix``.
    """
    more = {} if frequency is None else {"text_digest": pa.binary(), "set": pa.int64(), "n": pa.int32(), "odd": pa.binary(), "counts": pa.binary(), "prefix": pa.list_(pa.int64())}
    shared = None if frequency is None else docs.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            found, extra = [], []
            for text in batch.column(1):
                value = text.as_py()
                own = words(value)
                hashes = shingle_hashes(own)
                found.append(majority(bit_counts(hashes), len(hashes)) if len(hashes) else 0)
                if shared:
                    hashes = shingle_set(own)
                    whole = b"" if value is None else hashlib.sha256(value.encode("utf-8", "replace")).digest()
                    extra.append((whole, similar.digest(hashes), len(hashes), similar.parities(hashes), similar.bucket_counts(hashes), similar.prefix(hashes, shared.value, SIMILAR).view(np.int64)))
            columns = [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))]
            columns += [pa.array([e[i] for e in extra], kind) for i, kind in enumerate(more.values())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", *more])

    source = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    schema = f"id {dict(source.dtypes)['id']}, fp long" + ", text_digest binary, set long, n int, odd binary, counts binary, prefix array<long>" * bool(more)
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def components(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, keys_of=golay_keys, edges: DataFrame | None = None) -> DataFrame:
    """``prints`` with ``component_id``: the smallest id reachable over links of at most ``radius`` bits; and ``root``.

    ``prints`` is read more than once: pass a materialised table.  ``edges`` has
    all edges over fingerprints, where they are known.
    """
    if radius > RADIUS and keys_of is golay_keys:
        raise ValueError(f"the keys cover {RADIUS} bits at most")
    ids = prints.groupBy("fp").agg(F.min(id_col).alias("low"))
    roots = classes(links(ids, keys_of, radius) if edges is None else edges)
    named = ids.join(roots, ids["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    members = named.join(lowest, "root").select("fp", "component_id", "root")
    return prints.join(members, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row."""
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    found = components(prints, id_col)
    return found.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def grouped_edges(prints: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edges over fingerprints: those within the radius, and those of texts whose shingle sets are similar by ``SIMILAR``.

    Every distinct set is searched for and verified, and connected with all that are similar, by whatever others.
    A set stands for the least of its fingerprints.
    """
    full = prints.where("n > 0")
    first = (F.first(c).alias(c) for c in ("n", "odd", "counts", "prefix"))
    sets = materialize(full.groupBy("set").agg(F.min(id_col).alias("low"), F.min("fp").alias("fp"), *first), "sets")
    near = links(prints.select("fp").distinct(), golay_keys, RADIUS)
    same = full.join(sets.select("set", F.col("fp").alias("own")), "set").where("fp <> own").select(F.least("fp", "own").alias("a"), F.greatest("fp", "own").alias("b"))
    edges = materialize(near.unionByName(same).distinct(), "near")

    def hashes_of(wanted: DataFrame) -> DataFrame:
        bits = docs.sparkSession.sparkContext.broadcast(similar.filter_bits(sets.join(wanted, "set", "left_semi").select("low")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_pieces(batches):
                hit = similar.in_filter(bits.value, batch.column(0).to_numpy(zero_copy_only=False))
                found = [shingle_set(words(t.as_py())) for t in batch.column(1).filter(pa.array(hit))]
                columns = [pa.array(map(similar.digest, found), pa.int64()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["set", "hashes"])

        # texts aren't shuffled; rows that the filter lets through, or that share the id of a wanted one, may have other sets
        source = spread(docs.select(F.xxhash64(docs[id_col]).alias("hash"), docs[text_col].alias("text")))
        once = source.mapInArrow(run, "set long, hashes array<long>").join(wanted, "set", "left_semi").groupBy("set").agg(F.first("hashes").alias("hashes"))
        return materialize(once, "shingles")

    def similar_edges(pairs: DataFrame, classed: DataFrame) -> DataFrame:
        """Of the pairs in different classes (``set``, ``root``) those that are similar, over fingerprints."""
        a, b = (classed.select(F.col("set").alias(n), F.col("root").alias(f"r_{n}")) for n in "ab")
        apart = pairs.join(a, "a").join(b, "b").where("r_a <> r_b").select("a", "b")
        candidates = materialize(similar.bounded(apart, sets, SIMILAR), "candidates")
        found = similar.verified(candidates, hashes_of, SIMILAR)
        a, b = (sets.select(F.col("set").alias(n), F.col("fp").alias(f"fp_{n}")) for n in "ab")
        return found.join(a, "a").join(b, "b").select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).where("a <> b")

    def classed(edges: DataFrame) -> DataFrame:
        return sets.join(classes(edges).withColumnRenamed("node", "fp"), "fp", "left").select("set", "odd", F.coalesce("root", "fp").alias("root"))

    found = materialize(similar.listed(sets, SIMILAR), "runs")
    alone = sets.select("set", F.col("fp").alias("root"))
    edges = materialize(edges.unionByName(similar_edges(found.where("key is null").select("a", "b").distinct(), alone)).distinct(), "linked")
    known = materialize(classed(edges), "classed")
    members = found.where("key is not null").drop("a", "b").join(known, "set")
    return edges.unionByName(similar_edges(similar.crossing(members, SIMILAR), known)).distinct()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all columns: that of the smallest id.

    Groups are joined by links within the radius and, as few bits of 64 miss many copies with scattered edits,
    by similar shingle sets.  Of repeated rows with the kept id and text one is kept, of other texts with that id in
    the group none; rows without an id can't be told apart and are all kept.  Columns of any name stay as they are.
    """
    named = docs.where(docs[id_col].isNotNull())
    frequency = similar.frequencies(spread(named.select(text_col)), lambda text: shingle_set(words(text)))
    prints = materialize(fingerprints(named, id_col, text_col, frequency), "prints")
    found = components(prints.select(id_col, "fp", "text_digest"), id_col, edges=grouped_edges(prints, named, id_col, text_col))
    lowest = found.where(F.col(id_col) == F.col("component_id")).groupBy("root").agg(F.min(id_col).alias("id"), F.min("text_digest").alias("digest"))
    first = lowest.select("id", "digest").distinct()
    # texts are shuffled once, by id and digest, for the join and for the choice of one row; a row's own columns stay
    # inside ``row``, so none of them can clash
    keyed = named.select(named[id_col].alias("id"), F.coalesce(F.unhex(F.sha2(named[text_col], 256)), F.lit(b"")).alias("digest"), F.struct(*(named[f"`{c}`"] for c in named.columns)).alias("row"))
    kept = keyed.join(first, ["id", "digest"], "left_semi")
    once = kept.withColumn("n", F.expr("row_number() over (partition by id, digest order by id)"))
    return once.where("n = 1").select("row.*").unionByName(docs.where(docs[id_col].isNull()))
