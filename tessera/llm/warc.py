"""Operator 10: WARC records with a Merkle fixity audit.

A record's key is the SHA-256 of its id and digest, in hexadecimal; an archive lays its records out in the order of their
keys, in segments with byte offsets of their own.  A node of the tree is a prefix of keys and covers an ordered range of
records: its hash is that of its bytes and of its children's hashes in order.  Leaves are prefixes so long that each has
about ``LEAF_RECORDS`` records.  A node holds where its range starts and how long it is, but the hash leaves places out:
so a missing, added or longer record changes the nodes above it and no others.

An audit compares the roots of two replicas and descends only below nodes that differ; the records of the leaves that it
ends in are compared by their ids.  What it reads grows with the damage and the height of the trees.

Defined results: null urls or bodies count as empty; a record is ``damaged`` where both replicas have the id but not the
digest, else ``missing`` or ``added``; repeated rows are records of their own, side by side, and are compared by their
number; null ids are ids like others, and so are texts; very long bodies are hashed whole; empty tables give empty trees
and no findings; only the id, url and body columns are read.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Records below a leaf, about (a power of two); each further digit divides them by 16.
LEAF_RECORDS = 16
#: Digits that the leaves of one segment differ in: segments have about 4,096 records.
SEGMENT_DIGITS = 2
#: Fixed value: the date of synthetic records, as pages carry none.
RECORD_DATE = "1970-01-01T00:00:00Z"
END = "\r\n"


def record(key: Column, url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record as text."""
    content = F.coalesce(body, F.lit(""))
    lines = [
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
        F.lit(f"WARC-Date: {RECORD_DATE}"),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(content).cast("string")),
        F.lit(""),
        content,
        F.lit(""),
        F.lit(""),
    ]
    return F.concat_ws(END, *lines)


def digits(n: int) -> int:
    """The length of the leaves' prefixes for ``n`` records."""
    return len(f"{n // LEAF_RECORDS:x}") if n >= LEAF_RECORDS else 0


def keyed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``key``, ``id``, ``length`` and ``digest`` of each page's record.  Bodies are never shuffled."""
    text = record(pages[id_col], pages[url_col], pages[body_col]).cast("binary")
    plain = pages.select(pages[id_col].alias("id"), F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"))
    name = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "digest")
    return plain.select(F.sha2(name.cast("binary"), 256).alias("key"), "id", "length", "digest")


def records(found: DataFrame, depth: int) -> DataFrame:
    """Keyed records with ``segment`` (a prefix), ``seq`` and ``offset`` in it."""
    segment = F.substring("key", 1, max(depth - SEGMENT_DIGITS, 0))
    order = Window.partitionBy("segment").orderBy("key")
    laid = found.withColumn("segment", segment).withColumn("seq", F.row_number().over(order).cast("long") - 1)
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return laid.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))


def entries(found: DataFrame, depth: int) -> DataFrame:
    """Equal records as one: ``node`` (the leaf), ``key``, ``id``, ``length``, ``digest`` and how ``many`` there are."""
    return found.groupBy("key", "id", "length", "digest").agg(F.count("*").alias("many")).withColumn("node", F.substring("key", 1, depth))


def tree(rows: DataFrame, depth: int) -> DataFrame:
    """All nodes over entries: ``level`` (the length of the prefix), ``node``, ``bytes``, ``n_records`` and ``hash``.

    The leaves' level is written once and each further level made from the one below, sixteen children at most a node.
    """
    parts = F.array_sort(F.collect_list(F.concat_ws(" ", "key", "digest", "length", "many")))
    leaves = rows.groupBy("node").agg(F.sum(F.col("length") * F.col("many")).alias("bytes"), F.sum("many").alias("n_records"), parts.alias("parts"))
    level = materialize(leaves.select(F.lit(depth).alias("level"), "node", "bytes", "n_records", F.sha2(F.array_join("parts", "\n").cast("binary"), 256).alias("hash")), "leaves")
    out = level
    for n in range(depth - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        up = level.groupBy(F.substring("node", 1, n).alias("up")).agg(F.sum("bytes").alias("bytes"), F.sum("n_records").alias("n_records"), children.alias("children"))
        joined = F.concat_ws(" ", F.col("bytes").cast("string"), F.array_join("children.hash", " "))
        level = up.select(F.lit(n).alias("level"), F.col("up").alias("node"), "bytes", "n_records", F.sha2(joined.cast("binary"), 256).alias("hash"))
        out = out.unionByName(level)
    return materialize(out, "tree")


def suspects(ours: DataFrame, theirs: DataFrame, depth: int) -> DataFrame:
    """The leaves (``node``) that differ between two trees.  From the root downwards only children of differing nodes are joined."""
    found = None
    for level in range(depth + 1):
        a, b = (t.where(F.col("level") == level).select("node", F.col("hash").alias(n)) for t, n in ((ours, "ours"), (theirs, "theirs")))
        if found is not None:
            parents = found.select(F.col("node").alias("parent"))
            a, b = (t.join(parents, F.substring("node", 1, level - 1) == F.col("parent"), "left_semi") for t in (a, b))
        found = materialize(a.join(b, "node", "full").where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("node"), "suspects", instead_of=found)
    return found


def audit(ours: DataFrame, theirs: DataFrame, depth: int) -> DataFrame:
    """``id``, ``state`` (damaged, missing or added), and both ``digest`` and ``theirs``, of the records of two replicas (keyed) that differ."""
    a, b = (materialize(entries(rows, depth), "entries") for rows in (ours, theirs))
    leaves = suspects(tree(a, depth), tree(b, depth), depth)
    a, b = (rows.join(leaves, "node", "left_semi").select("key", "id", "digest", F.col("many").alias(n)) for rows, n in ((a, "lost"), (b, "new")))
    both = a.join(b.withColumnRenamed("digest", "theirs").withColumnRenamed("id", "_id"), "key", "full")
    differ = both.where(~F.col("lost").eqNullSafe(F.col("new"))).select(F.coalesce("id", "_id").alias("id"), "digest", "theirs", (F.coalesce("lost", F.lit(0)) - F.coalesce("new", F.lit(0))).alias("n"))
    # what one replica lacks and what only the other has, side by side: an id's n-th with its n-th
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("digest", "theirs")))
    lost = differ.where("n > 0").withColumn("_place", place).select("id", "_place", "digest")
    new = differ.where("n < 0").withColumn("_place", place).select(F.col("id").alias("_id"), F.col("_place").alias("_p"), "theirs")
    pairs = lost.join(new, lost["id"].eqNullSafe(new["_id"]) & (F.col("_place") == F.col("_p")), "full")
    state = F.when(F.col("_p").isNull(), "missing").when(F.col("_place").isNull(), "added").otherwise("damaged")
    return pairs.select(F.when(F.col("_place").isNull(), F.col("_id")).otherwise(F.col("id")).alias("id"), state.alias("state"), "digest", "theirs")


def write_warc(stream: io.BufferedIOBase, texts: Iterator[str]) -> list[tuple[int, int]]:
    """Append records, each a gzip member of its own; returns their offsets and lengths."""
    places = []
    for text in texts:
        at = stream.tell()
        stream.write(gzip.compress(text.encode(), mtime=0))
        places.append((at, stream.tell() - at))
    return places


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of a WARC file, gzipped or not."""
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip()] = value.strip()
        yield headers, stream.read(int(headers["Content-Length"]))
