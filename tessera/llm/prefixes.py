"""Operator 11: the prefix trie of conversations, from one global sort.

Every turn becomes a symbol of fixed width: a digest of its role and text, and the text's length.  A conversation's
path is its symbols in order, so paths sort as turn arrays do, and conversations with a common beginning are
neighbours.  The paths are range-sorted over all partitions (with the id, so that a group of copies is dealt to
many); equal paths are folded to runs.  A sweep over a partition keeps the open nodes on a stack: the longest common
prefix with the row before tells which nodes end and which begin.  Everything a node reports is a sum over its rows,
so nodes that reach over a partition's boundary give partial sums, which are stitched by the digest of their prefix.

Defined results: rows without a ``conv_id`` belong to no conversation and are left out; a null turn comes first;
rows of a conversation with equal turns are ordered by their symbols, and repeated rows are turns of their own; a null
role or text is empty; very long texts only pass through a digest; a conversation has 24 bytes for each turn in one
row; an empty table has no conversation and so no node; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, spread

#: Bytes of a symbol: of the digest, and of the length of the text.
DIGEST, LENGTH = 16, 8
WIDTH = DIGEST + LENGTH
#: Ids of a run that are joined to one text.
RUN_IDS = 4096
#: Children that wait in a sweep for their parent's smallest member; beyond that they get it by a join.
WAITING = 8192
#: Rows of a batch that a sweep passes on.
BATCH_ROWS = 4096
EMPTY = hashlib.sha256(b"").hexdigest()

RUNS = {"p": pa.int32(), "seq": pa.int64(), "path": pa.binary(), "n": pa.int64(), "low": pa.int64(), "ids": pa.string()}
NODES = {
    "p": pa.int32(), "id": pa.int64(), "parent": pa.int64(), "key": pa.binary(), "parent_key": pa.binary(), "wide": pa.bool_(), "depth": pa.int64(), "n": pa.int64(), "low": pa.int64(),
    "children": pa.int64(), "leaves": pa.int64(), "saved": pa.int64(), "ends": pa.string(), "parent_low": pa.int64(), "ids": pa.string(),
}
SQL_TYPES = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.bool_(): "boolean"}


def schema(columns: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {SQL_TYPES[k]}" for c, k in columns.items())


def symbol(role: Column, text: Column) -> Column:
    """The fixed-width symbol of a turn; different roles and texts have different ones."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.concat(F.substring(F.sha2(whole, 256), 1, 2 * DIGEST), F.lpad(F.hex(F.octet_length(text)), 2 * LENGTH, "0")))


def turn_arrays(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``path`` of every conversation of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``).

    Turns are sorted over all partitions, and each gives its part of a conversation as one row.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)].tolist()
            whole = b"".join(batch.column(1).to_pylist())
            found = [whole[WIDTH * s : WIDTH * e] for s, e in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[cuts[:-1]]), batch.column(2).take(pa.array(cuts[:-1])), pa.array(range(seq, seq + len(found)), pa.int64()), pa.array(found, pa.binary())], names=["conv_id", "p", "seq", "symbols"])
            seq += len(found)

    rows = spread(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), symbol(F.col("role"), F.col("text")).alias("symbol")).where("conv_id is not null"))
    dealt = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "symbol").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "symbol")
    found = dealt.select("conv_id", "symbol", F.spark_partition_id().alias("p")).mapInArrow(parts, "conv_id long, p int, seq long, symbols binary")
    whole = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("p", "seq", "symbols"))).alias("parts"))
    return whole.select("conv_id", F.aggregate("parts", F.lit(b""), lambda path, part: F.concat(path, part["symbols"])).alias("path"))


def rebuilt(paths: DataFrame, group: int, most: int) -> DataFrame:
    """Every conversation after the first turns of its group's first one, in place of as many of its own."""
    own = paths.withColumn("base", F.expr(f"conv_id - conv_id % {group}")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1))
    heads = paths.where(f"conv_id % {group} = 0").select(F.col("conv_id").alias("base"), F.substring("path", 1, WIDTH * most).alias("head"))
    joined = own.join(heads, "base", "left")
    return joined.select("conv_id", F.concat(F.coalesce(F.expr(f"substring(head, 1, cast({WIDTH} * h as int))"), F.lit(b"")), F.expr(f"substring(path, cast({WIDTH} * h as int) + 1)")).alias("path"))


def sorted_runs(paths: DataFrame) -> DataFrame:
    """Rows of equal paths in the order of all paths: ``p`` is the partition, ``ids`` the members' ids in order."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held, ids, at = 0, None, [], None
        out: list[tuple] = []
        for batch in batches:
            for path, conv, p in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (path != held or len(ids) >= RUN_IDS):
                    out.append((at, seq, held, len(ids), ids[0], ",".join(map(str, ids))))
                    seq, ids = seq + 1, []
                held, at = path, p
                ids.append(conv)
            yield as_batch(out, RUNS)
            out = []
        if ids:
            yield as_batch([(at, seq, held, len(ids), ids[0], ",".join(map(str, ids)))], RUNS)

    dealt = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return dealt.select("path", "conv_id", F.spark_partition_id().alias("p")).mapInArrow(fold, schema(RUNS))


def as_batch(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    values = list(zip(*rows)) or [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, columns.values())], names=list(columns))


def common(a: bytes | None, b: bytes | None) -> int:
    """How many symbols two paths begin with in common; -1 if there is no path."""
    if a is None or b is None:
        return -1
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[: WIDTH * high] == b[: WIDTH * high]:
        return high
    while high - low > 1:  # the first ``low`` are equal, the first ``high`` are not
        mid = (low + high) // 2
        if a[WIDTH * low : WIDTH * mid] == b[WIDTH * low : WIDTH * mid]:
            low = mid
        else:
            high = mid
    return low


def prefix_key(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[: WIDTH * depth]).digest()[:DIGEST]


class Node:
    """A node on the stack of a sweep."""

    __slots__ = ("children", "depth", "id", "inner", "leaves", "low", "n", "new", "open", "path", "saved", "sha", "waiting", "wide")

    def __init__(self, id: int, depth: int, path: bytes, new: bool, open: bool) -> None:
        self.id, self.depth, self.path, self.new, self.open = id, depth, path, new, open
        self.n = self.children = self.leaves = self.saved = 0
        self.low, self.inner, self.wide, self.sha, self.waiting = None, False, False, None, []


class Sweep:
    """The stack over the sorted runs of one partition; ``before`` and ``after`` are the neighbouring partitions' paths."""

    def __init__(self, p: int, before: bytes | None, after: bytes | None) -> None:
        self.p, self.before, self.after = p, before, after
        self.stack: list[Node] = []
        self.last: bytes | None = None
        self.ids, self.out = 0, []

    def add(self, path: bytes, n: int, low: int, ids: str) -> None:
        depth = len(path) // WIDTH
        shared = common(self.last, path) if self.stack else -1
        while self.stack and self.stack[-1].depth > shared:
            self.close()
        if shared < depth:
            known = -1 if self.stack else common(self.before, path)
            beyond = common(path, self.after)
            for d in range(shared + 1, depth + 1):
                if self.stack:
                    self.stack[-1].inner = True
                self.stack.append(Node(self.ids, d, path, d > known, d <= max(known, beyond)))
                self.ids += 1
        end = self.stack[-1]
        end.n += n
        end.low = low if end.low is None else min(end.low, low)
        if end.open:
            self.out.append((self.p, self.ids, None, prefix_key(path, depth), None, None, None, None, None, None, None, None, None, None, ids))
            self.ids += 1
        elif end.sha is None:
            end.sha = hashlib.sha256(ids.encode())
        else:
            end.sha.update(f",{ids}".encode())
        self.last = path

    def close(self) -> None:
        """Take the top of the stack off: its sums go to its parent, it waits there for the parent's smallest member."""
        node = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        at = WIDTH * node.depth
        size = int.from_bytes(node.path[at - LENGTH : at], "big") if at else 0
        node.saved += (node.n - node.new) * size
        if not node.inner and common(node.path, self.after) < node.depth:
            node.leaves += 1
        for row in node.waiting:
            self.out.append((*row[:13], None if node.open or node.wide else node.low, None))
        row = (self.p, node.id, parent.id if parent else None, prefix_key(node.path, node.depth) if node.open else None, prefix_key(node.path, node.depth - 1) if node.open and node.depth else None, node.wide, node.depth, node.n, node.low, node.children, node.leaves, node.saved, None if node.open else node.sha.hexdigest() if node.sha else EMPTY, None, None)
        if parent is None or node.open:
            self.out.append(row)
        else:
            parent.waiting.append(row)
        if parent is not None:
            parent.n += node.n
            parent.low = node.low if parent.low is None else min(parent.low, node.low)
            parent.children += node.new
            parent.leaves += node.leaves
            parent.saved += node.saved
            if len(parent.waiting) >= WAITING:
                self.out.extend(parent.waiting)
                parent.waiting, parent.wide = [], True

    def finish(self) -> None:
        while self.stack:
            self.close()

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def swept(runs: DataFrame) -> DataFrame:
    """``NODES`` of every partition's sweep: whole nodes, partial sums of open ones (with ``key``), and ends of open ones (with ``ids``)."""
    ends = runs.groupBy("p").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("p")
    # one row for each partition
    around = materialize(ends.select("p", F.lag("last").over(order).alias("path"), F.lead("first").over(order).alias("after")), "around")
    partitions = (around.agg(F.max("p")).first()[0] or 0) + 1
    none = [F.lit(None).cast(k).alias(c) for c, k in (("seq", "long"), ("n", "long"), ("low", "long"), ("ids", "string"))]
    marks = around.select("p", F.lit(0).alias("kind"), "path", "after", *none)
    rows = runs.select("p", F.lit(1).alias("kind"), "path", F.lit(None).cast("binary").alias("after"), "seq", "n", "low", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = None
        for batch in batches:
            for p, kind, path, after, _, n, low, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if sweep:
                        sweep.finish()
                        yield as_batch(sweep.taken(), NODES)
                    sweep = Sweep(p, path, after)
                    continue
                sweep.add(path, n, low, ids)
                if len(sweep.out) >= BATCH_ROWS:
                    yield as_batch(sweep.taken(), NODES)
        if sweep:
            sweep.finish()
            yield as_batch(sweep.taken(), NODES)

    dealt = marks.unionByName(rows).repartitionById(partitions, "p").sortWithinPartitions("p", "kind", "seq")
    return dealt.mapInArrow(run, schema(NODES))


def joined_digests(ends: DataFrame) -> DataFrame:
    """``key`` and ``ends``: the digest of each key's ``ids`` texts, in order, which only stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha = None, None
        columns = {"key": pa.binary(), "ends": pa.string()}
        for batch in batches:
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == held:
                    sha.update(f",{ids}".encode())
                    continue
                if held is not None:
                    out.append((held, sha.hexdigest()))
                held, sha = key, hashlib.sha256(ids.encode())
            yield as_batch(out, columns)
        if held is not None:
            yield as_batch([(held, sha.hexdigest())], columns)

    dealt = ends.select("key", "ids", "p", "id").repartition("key").sortWithinPartitions("key", "p", "id").select("key", "ids")
    return dealt.mapInArrow(run, "key binary, ends string")


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of the trie of ``paths`` (``conv_id``, ``path``): one row for each distinct beginning."""
    nodes = materialize(swept(materialize(sorted_runs(paths), "runs")), "nodes")
    ends = joined_digests(nodes.where("ids is not null"))
    parts = nodes.where("ids is null and key is not null")
    sums = parts.groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("low").alias("low"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")))
    stitched = materialize(sums.join(ends, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(EMPTY))), "stitched")
    above = stitched.select(F.col("key").alias("parent_key"), F.col("low").alias("parent_low"))
    # a whole node below a stitched or wide one looks its parent up among those of its own partition
    whole = nodes.where("ids is null and key is null")
    named = parts.select("p", F.col("id").alias("parent"), "key").join(stitched.select("key", F.col("low").alias("found")), "key").select("p", "parent", "found")
    named = named.unionByName(whole.where("wide").select("p", F.col("id").alias("parent"), F.col("low").alias("found")))
    lacking = whole.where("parent_low is null and parent is not null").drop("parent_low").join(named, ["p", "parent"], "left").withColumnRenamed("found", "parent_low")
    columns = [F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    parted = (whole.where("parent_low is not null or parent is null"), lacking, stitched.join(above, "parent_key", "left"))
    first, *rest = (x.select(*columns) for x in parted)
    for x in rest:
        first = first.unionByName(x)
    return first


def conversation_trie(conversations: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """The trie of all ``conversations``, each rebuilt on the first turns of its group's first conversation."""
    own = materialize(turn_arrays(conversations), "paths")
    return trie(materialize(rebuilt(own, group, most), "rebuilt"))
