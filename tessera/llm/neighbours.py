"""Links and classes of 64-bit fingerprints that share a search key.

Operators give every distinct fingerprint a few 64-bit keys such that fingerprints within the wanted distance
share one.  ``links`` verifies the members of each key and returns edges that connect exactly what all pairs
within the distance would connect, without listing those pairs: small runs give their own links, a larger run
gives a spanning forest found by a breadth-first search.  ``classes`` turns edges into connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.similar import whole_runs

#: Runs up to this length list their links; longer ones give a spanning forest.
SMALL_RUN = 8


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def spanning_edges(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over distinct ``values`` that connects all within ``radius`` of each other.

    Each value is compared with those not reached yet only, so a dense run costs little more than its length.
    """
    left, right = [], []
    rest = values
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = distance(rest, at) <= radius
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), at, np.uint64))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def run_edges(keys: np.ndarray, values: np.ndarray, radius: int, small: int = SMALL_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Edges within the runs of equal ``keys`` (sorted); runs of up to ``small`` give all of them."""
    n = len(keys)
    if n < 2:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, n])
    left, right = [], []
    listed = np.repeat(lengths <= small, lengths)
    for step in range(1, small):
        at = np.flatnonzero((keys[:-step] == keys[step:]) & listed[:-step]) if step < n else np.empty(0, np.int64)
        if not len(at):
            break
        at = at[distance(values[at], values[at + step]) <= radius]
        left.append(values[at])
        right.append(values[at + step])
    for s, k in zip(starts[lengths > small], lengths[lengths > small]):
        a, b = spanning_edges(np.unique(values[s : s + k]), radius)
        left.append(a)
        right.append(b)
    a, b = np.concatenate(left or [np.empty(0, np.uint64)]), np.concatenate(right or [np.empty(0, np.uint64)])
    differ = a != b
    return a[differ], b[differ]


def links(fingerprints: DataFrame, keys_of: Callable[..., np.ndarray], radius: int) -> DataFrame:
    """Distinct edges (``a`` < ``b``) over the fingerprints in column ``fp`` (long), each of them once.

    ``keys_of`` maps n fingerprints to an (n, k) array of unsigned keys; 0 stands for no key.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(values), 4096):
                part = values[s : s + 4096]
                keys = keys_of(part)
                # a fingerprint's equal keys count once
                keys = np.sort(keys, axis=1)
                keep = (keys != 0) & np.c_[np.ones(len(keys), bool), keys[:, 1:] != keys[:, :-1]]
                out = keys[keep], np.repeat(part, keep.sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in out], names=["key", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in whole_runs(batches):
            a, b = (x.view(np.int64) for x in run_edges(keys, values.view(np.uint64), radius))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    keyed = fingerprints.select("fp").mapInArrow(emit, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a long, b long").distinct()


#: Members of a run that are counted against each other in one task; longer runs are cut in blocks of so many, and
#: members compared at a time.
BLOCK_ROWS, COUNT_ROWS = 8192, 512


def link_counts(prints: DataFrame, tables_of: Callable[[np.ndarray], np.ndarray], radius: int) -> DataFrame:
    """``fp`` and ``n_near``: the rows (``n`` for each distinct ``fp``) within ``radius`` bits of each fingerprint, itself included.

    ``tables_of`` maps n fingerprints to an (n, k) array of keys, one for each of k tables.  A pair is counted in the
    first table that it shares a key of, so nothing is counted twice and no pair is ever listed: a run only gives a
    number for each member.  Runs longer than ``BLOCK_ROWS`` are cut in blocks, each two of which are a run of a task.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for s in range(0, len(values), 4096):
                keys = tables_of(values[s : s + 4096].view(np.uint64)).view(np.int64)
                k = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(keys))), pa.array(np.repeat(values[s : s + 4096], k)), pa.array(np.repeat(n[s : s + 4096], k))], names=["key", "place", "fp", "n"])

    def near(values: np.ndarray, others: np.ndarray, place: int) -> np.ndarray:
        """Which pairs are counted here: near, and with no earlier table in common."""
        found = distance(values[:, None], others[None, :]) <= radius
        i, j = np.nonzero(found)
        if place and len(i):
            mine, theirs = tables_of(values)[:, :place], tables_of(others)[:, :place]
            earlier = np.zeros(len(i), bool)
            for t in range(place):
                earlier |= mine[i, t] == theirs[j, t]
            found[i[earlier], j[earlier]] = False
        return found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, places, values, n, sides in whole_runs(batches):
            values = values.view(np.uint64)
            total = np.zeros(len(values), np.int64)
            starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(runs)]):
                if e - s == 1 and places[s]:
                    continue
                first = sides[s:e] == sides[s:e].min()
                two = not first.all()
                left = s + np.flatnonzero(first)
                right = s + np.flatnonzero(~first) if two else left
                for b in range(0, len(left), COUNT_ROWS):
                    at = left[b : b + COUNT_ROWS]
                    hit = near(values[at], values[right], int(places[s]))
                    total[at] += hit @ n[right]
                    if two:  # within one side each pair is met from both ends
                        total[right] += n[at] @ hit
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(values[met].view(np.int64)), pa.array(total[met])], names=["fp", "n_near"])

    keyed = prints.select("fp", "n").mapInArrow(emit, "key long, place int, fp long, n long")
    long = materialize(keyed.groupBy("key").count().where(F.col("count") > BLOCK_ROWS).select("key", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")), "long-runs")
    whole = keyed.select(F.col("key").alias("run"), "place", "fp", "n", F.lit(0).alias("side"))
    if not long.isEmpty():
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        cut = keyed.join(long, "key").withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # two runs that share a hash would be taken for one: the key itself stays apart by its table, which is its upper bits
        run = F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other"))
        whole = keyed.join(long, "key", "left_anti").select(F.col("key").alias("run"), "place", "fp", "n", F.lit(0).alias("side")).unionByName(cut.select(run.alias("run"), "place", "fp", "n", "side"))
    counted = whole.repartition("run").sortWithinPartitions("run", "place").mapInArrow(count, "fp long, n_near long")
    return counted.groupBy("fp").agg(F.sum("n_near").alias("n_near"))


def classes(edges: DataFrame) -> DataFrame:
    """Connected components of edges (``a``, ``b``): every node with the smallest node it reaches (``node``, ``root``).

    Alternates large-star and small-star steps; each keeps the number of edges and ends after a number of rounds
    that grows with the logarithm of the number of nodes.  Every round is written to the shared folder.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def stars(pairs: DataFrame, of: str) -> DataFrame:
        """Hang ``of`` rows of each node on the smallest neighbour, itself included."""
        low = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return pairs.join(low, "a").select("a", "b", "m").where(of)

    current = materialize(edges.select("a", "b"), "edges")
    before = None
    while True:
        # large-star: neighbours above a node go to the node's smallest neighbour
        large = stars(both(current), "b > a").select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        # small-star: a node and its lower neighbours go to the smallest of them
        lower = large.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        low = lower.groupBy("a").agg(F.min("b").alias("m"))
        hung = lower.join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y")
        small = hung.unionByName(low.select(F.col("a").alias("x"), F.col("m").alias("y")))
        current = materialize(small.distinct().select(F.col("y").alias("a"), F.col("x").alias("b")), "edges", instead_of=current)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return current.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = state
