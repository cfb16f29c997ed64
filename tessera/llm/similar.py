"""All pairs of similar sets: a prefix filter, cheap bounds, and exact verification.

Sets of 64-bit hashes are put in one order for all, the frequent hashes last (by counts over all documents).  Two
sets with a Jaccard similarity of ``least`` share one of the first hashes of either (``prefix_length``), so each set
is listed under those; sets under one key make a run.  Of a pair in a run, the place of the key bounds the overlap;
so do the parities of the hashes' buckets, which differ in no more places than the sets have hashes apart, and for
large sets the buckets' counts.  These bounds hold for every similar pair.

Short runs list all their pairs.  Longer runs first compare all members with a few centres, which makes one class
of most copies; then every two members that are still in different classes are compared, long runs in blocks that
are spread over tasks.  So the classes are those that all similar pairs would make, but a group of copies doesn't
list all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_pieces

#: Buckets of the parities.
PARITY_BITS = 1024
#: Sets of so many hashes also have counts of their buckets.
LARGE_SET = 1024
#: Runs up to this length list their pairs; of longer ones so many members are centres at first.
SHORT_RUN, CENTRES = 8, 4
#: Buckets (a power of two) whose counts over all documents put the hashes in order.  They only decide the order.
ORDER_BUCKETS = 1 << 20
#: Buckets whose counts are summed as one row.
ORDER_PIECE = 1 << 12
#: Members of a long run in one block.
RUN_ROWS = 4096
#: Bits of the filter that tells which documents' sets are asked for.
FILTER_BITS = 1 << 24
#: Members compared at a time.
BLOCK = 64
EPSILON = 1e-9


def digest(hashes: np.ndarray) -> int:
    """A signed 64-bit digest of a sorted set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def parities(hashes: np.ndarray) -> bytes:
    """For each bucket, whether it has an odd number of the hashes."""
    odd = np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def bucket_counts(hashes: np.ndarray) -> bytes | None:
    """How many hashes each bucket has (up to 255), for large sets."""
    if len(hashes) < LARGE_SET:
        return None
    counts = np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def prefix_length(n: int, least: float) -> int:
    """How many of a set's first hashes meet those of every similar set."""
    return n - math.ceil(least * n - EPSILON) + 1


def order_bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(65 - ORDER_BUCKETS.bit_length())).astype(np.int64)


def prefix(hashes: np.ndarray, frequency: np.ndarray, least: float) -> np.ndarray:
    """The first hashes of a sorted set: by the frequency of their buckets, then by value."""
    return hashes[np.argsort(frequency[order_bucket(hashes)], kind="stable")][: prefix_length(len(hashes), least)]


def frequencies(texts: DataFrame, set_of: Callable[[str | None], np.ndarray]) -> np.ndarray:
    """The counts of all ``ORDER_BUCKETS`` buckets over the sets of all ``texts`` (one column).

    Tasks pass on their counts, not the hashes; the driver gets one number for each bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_BUCKETS, np.int64)
        for batch in in_pieces(batches, 0):
            held, n = [], 0
            for text in batch.column(0):
                held.append(order_bucket(set_of(text.as_py())))
                n += len(held[-1])
                if n >= ORDER_BUCKETS:
                    total += np.bincount(np.concatenate(held), minlength=ORDER_BUCKETS)
                    held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=ORDER_BUCKETS)
        pieces = total.reshape(-1, ORDER_PIECE)
        filled = np.flatnonzero(pieces.any(axis=1))
        for p in filled.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([pieces[p].tobytes()], pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(counts.as_py(), np.int64)
                totals[p] = totals[p] + own if p in totals else own
        for p, counts in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["piece", "counts"])

    schema = "piece int, counts binary"
    out = np.zeros((ORDER_BUCKETS // ORDER_PIECE, ORDER_PIECE), np.int64)
    for r in texts.mapInArrow(count, schema).repartition("piece").mapInArrow(add, schema).collect():
        out[r["piece"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out.reshape(-1), (1 << 32) - 1).astype(np.uint32)


def most_apart(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """In how many hashes similar sets of these sizes differ at most."""
    return (n + m) * (1 - least) / (1 + least) + EPSILON


def may_overlap(n: np.ndarray, room: np.ndarray, m: np.ndarray, room_m: np.ndarray, least: float) -> np.ndarray:
    """Whether sets that first meet with so many hashes left after the key can be similar."""
    return (1 + np.minimum(room, room_m)) * (1 + least) >= least * (n + m) - EPSILON


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut where the first column changes."""
    held: list[pa.RecordBatch] = []

    def columns() -> list[np.ndarray]:
        table = pa.Table.from_batches(held)
        return [np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy() for c in table.columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
        if held and (cut or keys[0] != held[-1].column(0)[0].as_py()):
            held.append(batch.slice(0, cut))
            yield columns()
            held = []
        elif cut:
            held = [batch.slice(0, cut)]
            yield columns()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield columns()


def bounds_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])


def first_pairs(keys: np.ndarray, room: np.ndarray, n: np.ndarray, old: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs in sorted runs: all among a run's first ``SHORT_RUN`` members, the others with its centres.

    The second of a pair is never among the first ``old`` rows.  Also returns each row's place in its run.
    """
    starts, lengths = bounds_of(keys)
    start = np.repeat(starts, lengths)
    rank, left, right = np.arange(len(keys)) - start, [], []
    fresh = np.arange(len(keys)) >= old
    for step in range(1, SHORT_RUN):
        at = np.flatnonzero(fresh & (rank >= step) & (rank < SHORT_RUN))
        left.append(at - step)
        right.append(at)
    later = np.flatnonzero(fresh & (rank >= SHORT_RUN))
    for centre in range(CENTRES):
        left.append(start[later] + centre)
        right.append(later)
    i, j = np.concatenate(left), np.concatenate(right)
    keep = may_overlap(n[i], room[i], n[j], room[j], least)
    return i[keep], j[keep], rank


def close(odd: np.ndarray, other: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs of rows have parities that differ in no more than ``most`` places."""
    at, apart = np.arange(len(i)), np.zeros(len(i), np.int64)
    for w in range(odd.shape[1]):
        apart = apart + np.bitwise_count(odd[i[at], w] ^ other[j[at], w])
        near = apart <= most[at]
        at, apart = at[near], apart[near]
    return at


def as_words(odd: list[bytes] | np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(odd), np.uint64).reshape(len(odd), -1)


def cross_pairs(sets: np.ndarray, n: np.ndarray, room: np.ndarray, root: np.ndarray, side: np.ndarray, odd: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a run in different classes that the bounds don't exclude: of different sides, if there are two."""
    words = as_words(odd)
    first = np.flatnonzero(side == side.min())
    other = np.flatnonzero(side == side.max())
    for s in range(0, len(first), BLOCK):
        own = first[s : s + BLOCK, None]
        i, j = np.nonzero((root[own] != root[other]) & may_overlap(n[own], room[own], n[other], room[other], least))
        i, j = own[i, 0], other[j]
        at = close(words, words, i, j, most_apart(n[i], n[j], least))
        yield sets[i[at]], sets[j[at]]


def edges(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]


def listed(sets: DataFrame, least: float) -> DataFrame:
    """From ``sets`` (``set``, ``n``, ``prefix``): first pairs (``a``, ``b``), and the members of longer runs (``key``, ``set``, ``n``, ``room``)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lengths = batch.column(2).flatten(), batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            n = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), lengths)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            own = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lengths)
            yield pa.RecordBatch.from_arrays([keys, pa.array(own), pa.array(n, pa.int32()), pa.array(n - place - 1, pa.int32())], names=["key", "set", "n", "room"])

    names, kinds = ["a", "b", "key", "set", "n", "room"], [*[pa.int64()] * 4, *[pa.int32()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the first members of the run that the last batch ended in, and whether they have been passed on
        held, passed = [np.empty(0, k.to_pandas_dtype()) for k in kinds[2:]], False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, own, n, room = (np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns))
            old = len(held[0])
            i, j, rank = first_pairs(keys, room.astype(np.int64), n.astype(np.int64), old, least)
            found = edges(own[i], own[j])
            yield pa.RecordBatch.from_arrays([*found, *(pa.nulls(len(i), k) for k in kinds[2:])], names=names)
            starts, lengths = bounds_of(keys)
            long = np.repeat(lengths > SHORT_RUN, lengths)
            if passed:
                long[:old] = False
            members = [pa.array(c[long]) for c in (keys, own, n, room)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(members[0]), k) for k in kinds[:2]), *members], names=names)
            passed = bool(lengths[-1] > SHORT_RUN)
            held = [c[starts[-1] : starts[-1] + SHORT_RUN] for c in (keys, own, n, room)]

    keyed = sets.select("set", "n", "prefix").mapInArrow(emit, "key long, set long, n int, room int")
    return keyed.repartition("key").sortWithinPartitions("key", "set").mapInArrow(run, "a long, b long, key long, set long, n int, room int")


def in_blocks(members: DataFrame) -> DataFrame:
    """Members of long runs (``key``, ``set``, ``root``, ...) in blocks that are compared: ``low``, ``high``, ``side``.

    Runs of one class drop out.  The members of a run's largest class are only compared with the others, the rest
    with all.
    """
    by_class = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    most = F.max_by("root", F.struct("c", "root"))
    sizes = by_class.groupBy("key").agg(most.alias("_most"), F.max("c").alias("_l"), (F.sum("c") - F.max("c")).alias("_o")).where("_o > 0")
    blocks = sizes.select("key", "_most", *(F.ceil(F.col(c) / RUN_ROWS).cast("int").alias(c) for c in ("_l", "_o")))
    dealt = members.join(blocks, "key").withColumn("_listens", F.col("root") == F.col("_most"))
    own = F.when(F.col("_listens"), F.col("_o") + F.pmod(F.xxhash64("set"), F.col("_l"))).otherwise(F.pmod(F.xxhash64("set"), F.col("_o"))).cast("int")
    against = F.sequence(F.lit(0), F.when(F.col("_listens"), F.col("_o")).otherwise(F.col("_o") + F.col("_l")) - 1)
    spread = dealt.withColumn("side", own).withColumn("_with", F.explode(against))
    return spread.withColumn("low", F.least("side", "_with")).withColumn("high", F.greatest("side", "_with"))


def crossing(members: DataFrame, least: float) -> DataFrame:
    """Pairs (``a``, ``b``) from the members of longer runs (``key``, ``set``, ``n``, ``room``, ``root``, ``odd``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, *columns in whole_runs(batches):
            for s, k in zip(*bounds_of(runs)):
                own, n, room, root, side, odd = (c[s : s + k] for c in columns)
                for a, b in cross_pairs(own, n.astype(np.int64), room.astype(np.int64), root, side, odd, least):
                    yield pa.RecordBatch.from_arrays(edges(a, b), names=["a", "b"])

    # a collision of two runs only adds pairs, which are verified like all
    dealt = in_blocks(members).select(F.xxhash64("key", "low", "high").alias("run"), "set", "n", "room", "root", "side", "odd")
    return dealt.repartition("run").sortWithinPartitions("run").mapInArrow(run, "a long, b long").distinct()


def bounded(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` whose parities and counts (``sets``: ``set``, ``n``, ``odd``, ``counts``) don't exclude that they are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 5))
            both, every = [as_words(batch.column(i).to_pylist()) for i in (3, 6)], np.arange(len(n))
            most = most_apart(n, m, least)
            kept = []
            for i in close(*both, every, every, most).tolist():
                x, y = batch.column(4)[i].as_py(), batch.column(7)[i].as_py()
                if x is None or y is None or np.abs(np.frombuffer(x, np.uint8).astype(np.int64) - np.frombuffer(y, np.uint8)).sum() <= most[i]:
                    kept.append(i)
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    a, b = (sets.select(F.col("set").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "odd", "counts"))) for x in "ab")
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "odd_a", "counts_a", "n_b", "odd_b", "counts_b")
    return joined.mapInArrow(run, "a long, b long")


def filter_bits(ids: DataFrame) -> np.ndarray:
    """A bitmap (bytes) of the hashes of ``ids`` (one column): of fixed size, whatever their number."""
    bit = F.pmod(F.xxhash64(ids.columns[0]), F.lit(FILTER_BITS))
    per_row = 4096 * 8
    rows = ids.groupBy(F.floor(bit / per_row).cast("int").alias("at")).agg(F.expr(f"bitmap_construct_agg(pmod(xxhash64(`{ids.columns[0]}`), {per_row}L))").alias("bits")).collect()
    out = np.zeros((-(-FILTER_BITS // per_row), 4096), np.uint8)
    for r in rows:
        out[r["at"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which signed hashes may be those of the ids that the bitmap was made from."""
    at = np.mod(hashes, FILTER_BITS)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def verified(pairs: DataFrame, hashes_of: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """Those of ``pairs`` that are similar by the exact sets; ``hashes_of`` gives ``set`` and ``hashes`` of a table of ``set``."""
    sets = hashes_of(pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct())
    a, b = (sets.select(F.col("set").alias(x), F.col("hashes").alias(f"_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(a, "a").join(b, "b").where(shared * (1 + least) >= least * (F.size("_a") + F.size("_b")) - EPSILON).select("a", "b")
