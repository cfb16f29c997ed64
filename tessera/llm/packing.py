"""Operator 8: best-fit packing with certified bounds and repacking.

Documents are tokenised, closed with an end id and cut into pieces of at most the capacity.  Groups of pieces of
bounded size are packed best-fit decreasing; a lower bound from dual-feasible functions certifies a group's
number of bins.  Groups with a gap give up their emptiest bins, certified groups only the bins that are far from
full; what is given up is exchanged, regrouped into fewer groups and packed again, until one group is left.

Defined results: a null text counts as empty and gives one piece with the end id alone; ties of length keep any
order; repeated rows are packed each on their own; documents longer than the capacity are cut and never
dropped; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import MEMO_ENTRIES, bpe
from tessera.llm.common import materialize, spread

CAPACITY = 4096
END_ID = 1
#: Bins and pieces that a group should have at most.
GROUP_BINS = 4096
GROUP_PIECES = 200_000
#: Groups that are put together for the next round, and the emptiest bins that one gives up at most.
FAN_IN = 8
RELEASED_BINS = 512
#: A certified group keeps bins that are at least so full.
FULL_ENOUGH = 0.95
#: Parameters of the rounding dual-feasible functions.
ROUNDING = range(1, 33)

PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, memo: int = MEMO_ENTRIES) -> DataFrame:
    """``id_col``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of every piece."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(tokenizer_path, memo)
        for batch in batches:
            row, number, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = coder.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32"])

    source = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, {PIECE}").withColumnRenamed("id", id_col)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer bins: the best of two families of dual-feasible functions over the lengths."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    many, total = np.cumsum(counts), np.cumsum(counts * sizes)
    best = -(-int(total[-1]) // capacity)
    # threshold t: larger than capacity - t counts as full, smaller than t as nothing
    t = np.arange(1, capacity // 2 + 1)
    value = (many[-1] - many[capacity - t]) * capacity + total[capacity - t] - total[t - 1]
    best = max(best, -(-int(value.max()) // capacity)) if len(value) else best
    for k in ROUNDING:
        whole, rest = np.divmod((k + 1) * sizes, capacity)
        # times k * capacity, to stay with integers
        scaled = np.where(rest == 0, sizes * k, whole * capacity)
        best = max(best, -(-int((counts * scaled).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = made = 0  # bit r of rooms: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, made


def pack(cut: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``; ``cut`` is read more than once: pass a materialised table."""
    total = cut.agg(F.sum("length").alias("tokens"), F.count("*").alias("n")).first()
    groups = max(1, -(-(total["tokens"] or 0) // (capacity * GROUP_BINS)), -(-total["n"] // GROUP_PIECES))
    columns = [id_col, "piece", "start", "length", "ids_crc32"]
    schema = f"id {dict(cut.dtypes)[id_col]}, {PIECE}, sequence_id long, offset long, released boolean"
    pool, done, level = cut.select(*columns).withColumnRenamed(id_col, "id"), [], 0
    while True:
        last = groups == 1

        def run(key: tuple, table: pa.Table) -> pa.Table:  # noqa: B023  pickled in the round that defines it
            lengths = table.column("length").to_numpy()
            bins, offsets, made = best_fit_decreasing(lengths, capacity)
            fill = np.bincount(bins, weights=lengths, minlength=made)
            given = np.zeros(made, bool)
            if not last:
                certified = made == lower_bound(lengths, capacity)
                loose = np.flatnonzero(fill < (FULL_ENOUGH * capacity if certified else capacity))
                given[loose[np.argsort(fill[loose], kind="stable")][:RELEASED_BINS]] = True
            ids = bins | (key[0].as_py() << 24) | (level << 56)
            table = table.drop_columns(["group"])
            return table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets)).append_column("released", pa.array(given[bins]))

        # any even deal does; the number of the row spreads repeated rows as well
        dealt = pool.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        packed = materialize(dealt.groupBy("group").applyInArrow(run, schema), f"packed-{level}")
        done.append(packed.where(~F.col("released")))
        if last:
            break
        pool, groups, level = packed.where("released").select("id", *columns[1:]), -(-groups // FAN_IN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("released").withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, memo: int = MEMO_ENTRIES) -> DataFrame:
    """Tokenise, cut and pack all documents; ``memo`` bounds the words that a worker remembers."""
    return pack(materialize(pieces(docs, tokenizer_path, id_col, text_col, capacity, memo=memo), "pieces"), id_col, capacity)
