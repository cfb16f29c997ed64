import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.common import materialize

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def brute_bins(lengths, capacity):
    """The least number of bins, by exhaustive search."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i]:
                place(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1 :])
        place(i + 1, rooms + [capacity - lengths[i]])

    place(0, [])
    return best


def test_bounds_never_exceed_the_optimum():
    rnd = random.Random(1)
    for _ in range(150):
        capacity = rnd.choice((10, 17, 30))
        lengths = np.array([rnd.randint(1, capacity) for _ in range(rnd.randint(1, 8))], np.int64)
        best = brute_bins(sorted(lengths.tolist(), reverse=True), capacity)
        made = packing.best_fit_decreasing(lengths, capacity)[2]
        assert packing.lower_bound(lengths, capacity) <= best <= made
    assert packing.lower_bound(np.array([6] * 9), 10) == 9
    assert packing.lower_bound(np.array([], np.int64), 10) == 0


def test_pieces_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(1, None, 0), (2, "", 0), (3, "Hello, world!", 0), (3, "Hello, world!", 1), (4, "many words of text " * 3000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    found = [tuple(r) for r in packing.pieces(docs, PATH).collect()]
    wanted = []
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            wanted.append((i, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted(found) == sorted(wanted)
    packed = packing.pack_documents(docs, PATH).collect()
    assert len(packed) == len(wanted) and check(packed, 4096) == 3
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []


@pytest.mark.parametrize("size", [200_000, 300])
def test_repacking_stays_near_the_bound(spark, monkeypatch, size):
    monkeypatch.setattr(packing, "GROUP_PIECES", size)
    rng = np.random.default_rng(4)
    lengths = np.concatenate([rng.integers(1, 4097, 1500), np.full(400, 7), np.full(200, 4096), np.full(300, 2049)])
    cut = materialize(spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(lengths)], f"doc_id long, {packing.PIECE}"), "test")
    packed = packing.pack(cut).collect()
    assert sorted(r["doc_id"] for r in packed) == list(range(len(lengths)))
    assert check(packed, 4096) <= 1.02 * packing.lower_bound(lengths) + 1
