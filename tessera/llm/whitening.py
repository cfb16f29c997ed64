"""Operator 13: whitening of embeddings by a matrix-free block Lanczos iteration.

The fit list holds each distinct vector once.  The covariance is never formed: a pass over the fit list gives the
product of the centred data with a block of directions, summed over all tasks.  Block Lanczos builds an orthonormal
basis from such products, reorthogonalised in full against all before; a block that loses rank is filled up with
fresh random directions, and a basis that has grown too large restarts from its best directions.  The leading
directions are done when their residuals are, for eigenvalues and vectors to double precision.

Centring is exact: entries are whole numbers, so ``n * x - S`` is one, and deviations are summed as whole numbers.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry are left out; vectors shorter than the
longest are filled up with zeros; entries beyond +-2^52 / 256 are held at that; an empty vector is zeros; a deviation that
doesn't fit a long is null; repeated rows get a row each and count once in the fit list; equal eigenvalues give any
directions of their space; directions without variance can't be whitened and are left out, so a fit list of one vector
gives no rows; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, spread

SCALE, COMPONENTS = 256, 4
#: Entries are held between plus and minus this.
LARGEST = 1 << 52
#: Directions of a block, blocks of a basis before it restarts, directions kept by a restart, and passes at most.
BLOCK, BASIS_BLOCKS, KEPT_BLOCKS, MOST_PASSES = 8, 12, 2, 400
#: Residuals relative to the largest eigenvalue that count as none, and norms of a direction that is lost in a block.
TOLERANCE, LOST = 1e-14, 1e-10
#: An eigenvalue below this share of the largest is none.
FLAT = 1e-12
#: Partial sums are added up in Spark in pieces of so many numbers.
PIECE = 4096
LONG = (1 << 63) - 1


class Centre(NamedTuple):
    """The fit list's size and sums, as exact whole numbers."""

    n: int
    sums: list[int]
    #: Whether ``n * x - S``, and the sum of its squares, stay below 2^63.
    fits: bool

    def moved(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: as integers of 64 bits, or of any size."""
        kind = np.int64 if self.fits else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` as doubles."""
        moved = self.moved(x)
        # a whole number and its divisor are rounded once
        return np.array(moved / self.n, dtype=np.float64)


def whole_vectors(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``x`` (array of whole numbers) of the rows that have a usable vector."""
    rows = embeddings.select(embeddings[id_col].alias("id"), embeddings[vector_col].cast("array<double>").alias("v"))
    usable = rows.where("v is not null and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    return spread(usable.select("id", F.expr(f"transform(v, c -> cast(greatest(least(floor(c * {SCALE}d), {LARGEST}d), {-LARGEST}d) as long))").alias("x")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column, filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    at = np.cumsum(lengths) - lengths
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(at, lengths)] = flat
    return out


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], width: int, size: int) -> np.ndarray:
    """The sum over all rows (``x``) of what ``part`` gives for a batch: ``size`` doubles.

    Each task passes on one sum; these are added up by pieces, so the driver gets ``size`` numbers.
    """
    schema = "piece int, numbers array<double>"

    def batch_of(found: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.list_(pa.float64()))], names=["piece", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(matrix(batch.column(0), width)).ravel()
                total = own if total is None else total + own
        if total is not None:
            yield batch_of({p: total[s : s + PIECE] for p, s in enumerate(range(0, size, PIECE))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, numbers in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = numbers.values.to_numpy(zero_copy_only=False)
                totals[p] = totals[p] + own if p in totals else own
        yield batch_of(totals)

    out = np.zeros(size)
    for r in rows.select("x").mapInArrow(run, schema).repartition("piece").mapInArrow(add, schema).collect():
        out[r["piece"] * PIECE : r["piece"] * PIECE + len(r["numbers"])] = r["numbers"]
    return out


def centre(fit: DataFrame) -> tuple[Centre, int]:
    """The exact size and sums of the fit list, and its width."""
    found = fit.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.max(F.expr("aggregate(x, 0L, (a, c) -> greatest(a, abs(c)))")).alias("most")).first()
    n, width, most = found["n"], found["width"] or 0, found["most"] or 0
    # one row for each dimension, summed before the shuffle
    sums = [0] * width
    for r in fit.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect():
        sums[r["d"]] = int(r["s"])
    return Centre(n, sums, width * (2 * n * most) ** 2 < LONG and n * most < 1 << 52), width


class Lanczos:
    """The leading eigenvectors of a symmetric positive operator that is only known by its products with blocks."""

    def __init__(self, product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, seed: int = 13) -> None:
        self.product, self.width, self.wanted = product, width, min(wanted, width)
        self.draw = np.random.default_rng(seed)
        self.passes = self.restarts = self.breakdowns = 0

    def orthonormal(self, block: np.ndarray, basis: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` directions orthonormal to each other and to ``basis``: those of ``block``, then random ones."""
        out = np.empty((self.width, 0))
        room = min(most, self.width - basis.shape[1])
        columns = list(block.T)
        while out.shape[1] < room:
            fresh = not columns
            v = self.draw.standard_normal(self.width) if fresh else columns.pop(0)
            size = np.linalg.norm(v)
            for _ in range(3):  # full reorthogonalisation, repeated until nothing is left to take off
                for other in (basis, out):
                    v = v - other @ (other.T @ v)
            left = np.linalg.norm(v)
            if not left > LOST * size:
                self.breakdowns += not fresh
                continue
            out = np.c_[out, v / left]
        return out

    def solve(self) -> tuple[np.ndarray, np.ndarray]:
        """The leading eigenvalues, falling, and their unit vectors as columns."""
        basis, images = np.empty((self.width, 0)), np.empty((self.width, 0))
        block = self.orthonormal(np.empty((self.width, 0)), basis, BLOCK)
        while True:
            image = self.product(block)
            self.passes += 1
            basis, images = np.c_[basis, block], np.c_[images, image]
            small = basis.T @ images
            values, turn = np.linalg.eigh((small + small.T) / 2)
            order = np.argsort(-values)
            values, vectors, moved = values[order], basis @ turn[:, order], images @ turn[:, order]
            k = self.wanted
            residuals = np.linalg.norm(moved[:, :k] - vectors[:, :k] * values[:k], axis=0)
            whole = basis.shape[1] == self.width
            if len(values) >= k and (whole or (residuals <= TOLERANCE * max(values[0], 0.0)).all()) or self.passes >= MOST_PASSES:
                vectors = vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0)
                return values[:k], vectors
            if basis.shape[1] + BLOCK > BLOCK * BASIS_BLOCKS:
                self.restarts += 1
                kept = BLOCK * KEPT_BLOCKS
                basis, images = vectors[:, :kept], moved[:, :kept]
                block = self.orthonormal(moved[:, :BLOCK] - vectors[:, :BLOCK] * values[:BLOCK], basis, BLOCK)
            else:
                block = self.orthonormal(image, basis, BLOCK)


class Whitening(NamedTuple):
    centre: Centre
    width: int
    #: Columns are the components.
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def deviations(moved: np.ndarray) -> list[int]:
    return [int(v) for v in (moved * moved).sum(axis=1)]


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a materialised fit list (``x``); None where nothing varies."""
    at, width = centre(fit)
    if at.n < 2 or not width:
        return None
    product = lambda block: summed(fit, lambda x: (c := at.centred(x)).T @ (c @ block), width, width * block.shape[1]).reshape(width, -1) / at.n
    values, vectors = Lanczos(product, width, components).solve()
    trace = total_deviation(fit, at, width) / at.n**3
    kept = values > FLAT * trace
    if not trace or not kept.any():
        return None
    values, vectors = values[kept], vectors[:, kept]
    found = Whitening(at, width, vectors, values, values / trace, 0.0)
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = found.project(x)
        return np.r_[w.sum(axis=0), (w.T @ w).ravel()]

    sums = summed(fit, moments, width, k + k * k) / at.n
    covariance = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
    return found._replace(identity_error=float(np.abs(covariance - np.eye(k)).max()))


def total_deviation(fit: DataFrame, at: Centre, width: int) -> int:
    """The sum of the deviations of the fit list, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([str(sum(deviations(at.moved(matrix(batch.column(0), width)))))])], names=["sum"])

    # a decimal has room for 10^38; parts beyond it are added by the driver, one for each task
    parts = fit.select("x").mapInArrow(run, "sum string")
    exact = parts.agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("s")).first()["s"] if at.fits else None
    return int(exact) if exact is not None else sum(int(r["sum"]) for r in parts.collect())


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    rows = whole_vectors(embeddings, id_col, vector_col)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    # the same vector has the same entries, whatever zeros it was given without
    filled = rows.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("x"))
    fit = materialize(filled.distinct(), "fit")
    found = fit_whitening(fit, components)
    kinds = {"component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(), "whitened": pa.float64(), "explained": pa.float64(), "identity_error": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(found.values)
        for batch in batches:
            x = matrix(batch.column(1), found.width)
            far = [d if d <= LONG else None for d in deviations(found.centre.moved(x))]
            n = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array([found.centre.n] * (n * k), pa.int64()), pa.array([d for d in far for _ in range(k)], pa.int64()),
                    pa.array(found.project(x).ravel()), pa.array(np.tile(found.explained, n)), pa.array([found.identity_error] * (n * k), pa.float64()),
                ],
                names=["id", *kinds],
            )

    schema = f"id {dict(rows.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return (rows.mapInArrow(run, schema) if found else embeddings.sparkSession.createDataFrame([], schema)).withColumnRenamed("id", id_col)
