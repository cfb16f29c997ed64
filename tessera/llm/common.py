"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import spread, table

__all__ = ["clean", "delete", "documents", "fold", "in_pieces", "materialize", "shared_dir", "spread", "tables_dir"]


#: Bytes of text that a worker takes from a batch at a time.
PIECE_BYTES = 4 << 20


def in_pieces(batches: Iterator[pa.RecordBatch], at: int = 1, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of at most ``most`` bytes of column ``at`` (one row at least), so that what is made of them
    doesn't grow with the batches.  Nothing is copied."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            end = max(int(np.searchsorted(ends, done + most, side="right")), start + 1)
            yield batch.slice(start, end - start)
            start = end


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Without either a temporary folder serves a local master; a cluster has no folder that could, and raises an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """The folder of all tables that this application writes between its steps."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def clean(spark: SparkSession) -> None:
    """Delete the application's tables; call it when no result is read any more."""
    delete(spark, tables_dir(spark))


def materialize(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage and survives lost executors.

    ``instead_of``: a table made here before that nothing needs any more; its files are deleted.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    if instead_of is not None:
        delete(spark, instead_of._tessera_path)
    return out


def fold(doc_id: Column | str, folds: int = 5) -> Column:
    """``crc32(doc_id as text) mod folds``; a null id falls in fold 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds, F.lit(0))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
