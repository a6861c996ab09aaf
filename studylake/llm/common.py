"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A mapped Arrow batch is cut once its variable-length results hold so many bytes, so that very long documents
#: never pile up in one Python worker.
OUT_BATCH_BYTES = 8 << 20
#: Rows of a batch that goes to a Python worker.
BATCH_ROWS = 1024


def release() -> None:
    """Give memory that a task is done with back to the system, as its worker may wait for long."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library keeps what is freed, where it is glibc
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as tuples of Python values; a value becomes a Python object only when its row is reached."""
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def to_batches(rows: Iterable[tuple], schema: pa.Schema, weigh: int | None = None, most: int = OUT_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows gathered into Arrow batches of at most 4,096 rows or, by the length of column `weigh`, `most` bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        if weigh is not None and row[weigh] is not None:
            size += len(row[weigh])
        if len(held) >= 4096 or size >= most:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """`df.mapInArrow`, fed with batches of at most BATCH_ROWS rows, so that texts don't pile up on both sides of the
    pipe: it lowers the session's limit where that is higher. After each task the worker gives its memory back."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(limit)) <= BATCH_ROWS:
        df.sparkSession.conf.set(limit, BATCH_ROWS)

    def released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(released, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, read from spark.checkpoint.dir; one is made only for a local session
    that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        directory = spark.sparkContext.getCheckpointDir()
        if not directory and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = directory or tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, what: str, tidy: bool = False) -> DataFrame:
    """Cut the lineage of `df`: it is written as Parquet below the shared folder and read again.

    The copy survives the loss of any executor, and it keeps column statistics and pruning for what reads it. With
    `tidy` the driver collects its garbage, so that Spark drops the shuffle files of the steps behind the copy.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{what}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if tidy:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
