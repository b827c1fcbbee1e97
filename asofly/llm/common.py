"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


#: Bytes of a batch that goes to a Python worker at most (one row at least), where the session keeps Spark's own default.
BATCH_BYTES = 4 << 20
VECTORED = "parquet.hadoop.vectored.io.enabled"


def plain_reads(spark: SparkSession) -> None:
    """From now on the session reads Parquet without vectored reads, unless it sets them itself.

    These fetch a column's whole chunk at once, through buffers outside the heap that each reading thread keeps.
    """
    if spark.conf.get(VECTORED, None) is None:
        spark.conf.set(VECTORED, "false")


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame; from now on its session cuts Arrow batches by BATCH_BYTES, unless it sets a limit itself.

    Texts differ in length by four orders of magnitude, so a limit of rows alone bounds nothing.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) in ("64MB", "67108864b", "67108864"):
        conf.set(name, str(BATCH_BYTES))
    plain_reads(df.sparkSession)
    return df


def give_back() -> None:
    """Memory that this process has freed goes back to the system, where its C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; a worker outlives its tasks, so what one has freed is given back when it ends."""

    def then_given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return then_given_back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and everything runs on one machine (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="asofly-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def stash(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write a frame to the shared folder and read it again, which cuts its lineage and survives lost executors."""
    plain_reads(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/asofly-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of df whose id is in ids: a broadcast while ids has at most BROADCAST_ROWS rows, else a shuffle join."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, id_col, "left_semi")


def held_out(doc_id, folds: int = 3, fold: int = 1):
    """Whether a document belongs to the held-out fold: crc32 of its id as text."""
    return F.crc32(doc_id.cast("string")) % folds == fold
