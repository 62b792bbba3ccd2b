"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: long texts must not add up to gigabytes in a Python worker.
ROWS_PER_BATCH = "400"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder; Arrow batches are kept small for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Unset, a temporary folder serves in local mode; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that ``cut`` has written and nothing has deleted.
_CUTS: list[str] = []


def cuts() -> int:
    """How many folders are kept."""
    return len(_CUTS)


def drop_cuts(spark: SparkSession, since: int) -> None:
    """Delete what was cut after there were ``since`` folders, but for the last one."""
    for path in _CUTS[since:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _CUTS[since:-1]


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def giving_back(run: Step) -> Step:
    """``run`` for Arrow batches; at the end of a task its worker, which is kept, returns the memory that it has freed."""

    def whole(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(stream)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def utf8(text: Column) -> Column:
    """The text as UTF-8 bytes; null stays null."""
    return text.cast("binary")


def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Each Arrow batch as lists of Python values, one per column."""
    for batch in stream:
        if batch.num_rows:
            yield [column.to_pylist() for column in batch.columns]


def set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns of these names renamed, and the columns that bring all of them back."""
    own = {c: f"aside_{k}" if c in names else c for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(c).alias(new) for c, new in own.items())), [F.col(new).alias(c) for c, new in own.items()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one after another and the bounds of its rows; a null row is empty."""
    column = column.fill_null(b"")
    kind = np.int32 if pa.types.is_binary(column.type) else np.int64
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def row_hash(*columns: np.ndarray) -> np.ndarray:
    """``xxhash64`` of Spark for columns of longs, as longs."""
    h = np.full(1, 42, np.uint64)
    for x in columns:
        h = (h + (_P5 + np.uint64(8))) ^ _turned(x.view(np.uint64) * _P2, 31) * _P1
        h = _turned(h, 27) * _P1 + _P4
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        h = h ^ h >> np.uint64(32)
    return h.view(np.int64)
