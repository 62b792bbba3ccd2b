"""Where intermediate results go: the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; unset, a temporary folder in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def with_conf(spark: SparkSession, **values: str) -> Iterator[None]:
    """Set options of Spark SQL, named with ``__`` for a dot, for what is run within."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def write(df: DataFrame, path: str, mode: str = "error", **options: str) -> None:
    """Write ``df`` to a new folder, or with ``append`` to one that is there; the files of its shuffles go once it is written, not when the driver next collects garbage."""
    with with_conf(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.mode(mode).options(compression="zstd", **options).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends."""
    spark = df.sparkSession
    path = _new_cut(spark)
    write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def _new_cut(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """The same as ``cut`` for as long as it is needed: the folder is deleted at the end."""
    spark = df.sparkSession
    path = _new_cut(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        write(df, path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Locked(Exception):
    """Another writer is at work, or died and left its lock."""


@contextmanager
def only_writer(spark: SparkSession, name: str) -> Iterator[None]:
    """Hold the file ``name``, which only one can make at a time; on object stores no lock holds, and their users must see to it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    try:
        if fs.getScheme() == "file":
            os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        else:
            fs.create(path, False).close()
    except Exception as taken:
        if isinstance(taken, FileExistsError) or "FileAlreadyExists" in str(taken):
            raise Locked(f"{name} is held; if its writer died, delete it") from None
        raise
    try:
        yield
    finally:
        fs.delete(path, False)
