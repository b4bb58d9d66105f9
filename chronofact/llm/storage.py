"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch; bounds what a Python worker holds when texts are long.
BATCH_ROWS, BATCH_BYTES = 10_000, 2 * 2**20
#: Rows of a batch that the Parquet reader decodes at once, and bytes that a Parquet writer gathers: with texts in the
#: rows, the defaults (4096 rows, 128 MB) are what fills executors.
READ_ROWS, WRITE_BYTES = 256, 8 * 2**20


def tune(spark: SparkSession) -> None:
    """Bounds what tasks hold of tables with texts, in the session that runs them: Arrow batches, so that a run of very
    long texts cannot fill a Python worker, and batches of Parquet readers and writers. Lets each job's shuffle files go
    when it has ended, as what a later job needs is written to the shared folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("parquet.block.size", str(WRITE_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Gives back to the system what this process's allocators keep of freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Batches) -> Batches:
    """``run`` for ``mapInArrow``, giving back to the system at its task's end what allocators keep: workers live on
    between tasks, and those of several operators stand side by side."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="chronofact-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that workers write files into and read them from, by the URI's own file system."""
    path = new_path(spark, name)
    files, inner = pyarrow.fs.FileSystem.from_uri(path)
    files.create_dir(inner, recursive=True)
    return path


def write_file(folder: str, data: bytes) -> str:
    """Writes a file under a name of its own, so that attempts of a task never meet; the URI is what the task returns."""
    path = f"{folder}/{uuid.uuid4().hex}"
    files, inner = pyarrow.fs.FileSystem.from_uri(path)
    with files.open_output_stream(inner) as out:
        out.write(data)
    return path


def read_file(path: str) -> bytes:
    files, inner = pyarrow.fs.FileSystem.from_uri(path)
    with files.open_input_stream(inner) as data:
        return data.read()


def mounted(path: str) -> str:
    """The path as the operating system knows it, for files that workers memory-map."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a shared folder that is mounted on every node, not {path}")
    return parts.path
