"""Shared helpers: tables in the cluster's shared folder, and the package on the executors."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every operator that counts words: space and the five ASCII controls from tab to return.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Bytes of text that a task turns into Python objects at once.
BATCH_BYTES = 2 << 20

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package once per application, so that a cluster needs no installed copy of it, and keep Arrow batches small unless told otherwise."""
    if not spark.sparkContext.getConf().contains(_BATCH):  # a batch is held several times on its way to Python and back
        spark.conf.set(_BATCH, str(2 * BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    parent = os.path.dirname(root)
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset and driver and executors are one process (tests), one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="stratascene-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    A later stage rereads these files when an executor is lost, so nothing before them runs again.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by keys to as many tasks as shuffles have; few bytes can be much work, so small partitions aren't merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small_batches(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column of texts has about ``BATCH_BYTES`` in each, or one row: what a task turns into Python objects at once."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * BATCH_BYTES / max(1, batch.column(text).nbytes)))
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def give_back() -> None:
    """Return what this worker process has freed to the system, where that can be asked for: workers stay for the next stage, which has its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def new_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))
