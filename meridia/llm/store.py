"""Intermediate tables that outlive an executor.

Everything a later job reads more than once is written as Parquet below the folder that
``spark.checkpoint.dir`` names (shared by driver and executors), so losing an executor
costs a re-read and not a recomputation of the lineage.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one is set only where the session names none (tests)."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="meridia-")
        sc.setCheckpointDir(known)
    return known.rstrip("/")


_shipped: set[str] = set()
#: Bytes of an Arrow batch, which a Python worker and its executor's off-heap buffers hold at a time.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
#: Rows that a scan decodes at a time: long texts in batches of thousands would be arrays of tens of megabytes.
SCAN_ROWS = ("spark.sql.parquet.columnarReaderBatchSize", "512")
#: Shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage. (A lazy result
#: that is run a second time makes them anew.)
CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once (they may not have it installed).

    Batches are bounded in bytes (rows may be long texts) and shuffle files freed early, unless the session sets its own way."""
    sc = spark.sparkContext
    for k, v in (BATCH_BYTES, SCAN_ROWS, CLEANUP):
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    tmp = os.path.realpath(tempfile.mkdtemp(prefix="meridia-code-"))  # served by the driver until it ends
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{tmp}/{top.name}-{uuid.uuid4().hex[:8]}", "zip", top.parent, top.name))
    _shipped.add(sc.applicationId)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


#: Of a file system mounted at all machines (file://): files without checksum files. Without its native library, Hadoop starts a
#: process for each file and folder there to set its permissions.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Scratch:
    """The written intermediate tables of one query.

    ``put`` writes and re-reads a frame, ``drop`` deletes what no later job needs. What the
    returned (lazy) frame still reads stays until ``close`` or the end of the session.
    """

    _open: list["Scratch"] = []

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.plain = hadoop_path(spark, self.root)[0].getScheme() == "file"
        Scratch._open.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**(PLAIN_FILES if self.plain else {})).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        if self in Scratch._open:
            Scratch._open.remove(self)
            delete(self.spark, self.root)

    @classmethod
    def close_all(cls) -> None:
        """For a caller that has already written every result it took from earlier queries."""
        for s in list(cls._open):
            s.close()


@atexit.register
def _at_end() -> None:
    for s in list(Scratch._open):
        try:
            s.close()
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def plain(df: DataFrame) -> DataFrame:
    """The columns under the names c0, c1, ..., so that added columns can't clash with any (nor names that differ in case only)."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def named(df: DataFrame, names: list[str]) -> DataFrame:
    """The first columns of `df` under `names` again; columns after them go."""
    return df.select(*[F.col(f"c{i}") for i in range(len(names))]).toDF(*names)


def flat_lists(col: pa.Array, *fields: int) -> tuple:
    """Offsets and the values of the struct fields of a list column (a null list is empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.asarray(col.value_lengths().fill_null(0), np.int64)
    values = col.flatten()
    return np.concatenate(([0], np.cumsum(size))), *(np.asarray(values.field(i)) for i in fields)
