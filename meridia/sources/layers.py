"""Reading and writing cells: LONG tables, one file per layer, and guarded sinks."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_long(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_layers(spark: SparkSession, paths: Sequence[str], n_units: int, *, value: str = "value", cell: str = "cell", unit: str = "unit", fmt: str = "parquet", **options) -> DataFrame:
    """(cell, unit, value) of one file (parquet, orc, csv, json) per layer, in the order of the units."""
    if len(paths) != n_units:
        raise ValueError(f"one file per layer is expected: {len(paths)} files for {n_units} units")
    schema = f"{cell} long, {value} double"
    parts = [spark.read.schema(schema).options(**options).format(fmt).load(p).withColumn(unit, F.lit(i)) for i, p in enumerate(paths, 1)]
    return reduce(DataFrame.unionByName, parts).select(cell, unit, value)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def work_folder(spark: SparkSession) -> str:
    """A new folder's path below the shared one that spark.checkpoint.dir names, removed at the end; a temporary one only in local mode without it."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="meridia-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    folder = f"{shared.rstrip('/')}/layers-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_layers(df: DataFrame, folder: str, *, overwrite: bool = False, by_layer: bool = False, cell: str = "cell", fmt: str = "parquet", **options) -> list[str]:
    """Write a result table, or one file set per result column (`by_layer`; the result is computed once and
    then split). Nothing is written if a target exists and `overwrite` is off. Returns the paths."""
    names, top = [c for c in df.columns if c != cell], folder.rstrip("/")
    targets = [f"{top}/{n}" for n in names] if by_layer else [top]
    if not overwrite and (there := [t for t in targets if _exists(df.sparkSession, t)]):
        raise FileExistsError(f"Output files already exist: {', '.join(there)}")
    mode = "overwrite" if overwrite else "errorifexists"
    if not by_layer:
        df.write.mode(mode).options(**options).format(fmt).save(top)
        return targets
    whole = f"{top}/_all-{uuid.uuid4().hex}"
    df.write.parquet(whole)
    stored = df.sparkSession.read.schema(df.schema).parquet(whole)
    for name, path in zip(names, targets):
        stored.select(cell, name).write.mode(mode).options(**options).format(fmt).save(path)
    _remove(df.sparkSession, whole)
    return targets
