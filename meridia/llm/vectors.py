"""Vector columns: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vec_col: str, *, nonzero: bool) -> DataFrame:
    """(vec_id, v) of the rows with an id and a non-empty vector of finite components (of a length above 0 if `nonzero`)."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def dimension(rows: DataFrame) -> tuple[int, int]:
    """(the most frequent vector length, the number of vectors of that length); (0, 0) without vectors."""
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return (top[0]["d"], top[0]["count"]) if top else (0, 0)


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """float64[row, dim] of a list column whose rows all have `dim` values."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, dim))
    return np.asarray(col.flatten()).astype(np.float64).reshape(-1, dim)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, each summed in one fixed order (equal rows give equal sums)."""
    return (a * b).sum(axis=1)


def best(query: DataFrame, k: int) -> DataFrame:
    """The k best rows (query_id, vec_id, score) of each query: highest score, then smallest vec_id."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = query.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
