"""Validation of inputs: equal geometry, and the same pattern of missing values across variables."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.layout import unit_name
from .region import GridSpec


def geometry_report(grids: dict[str, GridSpec]) -> dict[str, list[str]]:
    """For each input that differs from the first: the properties in which it does."""
    first, *rest = grids.items()
    props = ("nrows", "ncols", "xmin", "xmax", "ymin", "ymax", "crs")
    report = {n: [p for p in props if getattr(g, p) != getattr(first[1], p)] for n, g in rest}
    return {n: p for n, p in report.items() if p}


def missing_codes(wide: DataFrame, variables: list[str], n_units: int, *, cell: str = "cell") -> DataFrame:
    """Per cell: a code per variable (0: all units missing, 1: some, 2: none) and `mismatch`, the range of the codes."""
    def code(v: str):
        have = reduce(add, [F.when(F.col(unit_name(v, i, n_units)).isNotNull(), 1).otherwise(0) for i in range(1, n_units + 1)])
        return F.when(have == 0, 0).when(have == n_units, 2).otherwise(1)

    coded = wide.select(cell, *[code(v).alias(f"code_{v}") for v in variables])
    cols = [F.col(f"code_{v}") for v in variables]
    spread = F.greatest(*cols) - F.least(*cols) if len(cols) > 1 else F.lit(0)
    return coded.withColumn("mismatch", spread)


def missing_report(wide: DataFrame, variables: list[str], n_units: int, *, cell: str = "cell") -> DataFrame:
    """One row: cells, mismatch_sum, mismatched_cells, is_valid."""
    codes = missing_codes(wide, variables, n_units, cell=cell)
    total = F.coalesce(F.sum("mismatch"), F.lit(0))
    return codes.agg(F.count("*").alias("cells"), total.cast("long").alias("mismatch_sum"), F.count_if(F.col("mismatch") > 0).alias("mismatched_cells"), (total == 0).alias("is_valid"))


def key_differences(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("cell", "unit")) -> DataFrame:
    """Keys present on one side only, with the side."""
    left, right = (x.select(*keys).distinct() for x in (a, b))
    return left.join(right, list(keys), "left_anti").withColumn("only_in", F.lit("first")).union(right.join(left, list(keys), "left_anti").withColumn("only_in", F.lit("second")))
