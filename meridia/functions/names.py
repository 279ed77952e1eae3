"""Catalogue of the derived variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.bioclim import closure, names, needs


def catalogue(spark: SparkSession, bios=range(1, 36)) -> DataFrame:
    """(bio, variable, name, inputs, computed_from) of the variables asked for."""
    listed = names(bios)
    rows = [(int(k[3:]), k, v, ",".join(sorted(needs([int(k[3:])]))), ",".join(f"bio{b:02d}" for b in sorted(closure([int(k[3:])]) - {int(k[3:])}))) for k, v in listed.items()]
    return spark.createDataFrame(rows, "bio int, variable string, name string, inputs string, computed_from string")
