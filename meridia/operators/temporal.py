"""Summaries over layers in time order: by groups of layers, and rolling over cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.layout import missing
from ..plans.series import Wide, check_policy


def group_name(prefix: str, group) -> str:
    return f"{prefix}_{group:02d}" if isinstance(group, int) else f"{prefix}_{group}"


def _grouped(long: DataFrame, index: Sequence[int], n_layers: int, prefix: str, fold: str, na_policy: str, cell: str, layer: str, value: str) -> DataFrame:
    check_policy(na_policy)
    if len(index) != n_layers:
        raise ValueError(f"Length of 'index' ({len(index)}) must be the number of layers ({n_layers})")
    if any(g is None for g in index):
        raise ValueError("'index' must not hold missing values")
    v = missing(F.col(value).cast("double"))
    out = []
    for g in sorted(set(index)):
        mine = [i + 1 for i, x in enumerate(index) if x == g]
        picked = F.when(F.col(layer).isin(mine), v)
        total = F.sum(picked) if fold == "sum" else F.avg(picked)
        if na_policy == "strict":
            total = F.when(F.count(picked) == len(mine), total)
        out.append(total.alias(group_name(prefix, g)))
    return long.groupBy(cell).agg(*out)


def average(long: DataFrame, index: Sequence[int], *, n_layers: int, prefix: str = "avg_unit", na_policy: str = "skip", cell: str = "cell", layer: str = "layer", value: str = "value") -> DataFrame:
    """The mean of the layers of each group: a column per group, in order, from one aggregation."""
    return _grouped(long, index, n_layers, prefix, "mean", na_policy, cell, layer, value)


def total(long: DataFrame, index: Sequence[int], *, n_layers: int, prefix: str = "sum_unit", na_policy: str = "skip", cell: str = "cell", layer: str = "layer", value: str = "value") -> DataFrame:
    """The sum of the layers of each group."""
    return _grouped(long, index, n_layers, prefix, "sum", na_policy, cell, layer, value)


FOLDS = ("mean", "sum", "min", "max", "stdev", "median")
DEFAULT_NAME = "{prefix}_w{start_window}-{end_window}_u{idx_unit}"


def window_starts(n_layers: int, window_size: int | None, freq: int, step: int) -> list[int]:
    if window_size is None:
        raise ValueError("'window_size' is required")
    if freq < 1 or n_layers % freq:
        raise ValueError(f"the number of layers ({n_layers}) is not divisible by frequency ({freq})")
    cycles = n_layers // freq
    if window_size > cycles:
        raise ValueError(f"'window_size' ({window_size}) cannot be larger than total cycles ({cycles})")
    if window_size < 1 or step < 1:
        raise ValueError("'window_size' and 'step' must be positive")
    return list(range(1, cycles - window_size + 2, step))


def roll_name(template: str, prefix: str, start: int, unit: int, starts: list[int], window_size: int, freq: int) -> str:
    width = len(str(starts[-1]))
    return template.format(prefix=prefix, start_window=f"{start:0{width}d}", end_window=f"{start + window_size - 1:0{width}d}", idx_unit=f"{unit:0{len(str(freq))}d}")


def roll(
    long: DataFrame,
    window_size: int | None = None,
    *,
    n_layers: int,
    freq: int = 12,
    step: int = 1,
    fun: str = "mean",
    na_policy: str = "skip",
    cell: str = "cell",
    layer: str = "layer",
    value: str = "value",
) -> DataFrame:
    """(cell, unit, start, end, value): each unit of the cycle summarised over each window of cycles.

    One aggregation by cell and unit unrolls the cycles; the windows are expressions over them."""
    check_policy(na_policy)
    starts = window_starts(n_layers, window_size, freq, step)
    if fun not in FOLDS:
        raise ValueError(f"fun must be one of {list(FOLDS)}")
    cycles = n_layers // freq
    at = F.col(layer) - 1
    placed = long.where(F.col(layer).between(1, n_layers)).select(cell, (at % freq + 1).cast("int").alias("unit"), F.floor(at / freq).cast("int").alias("cycle"), missing(F.col(value).cast("double")).alias("v"))
    wide = placed.groupBy(cell, "unit").agg(*[F.expr(f"max(CASE WHEN cycle = {c} THEN v END) AS c{c}") for c in range(cycles)])

    def folded(start: int) -> str:
        s = Wide([f"c{c}" for c in range(start - 1, start - 1 + window_size)], na_policy)
        return s.sd(f"({s.mean()})") if fun == "stdev" else getattr(s, fun)()

    rows = [f"named_struct('start', {s}, 'end', {s + window_size - 1}, 'value', {folded(s)})" for s in starts]
    return wide.selectExpr(cell, "unit", f"inline(array({', '.join(rows)}))")


def roll_layers(rolled: DataFrame, window_size: int, *, n_layers: int, freq: int = 12, step: int = 1, prefix: str = "output", template: str = DEFAULT_NAME, cell: str = "cell") -> DataFrame:
    """The result of `roll` as one named column per window and unit."""
    starts = window_starts(n_layers, window_size, freq, step)
    cols = [F.expr(f"max(CASE WHEN start = {s} AND unit = {u} THEN value END)").alias(roll_name(template, prefix, s, u, starts, window_size, freq)) for s in starts for u in range(1, freq + 1)]
    return rolled.groupBy(cell).agg(*cols)


