"""Statistics of any variable over its units and periods, also picked by another variable."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..plans.layout import unit_name, units_of
from ..plans.series import MAX_WIDE, ROUNDING, Long, Wide, check_policy, n_periods
from .bioclim import cv, with_exprs

STATS = ("mean", "sum", "max", "min", "stdev", "cv_cli", "max_period", "min_period")
INTER_STATS = ("max_inter", "min_inter")
INDICES = ("max_unit", "min_unit", "max_period", "min_period", "max_interactive", "min_interactive")


def derive(
    df: DataFrame,
    variable: str,
    n_units: int = 12,
    stats: Iterable[str] | None = ("mean", "max", "min"),
    *,
    inter_variable: str | None = None,
    inter_stats: Iterable[str] | None = None,
    prefix: str = "var",
    suffix_inter_max: str = "inter_high",
    suffix_inter_min: str = "inter_low",
    period_length: int = 3,
    period_stat: str = "mean",
    circular: bool = True,
    na_policy: str = "skip",
    ddof: int = 1,
    indices: dict[str, str] | None = None,
    cell: str = "cell",
) -> DataFrame:
    """`cell` and ``<prefix>_<statistic>`` columns, in the order of STATS and INTER_STATS.

    `indices` maps names of INDICES to columns that choose the unit or period per cell. Periods of the inter
    variable that differ by rounding only are ties, which take the first."""
    check_policy(na_policy)
    stats, inter_stats = list(stats or ()), list(inter_stats or ())
    indices = dict(indices or {})
    for given, known, what in ((stats, STATS, "stats"), (inter_stats, INTER_STATS, "inter_stats"), (indices, INDICES, "indices")):
        if bad := [s for s in given if s not in known]:
            raise ValueError(f"unknown {what}: {bad}; choose among {list(known)}")
    if not stats and not inter_stats:
        raise ValueError("no statistic was asked for")
    if period_stat not in ("mean", "sum"):
        raise ValueError("period_stat must be 'mean' or 'sum'")
    static = {"max_inter": indices.get("max_interactive"), "min_inter": indices.get("min_interactive")}
    if inter_variable is None and any(static[s] is None for s in inter_stats):
        raise ValueError("inter_stats need inter_variable or a static interactive index")
    k = n_periods(n_units, period_length, circular)
    wide = n_units <= MAX_WIDE
    for v in (variable, inter_variable):
        if v is not None and wide and units_of(df, v) != n_units:
            raise ValueError(f"{v} must have {n_units} units, found {units_of(df, v)}")

    def series(v: str, n: int = n_units):
        return Wide([unit_name(v, i, n_units) for i in range(1, n + 1)], na_policy) if wide else Long(v, n, na_policy)

    def moving(v: str, name: str) -> dict[str, str]:
        value = series(v).periods(period_length, circular, period_stat)
        return {unit_name(name, i, n_units): c for i, c in enumerate(value, 1)} if wide else {name: value}

    def array(v: str, n: int = n_units) -> Long:
        return Long(f"array({', '.join(series(v, n).cols)})" if wide else v, n, na_policy)

    ranked = [s for s in inter_stats if static[s] is None]
    first = {"mean_own": series(variable).mean()}
    if {"max_period", "min_period", *INTER_STATS} & {*stats, *inter_stats}:
        first |= moving(variable, "period_own")
    layers = [first, {}, {"sd_own": series(variable).sd("mean_own", ddof)}]
    if ranked:
        first |= moving(inter_variable, "period_inter")
        periods, low, high = series("period_inter", k), Long("low_inter", k, na_policy), Long("high_inter", k, na_policy)
        widest = f"2 * {ROUNDING} * least({period_length} * {series(inter_variable).size()}, 1e300D)"
        layers[1] = {f"end_{s}": getattr(periods, s[:3])() for s in ranked} | {"widest_inter": widest}
        sides = {"max_inter": (">=", "-", low, high), "min_inter": ("<=", "+", high, low)}
        for s in ranked:
            how, off, _, _ = sides[s]
            layers[2] |= {f"exact_{s}": periods.first_at(f"end_{s}"), f"near_{s}": periods.first_at(f"(end_{s} {off} widest_inter)", how)}
        # Few cells have an earlier period within the widest margin; these alone are looked at with the margin of each period.
        unsure = " OR ".join(f"near_{s} < exact_{s}" for s in ranked)
        values, margins = array("period_inter", k), Long("margin_inter", k, na_policy)
        layers.append({margins.col: f"CASE WHEN {unsure} THEN {array(inter_variable).margins(period_length, circular, period_stat)} END"})
        layers.append({low.col: values.minus(margins).col, high.col: values.plus(margins).col})
        layers.append({f"bound_{s}": getattr(sides[s][2], s[:3])() for s in ranked})
        layers.append({f"at_{s}": f"coalesce({sides[s][3].first_at(f'bound_{s}', sides[s][0])}, exact_{s})" for s in ranked})
    for layer in layers:
        df = with_exprs(df, layer)

    def value(s: str) -> str:
        if s == "mean":
            return "mean_own"
        if s == "stdev":
            return "sd_own"
        if s == "cv_cli":
            return cv("sd_own" if ddof == 1 else f"({series(variable).sd('mean_own')})", "mean_own", strictly=False)
        if s == "sum":
            return series(variable).sum()
        if s in ("max", "min"):
            at = indices.get(f"{s}_unit")
            return series(variable).at(at) if at else getattr(series(variable), s)()
        periods = series("period_own", k)
        if s in ("max_period", "min_period"):
            return periods.at(indices[s]) if s in indices else getattr(periods, s[:3])()
        return periods.at(static[s] or f"at_{s}")

    suffix = {"cv_cli": "cv", "max_inter": suffix_inter_max, "min_inter": suffix_inter_min}
    order = [s for s in (*STATS, *INTER_STATS) if s in stats or s in inter_stats]
    return df.selectExpr(cell, *[f"{value(s)} AS {prefix}_{suffix.get(s, s)}" for s in order])
