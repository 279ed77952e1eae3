"""The 35 bioclimatic variables, as narrow projections over one row per cell."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.layout import VARIABLES, unit_name, units_of
from ..plans.series import MAX_WIDE, Long, Wide, check_policy, n_periods

#: The names of the variables.
NAMES = {
    1: "Mean Temperature",
    2: "Mean Diurnal Range",
    3: "Isothermality",
    4: "Temperature Seasonality",
    5: "Max Temperature of Warmest Unit",
    6: "Min Temperature of Coldest Unit",
    7: "Temperature Range",
    8: "Mean Temperature of Wettest Period",
    9: "Mean Temperature of Driest Period",
    10: "Mean Temperature of Warmest Period",
    11: "Mean Temperature of Coldest Period",
    12: "Total Precipitation",
    13: "Precipitation of Wettest Unit",
    14: "Precipitation of Driest Unit",
    15: "Precipitation Seasonality",
    16: "Precipitation of Wettest Period",
    17: "Precipitation of Driest Period",
    18: "Precipitation of Warmest Period",
    19: "Precipitation of Coldest Period",
    20: "Mean Radiation",
    21: "Highest Radiation Unit",
    22: "Lowest Radiation Unit",
    23: "Radiation Seasonality",
    24: "Radiation of Wettest Period",
    25: "Radiation of Driest Period",
    26: "Radiation of Warmest Period",
    27: "Radiation of Coldest Period",
    28: "Mean Moisture",
    29: "Highest Moisture Unit",
    30: "Lowest Moisture Unit",
    31: "Moisture Seasonality",
    32: "Mean Moisture of Most Moist Period",
    33: "Mean Moisture of Least Moist Period",
    34: "Mean Moisture of Warmest Period",
    35: "Mean Moisture of Coldest Period",
}

#: Period picks: the variable whose periods rank, and whether the highest or the lowest wins.
PICKS = {
    "wettest_period": ("prcp", "max"),
    "driest_period": ("prcp", "min"),
    "warmest_period": ("tavg", "max"),
    "coldest_period": ("tavg", "min"),
    "high_mois_period": ("mois", "max"),
    "low_mois_period": ("mois", "min"),
}
PERIOD_STAT = {"prcp": "sum", "tavg": "mean", "srad": "mean", "mois": "mean"}


@dataclass(frozen=True)
class Rule:
    """How a variable comes about: of which series, which operation, under which unit or period pick."""

    kind: str  # mean, sum, sd, cv, extreme, period, range, ratio, diurnal
    var: str = ""
    pick: str = ""  # static unit index or period index
    side: str = ""  # max or min, of an extreme
    after: tuple[int, ...] = ()


def _rules() -> dict[int, Rule]:
    out = {
        1: Rule("mean", "tavg"),
        2: Rule("diurnal"),
        3: Rule("ratio", after=(2, 7)),
        4: Rule("sd", "tavg"),
        5: Rule("extreme", "tmax", "warmest_unit", "max"),
        6: Rule("extreme", "tmin", "coldest_unit", "min"),
        7: Rule("range", after=(5, 6)),
        12: Rule("sum", "prcp"),
        13: Rule("extreme", "prcp", "wettest_unit", "max"),
        14: Rule("extreme", "prcp", "driest_unit", "min"),
        15: Rule("cv", "prcp"),
        20: Rule("mean", "srad"),
        21: Rule("extreme", "srad", "high_rad_unit", "max"),
        22: Rule("extreme", "srad", "low_rad_unit", "min"),
        23: Rule("cv", "srad"),
        28: Rule("mean", "mois"),
        29: Rule("extreme", "mois", "high_mois_unit", "max"),
        30: Rule("extreme", "mois", "low_mois_unit", "min"),
        31: Rule("sd", "mois"),
    }
    seasons = ("wettest_period", "driest_period", "warmest_period", "coldest_period")
    for first, var in ((8, "tavg"), (16, "prcp"), (24, "srad")):
        out |= {first + i: Rule("period", var, pick) for i, pick in enumerate(seasons)}
    out |= {32 + i: Rule("period", "mois", pick) for i, pick in enumerate(("high_mois_period", "low_mois_period", "warmest_period", "coldest_period"))}
    return dict(sorted(out.items()))


RULES = _rules()
INDICES = tuple(dict.fromkeys(r.pick for r in RULES.values() if r.pick))


def bio_name(bio: int) -> str:
    return f"bio{bio:02d}"


def names(bios: Iterable[int] = range(1, 36)) -> dict[str, str]:
    """Names of the variables asked for."""
    bios = list(bios)
    if bad := [b for b in bios if b not in NAMES]:
        raise ValueError(f"bios must be between 1 and 35, not {bad}")
    return {bio_name(b): NAMES[b] for b in bios}


def closure(bios: Iterable[int]) -> set[int]:
    """The variables asked for and those they are computed from."""
    todo, out = list(bios), set()
    while todo:
        b = todo.pop()
        if b not in out:
            out.add(b)
            todo += RULES[b].after
    return out


def needs(bios: Iterable[int], indices: Iterable[str] = ()) -> set[str]:
    """The series that must be there ("tavg" may be made from tmin and tmax); static indices take over what only ranks."""
    out: set[str] = set()
    for b in closure(bios):
        r = RULES[b]
        if r.kind == "diurnal":
            out |= {"tmin", "tmax"}
        elif r.var:
            out.add(r.var)
        if r.kind == "period" and r.pick not in indices:
            out.add(PICKS[r.pick][0])
    return out


def attach_indices(df: DataFrame, layers: dict[str, DataFrame], *, cell: str = "cell", value: str = "value") -> DataFrame:
    """`df` with static indices (see INDICES) from layers of their own, (cell, value) each, joined by cell; cells that a layer
    lacks get NULL. A layer that repeats a cell is refused when it is read."""
    for name, layer in layers.items():
        if name not in INDICES:
            raise ValueError(f"unknown static index: {name}")
        repeated = F.expr(f"int(raise_error(concat('index layer {name} repeats cell ', {cell})))")
        one = layer.groupBy(cell).agg(F.when(F.count("*") > 1, repeated).otherwise(F.first(F.col(value).cast("int"))).alias(name))
        df = df.drop(name).join(one, cell, "left")
    return df


def derive(
    df: DataFrame,
    n_units: int = 12,
    bios: Iterable[int] = range(1, 36),
    *,
    period_length: int = 3,
    circular: bool = True,
    na_policy: str = "skip",
    indices: Iterable[str] | None = None,
    cell: str = "cell",
) -> DataFrame:
    """`cell` and the variables asked for, ascending.

    `df` has a row per cell with unrolled columns (``tmin_01`` ...) or, beyond MAX_WIDE units, array columns
    of the variables. Columns named like a static index (see INDICES) replace the ranking of units or
    periods, unless `indices` names those to use. A supplied index that is NULL or out of range gives NULL.
    """
    check_policy(na_policy)
    bios = sorted(set(bios))
    names(bios)
    if not bios:
        raise ValueError("no variable was asked for")
    k = n_periods(n_units, period_length, circular)
    use = [i for i in INDICES if i in df.columns] if indices is None else list(indices)
    if unknown := [i for i in use if i not in INDICES or i not in df.columns]:
        raise ValueError(f"unknown or absent static indices: {unknown}")
    wide = n_units <= MAX_WIDE
    have = {v for v in VARIABLES if (units_of(df, v) if wide else v in df.columns)}
    if wide and (uneven := {v: units_of(df, v) for v in have if units_of(df, v) != n_units}):
        raise ValueError(f"every variable must have {n_units} units, found {uneven}")
    wanted = needs(bios, use)
    derived = "tavg" in wanted and "tavg" not in have and {"tmin", "tmax"} <= have
    lacking = sorted(wanted - have - ({"tavg"} if derived else set()))
    if lacking:
        raise ValueError(f"missing input: {', '.join(lacking)}" + (" (or tmin and tmax)" if "tavg" in lacking else ""))

    def series(v: str, n: int = n_units):
        return Wide([unit_name(v, i, n_units) for i in range(1, n + 1)], na_policy) if wide else Long(v, n, na_policy)

    def spread(name: str, value) -> dict[str, str]:
        return {unit_name(name, i, n_units): c for i, c in enumerate(value, 1)} if wide else {name: value}

    rules = {b: RULES[b] for b in closure(bios)}
    picks = {r.pick for r in rules.values() if r.kind == "period"}
    ranked = {p: PICKS[p] for p in picks if p not in use}
    moving = sorted({r.var for r in rules.values() if r.kind == "period"} | {v for v, _ in ranked.values()})
    means = sorted({r.var for r in rules.values() if r.kind in ("mean", "sd", "cv")})
    layers: list[dict[str, str]] = []  # each reads the ones before
    if not wide:  # NaN is missing in arrays, too
        df = df.withColumns({v: F.expr(f"transform({v}, x -> CASE WHEN NOT isnan(x) THEN x END)") for v in sorted(have & (wanted | {"tmin", "tmax"}))})
    if derived:
        layers.append(spread("tavg", (Wide if wide else Long).middle(series("tmin"), series("tmax"))))
    layers.append({f"mean_{v}": series(v).mean() for v in means})
    for v in moving:
        layers[-1] |= spread(f"period_{v}", series(v).periods(period_length, circular, PERIOD_STAT[v]))
    layers.append({f"{side}_{v}": getattr(series(f"period_{v}", k), side)() for v, side in ranked.values()})
    layers.append({f"at_{p}": series(f"period_{v}", k).first_at(f"{side}_{v}") for p, (v, side) in ranked.items()} | {f"at_{i}": i for i in use})
    layers[-1] |= {f"sd_{r.var}": series(r.var).sd(f"mean_{r.var}") for r in rules.values() if r.kind in ("sd", "cv")}

    def value(r: Rule) -> str:
        if r.kind == "mean":
            return f"mean_{r.var}"
        if r.kind == "sum":
            return series(r.var).sum()
        if r.kind == "sd":
            return f"100 * sd_{r.var}"
        if r.kind == "cv":
            return cv(f"sd_{r.var}", f"mean_{r.var}")
        if r.kind == "diurnal":
            return series("tmax").minus(series("tmin")).mean()
        if r.kind == "extreme":
            return series(r.var).at(f"at_{r.pick}") if r.pick in use else getattr(series(r.var), r.side)()
        return series(f"period_{r.var}", k).at(f"at_{r.pick}")

    for layer in layers:
        df = with_exprs(df, layer)
    df = df.selectExpr(cell, *[f"{value(r)} AS {bio_name(b)}" for b, r in sorted(rules.items()) if not r.after])
    if 7 in rules:
        df = with_exprs(df, {"bio07": "bio05 - bio06"})
    if 3 in rules:
        df = with_exprs(df, {"bio03": "CASE WHEN bio07 = 0 THEN 0D ELSE 100 * bio02 / nullif(bio07, 0D) END"})
    return df.select(cell, *[bio_name(b) for b in bios])


def with_exprs(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in exprs.items()]) if exprs else df


def cv(sd: str, mean: str, strictly: bool = True) -> str:
    """100 sd / (1 + mean); 0 where the denominator is not positive (`strictly`) or is zero."""
    return f"CASE WHEN {sd} IS NOT NULL AND 1 + {mean} {'<=' if strictly else '='} 0 THEN 0D ELSE 100 * {sd} / nullif(1 + {mean}, 0D) END"
