"""From facts to cells: LONG (a row per cell and unit), WIDE (a row per cell, a column per variable and
unit) and CUBE (a row per cell, an array per variable)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIABLES = ("tmin", "tmax", "prcp", "tavg", "srad", "mois")


def unit_name(variable: str, unit: int, n_units: int) -> str:
    return f"{variable}_{unit:0{max(2, len(str(n_units)))}d}"


def missing(c: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(c), c)


def to_wide(long: DataFrame, variables: dict[str, tuple[str, str]] | list[str], n_units: int, *, cell: str = "cell", unit: str = "unit") -> DataFrame:
    """One conditional aggregation, so one exchange. A variable is an aggregate of a LONG column, given as
    (template with {}, column), or a column that holds one value per cell and unit."""
    made = variables if isinstance(variables, dict) else {v: ("max(CASE WHEN NOT isnan({0}) THEN {0} END)", f"double({v})") for v in variables}
    out = [f"{how.format(f'CASE WHEN {unit} = {i} THEN {col} END')} AS {unit_name(v, i, n_units)}" for v, (how, col) in made.items() for i in range(1, n_units + 1)]
    return long.groupBy(cell).agg(*map(F.expr, out))


def to_cube(wide: DataFrame, variables: list[str], n_units: int, *, cell: str = "cell") -> DataFrame:
    return wide.selectExpr(cell, *[f"array({', '.join(unit_name(v, i, n_units) for i in range(1, n_units + 1))}) AS {v}" for v in variables])


def from_cube(cube: DataFrame, variables: list[str], n_units: int, *, cell: str = "cell") -> DataFrame:
    """Unrolled columns; an array of another length than `n_units` raises when it is read."""
    def value(v: str, i: int) -> str:
        wrong = f"double(raise_error(concat('{v} must hold {n_units} units, found ', size({v}))))"
        x = f"get({v}, {i - 1})"
        return f"CASE WHEN {v} IS NULL OR size({v}) = {n_units} THEN CASE WHEN NOT isnan({x}) THEN {x} END ELSE {wrong} END AS {unit_name(v, i, n_units)}"

    return cube.selectExpr(cell, *[value(v, i) for v in variables for i in range(1, n_units + 1)])


def to_long(wide: DataFrame, variables: list[str], n_units: int, *, cell: str = "cell", unit: str = "unit") -> DataFrame:
    rows = [f"named_struct('{unit}', {i}, {', '.join(f"'{v}', {unit_name(v, i, n_units)}" for v in variables)})" for i in range(1, n_units + 1)]
    return wide.selectExpr(cell, f"inline(array({', '.join(rows)}))")


def units_of(df: DataFrame, variable: str) -> int:
    """How many unit columns (or 0) a WIDE frame holds of a variable."""
    return sum(c.startswith(f"{variable}_") and c[len(variable) + 1 :].isdigit() for c in df.columns)
