"""One variable of a cell over its time units, as SQL expressions.

Two forms with the same operations: unrolled columns (generated code, for up to `MAX_WIDE`
units) and one array column (for longer series). Expressions are text, parsed once per result
column, which keeps plans of many columns quick to build. A missing value is NULL. Under the policy
"skip" it is left out, under "strict" it makes every result that would read it NULL.
Units, periods and indices count from 1.
"""

from __future__ import annotations

MAX_WIDE = 60
#: Two sums count as equal if they are closer than this share of the magnitudes added up: sums of decimal
#: numbers differ in their last bits with the order of the terms. Magnitudes beyond 1e300 count as 1e300.
ROUNDING = "1e-14D"


def check_policy(policy: str) -> None:
    if policy not in ("skip", "strict"):
        raise ValueError(f"na_policy must be 'skip' or 'strict', not {policy!r}")


def n_periods(n_units: int, period_length: int, circular: bool) -> int:
    """How many periods of `period_length` consecutive units there are; they may wrap if circular."""
    if n_units <= 0:
        raise ValueError("the number of units must be positive")
    if not 1 <= period_length <= n_units:
        raise ValueError(f"period_length must be between 1 and {n_units}")
    return n_units if circular else n_units - period_length + 1


class Wide:
    """A series of columns (or expressions)."""

    def __init__(self, cols: list[str], policy: str = "skip"):
        self.cols, self.policy, self.skip = cols, policy, policy == "skip"

    def __len__(self) -> int:
        return len(self.cols)

    def _guard(self, value: str) -> str:
        """NULL where nothing (skip) or not everything (strict) is present."""
        have = f"coalesce({', '.join(self.cols)}) IS NOT NULL" if self.skip else " AND ".join(f"{c} IS NOT NULL" for c in self.cols)
        return f"CASE WHEN {have} THEN {value} END"

    def count(self) -> str:
        return "(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in self.cols) + ")"

    def sum(self) -> str:
        if not self.skip:
            return f"({' + '.join(self.cols)})"
        return self._guard(" + ".join(f"coalesce({c}, 0D)" for c in self.cols))

    def mean(self) -> str:
        return f"({self.sum()}) / {f'greatest({self.count()}, 1)' if self.skip else len(self.cols)}"

    def _end(self, fold: str) -> str:
        return self._guard(f"{fold}({', '.join(self.cols)})") if len(self.cols) > 1 else self.cols[0]

    def max(self) -> str:
        return self._end("greatest")

    def min(self) -> str:
        return self._end("least")

    def sd(self, mean: str, ddof: int = 1) -> str:
        """Standard deviation about the given mean (two passes)."""
        total = " + ".join(f"coalesce(({c} - {mean}) * ({c} - {mean}), 0D)" for c in self.cols)
        enough = f"{self.count()} > {ddof}" if self.skip else f"{self.count()} = {len(self.cols)} AND {len(self.cols)} > {ddof}"
        return f"CASE WHEN {enough} THEN sqrt(({total}) / greatest({self.count()} - {ddof}, 1)) END"

    def median(self) -> str:
        present = f"array_sort(filter(array({', '.join(self.cols)}), v -> v IS NOT NULL))"
        n = f"size({present})"
        return self._guard(f"(get({present}, int(floor(({n} - 1) / 2))) + get({present}, int(floor({n} / 2)))) / 2")

    def at(self, index: str) -> str:
        """The value at a unit, NULL outside."""
        return f"CASE {index} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(self.cols, 1)) + " END"

    def first_at(self, value: str, how: str = "=") -> str:
        """The lowest unit that holds `value`, or compares with it as `how` says."""
        return "CASE " + " ".join(f"WHEN {c} {how} {value} THEN {i}" for i, c in enumerate(self.cols, 1)) + " END"

    def periods(self, length: int, circular: bool, stat: str) -> list[str]:
        """Sums or means (sums over the full length) of the periods, by their first unit."""
        n = len(self.cols)
        total = [Wide([self.cols[(i + j) % n] for j in range(length)], self.policy).sum() for i in range(n_periods(n, length, circular))]
        return [f"({t}) / {length}" if stat == "mean" else t for t in total]

    def size(self) -> str:
        """The largest magnitude."""
        return Wide([f"abs({c})" for c in self.cols]).max()

    def minus(self, other: "Wide") -> "Wide":
        return Wide([f"({a} - {b})" for a, b in zip(self.cols, other.cols)], self.policy)

    @staticmethod
    def middle(a: "Wide", b: "Wide") -> list[str]:
        return [f"({x} + {y}) / 2" for x, y in zip(a.cols, b.cols)]


class Long:
    """A series in an array column of `n` values."""

    def __init__(self, col: str, n: int, policy: str = "skip"):
        self.col, self.n, self.policy, self.skip = col, n, policy, policy == "skip"

    def __len__(self) -> int:
        return self.n

    def _present(self) -> str:
        return f"filter({self.col}, v -> v IS NOT NULL)"

    def _guard(self, value: str) -> str:
        return f"CASE WHEN size({self._present()}) {'> 0' if self.skip else f'= {self.n}'} THEN {value} END"

    def count(self) -> str:
        return f"size({self._present()})"

    def sum(self) -> str:
        return self._guard(f"aggregate({self._present()}, 0D, (a, v) -> a + v)")

    def mean(self) -> str:
        return f"({self.sum()}) / greatest({self.count()}, 1)"

    def max(self) -> str:
        return self._guard(f"array_max({self.col})")

    def min(self) -> str:
        return self._guard(f"array_min({self.col})")

    def sd(self, mean: str, ddof: int = 1) -> str:
        total = f"aggregate({self._present()}, 0D, (a, v) -> a + (v - {mean}) * (v - {mean}))"
        return self._guard(f"CASE WHEN {self.count()} > {ddof} THEN sqrt({total} / greatest({self.count()} - {ddof}, 1)) END")

    def at(self, index: str) -> str:
        return f"get({self.col}, int({index}) - 1)"

    def first_at(self, value: str, how: str = "=") -> str:
        return f"int(nullif(array_position(transform({self.col}, v -> v {how} {value}), true), 0))"

    def periods(self, length: int, circular: bool, stat: str) -> str:
        k = n_periods(self.n, length, circular)
        ring = f"concat({self.col}, slice({self.col}, 1, {length - 1}))" if circular and length > 1 else self.col
        total = Long(f"slice({ring}, i, {length})", length, self.policy).sum()
        return f"transform(sequence(1, {k}), i -> ({total}){f' / {length}' if stat == 'mean' else ''})"

    def size(self) -> str:
        return f"array_max(transform({self.col}, v -> abs(v)))"

    def margins(self, length: int, circular: bool, stat: str) -> str:
        """What rounding may have added to or taken from each period."""
        sizes = Long(f"transform({self.col}, v -> abs(v))", self.n, self.policy).periods(length, circular, stat)
        return f"transform({sizes}, s -> {ROUNDING} * least(s, 1e300D))"

    def minus(self, other: "Long") -> "Long":
        return Long(f"zip_with({self.col}, {other.col}, (a, b) -> a - b)", self.n, self.policy)

    def plus(self, other: "Long") -> "Long":
        return Long(f"zip_with({self.col}, {other.col}, (a, b) -> a + b)", self.n, self.policy)

    @staticmethod
    def middle(a: "Long", b: "Long") -> str:
        return f"zip_with({a.col}, {b.col}, (x, y) -> (x + y) / 2)"
