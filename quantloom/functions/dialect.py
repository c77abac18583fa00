"""Window formulas as SQL text, for Spark and, in tests and checks, for a second engine."""

from __future__ import annotations

from dataclasses import dataclass

KEYS = "symbol, timeframe"


def over(rows: int | None = None, *, keys: str = KEYS, order: str = "open_time", until: int = 0) -> str:
    """A frame of the last ``rows`` rows (all if None) up to ``until`` rows before this one."""
    start = "UNBOUNDED PRECEDING" if rows is None else f"{rows - 1 + until} PRECEDING"
    end = "CURRENT ROW" if not until else f"{until} PRECEDING"
    return f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {start} AND {end})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {KEYS} ORDER BY open_time)"


def full(x: str, n: int, value: str) -> str:
    """value where the last n rows all have x, else NULL."""
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {value} END"


def roll(fn: str, x: str, n: int) -> str:
    return full(x, n, f"{fn}({x}) {over(n)}")


def cumulative(x: str) -> str:
    return f"sum({x}) {over()}"


def keep_null(x: str, value: str) -> str:
    """greatest() and least() skip NULL; a formula must not."""
    return f"CASE WHEN ({x}) IS NOT NULL THEN {value} END"


def rolling_corr(a: str, b: str, n: int) -> str:
    """Population correlation; NULL where one side is constant."""
    w = over(n)
    both = f"CASE WHEN count(({a}) + ({b})) {w} = {n} THEN"
    return f"{both} (covar_pop({a}, {b}) {w}) / nullif((stddev_pop({a}) {w}) * (stddev_pop({b}) {w}), 0) END"


@dataclass(frozen=True)
class Dialect:
    """What differs between the engines: lists over a frame."""

    spark: bool

    def window_list(self, x: str, n: int) -> str:
        return f"{'collect_list' if self.spark else 'list'}({x}) {over(n)}"

    def map_list(self, values: str, body: str, name: str = "v") -> str:
        return f"transform({values}, {name} -> {body})" if self.spark else f"list_transform({values}, lambda {name}: {body})"

    def count_where(self, values: str, body: str, name: str = "v") -> str:
        return f"size(filter({values}, {name} -> {body}))" if self.spark else f"len(list_filter({values}, lambda {name}: {body}))"

    def total(self, values: str) -> str:
        return f"aggregate({values}, 0D, (s, v) -> s + v)" if self.spark else f"list_sum({values})"

    def at(self, values: str, i: str) -> str:
        """The i-th value, from 1."""
        return f"element_at({values}, cast({i} as int))" if self.spark else f"({values})[{i}]"

    def sorted(self, values: str) -> str:
        return f"array_sort({values})" if self.spark else f"list_sort({values})"

    def quantile(self, x: str, q: float, n: int) -> str:
        """Linear interpolation between order statistics."""
        return full(x, n, f"percentile({x}, {q}D) {over(n)}" if self.spark else f"quantile_cont({x}, {q}) {over(n)}")

    def percent_rank(self, x: str, n: int) -> str:
        """Percent of the last n values that are not above this one."""
        return full(x, n, f"100.0 * {self.count_where(self.window_list(x, n), f'v <= ({x})')} / {n}")

    def position_of(self, extreme: str, x: str, n: int) -> str:
        """Place from 1 of the first maximum or minimum of the last n values."""
        values = self.window_list(x, n)
        find = "array_position({}, {}_value)" if self.spark else "list_position({}, {}_value)"
        return find.format(values, extreme)


SPARK = Dialect(True)
DUCKDB = Dialect(False)
