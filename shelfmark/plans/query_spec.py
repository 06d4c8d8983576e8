"""A query over a wide table as data: filters, order and page, turned into one DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def number(text) -> float | None:
    """A finite number or None: bad input is ignored, not an error."""
    try:
        value = float(text)
    except (TypeError, ValueError):
        return None
    return value if value == value and abs(value) != float("inf") else None


def ranges(params: dict, columns: list[str]) -> list[Column]:
    """``min_<column>`` and ``max_<column>`` as closed bounds."""
    out = []
    for name in columns:
        low, high = number(params.get(f"min_{name}")), number(params.get(f"max_{name}"))
        out += [F.col(name) >= low] * (low is not None) + [F.col(name) <= high] * (high is not None)
    return out


def equals(params: dict, columns: list[str]) -> list[Column]:
    return [F.col(c) == params[c] for c in columns if params.get(c) not in (None, "")]


def ordered(column: str, descending: bool, key: str = "path", last_both_ways: tuple[str, ...] = ()) -> list[Column]:
    """Null placement of the catalogue: first ascending, last descending; some columns always last. The key breaks ties."""
    c = F.col(column)
    first = c.desc_nulls_last() if descending else c.asc_nulls_last() if column in last_both_ways else c.asc_nulls_first()
    return [first, F.col(key).asc()]


def page_count(total: int, per_page: int) -> int:
    return max(1, -(-total // per_page))


@dataclass
class QuerySpec:
    """Filters, sort and page of one request."""

    filters: list[Column] = field(default_factory=list)
    sort: str = "aggregate"
    descending: bool = True
    page: int = 1
    per_page: int = 50
    key: str = "path"

    def where(self, df: DataFrame) -> DataFrame:
        return df.where(reduce(and_, self.filters)) if self.filters else df

    def rows(self, df: DataFrame) -> DataFrame:
        return self.where(df).orderBy(*ordered(self.sort, self.descending, self.key)).offset((self.page - 1) * self.per_page).limit(self.per_page)


#: Saved kinds of view: each is a set of parameters.
PRESETS = {"top_picks": {"min_aggregate": 8}, "sharp": {"min_tech_sharpness": 6}, "urgent": {"category": "1-URGENT"}, "weak": {"max_aggregate": 2}}


def normalise(params: dict) -> dict:
    """A preset's parameters beneath the given ones; an unknown type names a category."""
    kind = params.get("type")
    base = PRESETS.get(kind, {"category": kind} if kind else {})
    return base | {k: v for k, v in params.items() if k != "type" and v not in (None, "")}


def composite(params: dict, numeric: list[str], exact: list[str]) -> list[Column]:
    params = normalise(params)
    return ranges(params, numeric) + equals(params, exact)
