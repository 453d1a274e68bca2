"""Aggregate functions: each is applied over an expression of a group's rows.

`over(query)` gives the aggregate Column. Results keep Spark's natural types; sums of nothing are 0, and min, max, only and their
kin fail with Empty (or Size) on no (or several) rows, as the language asks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenrel.plans.errors import fail, guarded

if TYPE_CHECKING:
    from lumenrel.plans.query import Query


@dataclass(frozen=True)
class Aggregate:
    """make: from the argument column and the query to an aggregate column; then: what is done with aggregates of aggregates."""

    make: Callable[[Column | None, Any], Column]
    of: Callable[..., Any] | None = None

    def over(self, q: Query) -> Column:
        return self.make(None if self.of is None else q._value(self.of), q)

    def __add__(self, x: Any) -> Aggregate:
        return self.combine(x, lambda a, b: a + b)

    def __sub__(self, x: Any) -> Aggregate:
        return self.combine(x, lambda a, b: a - b)

    def __mul__(self, x: Any) -> Aggregate:
        return self.combine(x, lambda a, b: a * b)

    def __truediv__(self, x: Any) -> Aggregate:
        return self.combine(x, lambda a, b: a / b)

    def combine(self, x: Any, f: Callable[[Column, Column], Column]) -> Aggregate:
        return Aggregate(lambda _, q: f(self.over(q), x.over(q) if isinstance(x, Aggregate) else F.lit(x)))


def count(of=None) -> Aggregate:
    return Aggregate(lambda _, q: F.count(F.lit(1)))


def empty() -> Aggregate:
    return Aggregate(lambda _, q: F.count(F.lit(1)) == 0)


def non_empty() -> Aggregate:
    return Aggregate(lambda _, q: F.count(F.lit(1)) > 0)


def sum_(of) -> Aggregate:
    return Aggregate(lambda x, q: F.coalesce(F.sum(x), F.lit(0)), of)


def _some(value: Column) -> Column:
    return guarded(F.count(F.lit(1)) > 0, value, "Empty")


def min_(of) -> Aggregate:
    return Aggregate(lambda x, q: _some(F.min(x)), of)


def max_(of) -> Aggregate:
    return Aggregate(lambda x, q: _some(F.max(x)), of)


def only(of) -> Aggregate:
    return Aggregate(lambda x, q: F.when(F.count(F.lit(1)) == 1, F.first(x)).when(F.count(F.lit(1)) == 0, fail("Empty")).otherwise(fail("Size")), of)


def _first_tie(q) -> list[Column]:
    """Struct fields that make the first of a list the least among ties."""
    if q.order_by and len(q.order_by) == 1 and q.order_by[0][1]:
        return [F.col(q.order_by[0][0])]
    return []


def min_by(key, of) -> Aggregate:
    return Aggregate(lambda x, q: _some(F.min_by(x, F.struct(q._value(key).alias("k"), *(c.alias(f"o{i}") for i, c in enumerate(_first_tie(q)))))), of)


def max_by(key, of) -> Aggregate:
    return Aggregate(lambda x, q: _some(F.max_by(x, F.struct(q._value(key).alias("k"), *((-c).alias(f"o{i}") for i, c in enumerate(_first_tie(q)))))), of)


def elements(of) -> Aggregate:
    """The group's values as a collection: in list order for a list, sorted by value for a bag, where any order is as good."""

    def make(x: Column, q) -> Column:
        tie = _first_tie(q)
        if tie:
            return F.transform(F.array_sort(F.collect_list(F.struct(tie[0].alias("o"), x.alias("x")))), lambda s: s["x"])
        return F.array_sort(F.collect_list(x))

    return Aggregate(make, of)


def fold(of, start: Any, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Aggregate:
    """A user's aggregate: fold the collection of values."""
    gather = elements(of)
    return Aggregate(lambda _, q: F.aggregate(gather.over(q), F.lit(start) if not isinstance(start, Column) else start, step, finish) if finish else F.aggregate(gather.over(q), F.lit(start) if not isinstance(start, Column) else start, step))


def user(of, f: Callable[[Column], Column]) -> Aggregate:
    """Any function of a collection, as an aggregate."""
    gather = elements(of)
    return Aggregate(lambda _, q: f(gather.over(q)))
