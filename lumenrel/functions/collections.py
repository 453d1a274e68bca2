"""List, Bag, Vector, ListPair and Relational functions on nested collections (array columns)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenrel.plans.errors import fail, guarded

LESS, EQUAL, GREATER = -1, 0, 1
MAX_LENGTH = 2**24 - 1


def order_of(a: Column, b: Column) -> Column:
    """LESS, EQUAL or GREATER as -1, 0, 1, by the natural order of any comparable values."""
    return F.when(a < b, LESS).when(a == b, EQUAL).otherwise(GREATER)


def at(c: Column, i: Column) -> Column:
    return guarded((i >= 0) & (i < F.size(c)), F.try_element_at(c, i.cast("int") + 1), "Subscript")


def rest(c: Column, n: Column) -> Column:
    return F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))


def take(c: Column, n: Column) -> Column:
    return guarded((n >= 0) & (n <= F.size(c)), F.slice(c, F.lit(1), F.greatest(n, F.lit(0))), "Subscript")


def drop(c: Column, n: Column) -> Column:
    n = n.cast("int")
    return guarded((n >= 0) & (n <= F.size(c)), rest(c, F.greatest(n, F.lit(0))), "Subscript")


def head(c: Column) -> Column:
    return guarded(F.size(c) > 0, F.try_element_at(c, F.lit(1)), "Empty")


def tail(c: Column) -> Column:
    return guarded(F.size(c) > 0, rest(c, F.lit(1)), "Empty")


def only(c: Column) -> Column:
    return F.when(F.size(c) == 1, F.try_element_at(c, F.lit(1))).when(F.size(c) == 0, fail("Empty")).otherwise(fail("Size"))


def get_item(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.struct(F.try_element_at(c, F.lit(1)).alias("_1"), rest(c, F.lit(1)).alias("_2")))


def find(f: Callable, c: Column) -> Column:
    return F.try_element_at(F.filter(c, f), F.lit(1))


def partition(f: Callable, c: Column) -> Column:
    return F.struct(F.filter(c, f).alias("_1"), F.filter(c, lambda x: ~f(x)).alias("_2"))


def map_partial(f: Callable, c: Column) -> Column:
    return F.filter(F.transform(c, f), lambda x: x.isNotNull())


def tabulate(n: Column, f: Callable) -> Column:
    n = n.cast("int")
    return F.when(n < 0, fail("Size")).when(n == 0, F.filter(F.transform(F.sequence(F.lit(0), F.lit(0)), f), lambda _: F.lit(False))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), f))


def fold_left(f: Callable, start: Column, c: Column) -> Column:
    return F.aggregate(c, start, lambda acc, x: f(x, acc))


def fold_right(f: Callable, start: Column, c: Column) -> Column:
    return F.aggregate(F.reverse(c), start, lambda acc, x: f(x, acc))


def indexed(c: Column) -> Column:
    return F.transform(c, lambda x, i: F.struct(i.alias("i"), x.alias("x")))


def collate(f: Callable, a: Column, b: Column) -> Column:
    """The first unequal comparison, else the order of the sizes."""
    pairs = zipped(a, b)
    orders = F.filter(F.transform(pairs, lambda p: f(p["_1"], p["_2"])), lambda o: o != EQUAL)
    return F.coalesce(F.try_element_at(orders, F.lit(1)), order_of(F.size(a), F.size(b)))


def zipped(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("_1"), y.alias("_2")))


def equal_sizes(a: Column, b: Column, value: Column) -> Column:
    return guarded(F.size(a) == F.size(b), value, "UnequalLengths")


def _rank_among_equals(c: Column) -> Column:
    return F.transform(c, lambda x, i: F.struct(x.alias("x"), F.size(F.filter(F.slice(c, F.lit(1), i + 1), lambda y: y.eqNullSafe(x))).alias("k")))


def multiset(a: Column, b: Column, keep_common: bool) -> Column:
    """Intersection or difference with multiplicities, in the order of a."""
    def times(x: Column) -> Column:
        return F.size(F.filter(b, lambda y: y.eqNullSafe(x)))
    chosen = F.filter(_rank_among_equals(a), lambda s: s["k"] <= times(s["x"]) if keep_common else s["k"] > times(s["x"]))
    return F.transform(chosen, lambda s: s["x"])


def _fold_all(op: Callable, lists: Column) -> Column:
    return F.aggregate(rest(lists, F.lit(1)), F.try_element_at(lists, F.lit(1)), op)


def extreme(c: Column, largest: bool) -> Column:
    return guarded(F.size(c) > 0, F.array_max(c) if largest else F.array_min(c), "Empty")


def extreme_by(f: Callable, c: Column, largest: bool) -> Column:
    keyed = F.transform(c, lambda x, i: F.struct(f(x).alias("k"), (-i if largest else i).alias("i"), x.alias("x")))
    return guarded(F.size(c) > 0, (F.array_max(keyed) if largest else F.array_min(keyed))["x"], "Empty")


def total(c: Column, zero: Column | None = None) -> Column:
    return F.aggregate(c, zero if zero is not None else F.lit(0), lambda a, x: (a + x).cast("int") if zero is None else a + x)


_COMMON = {
    "all": lambda f, c: F.forall(c, f),
    "app": lambda f, c: F.size(F.transform(c, f)) * 0,
    "@": lambda a, b: F.concat(a, b),
    "concat": lambda c: F.flatten(c),
    "drop": drop,
    "exists": lambda f, c: F.exists(c, f),
    "filter": lambda f, c: F.filter(c, f),
    "find": find,
    "getItem": get_item,
    "hd": head,
    "length": F.size,
    "map": lambda f, c: F.transform(c, f),
    "mapPartial": map_partial,
    "nil": lambda kind: F.array().cast(f"array<{kind}>"),
    "nth": at,
    "null": lambda c: F.size(c) == 0,
    "only": only,
    "partition": partition,
    "tabulate": tabulate,
    "take": take,
    "tl": tail,
}

STRUCTURES = {
    "Bag": _COMMON | {"fold": fold_left, "fromList": lambda c: c, "toList": lambda c: c},
    "List": _COMMON
    | {
        "collate": collate,
        "except": lambda lists: _fold_all(lambda a, b: multiset(a, b, False), lists),
        "foldl": fold_left,
        "foldr": fold_right,
        "intersect": lambda lists: _fold_all(lambda a, b: multiset(a, b, True), lists),
        "last": lambda c: guarded(F.size(c) > 0, F.try_element_at(c, F.lit(-1)), "Empty"),
        "mapi": lambda f, c: F.transform(c, lambda x, i: f(i, x)),
        "rev": F.reverse,
        "revAppend": lambda a, b: F.concat(F.reverse(a), b),
        "::": lambda x, c: F.concat(F.array(x), c),
        "elem": lambda x, c: F.array_contains(c, x),
        "notelem": lambda x, c: ~F.array_contains(c, x),
    },
    "Vector": {k: _COMMON[k] for k in ("all", "app", "concat", "exists", "find", "length", "map", "tabulate")}
    | {
        "appi": lambda f, c: F.size(F.transform(c, lambda x, i: f(i, x))) * 0,
        "collate": collate,
        "findi": lambda f, c: F.try_element_at(F.filter(indexed(c), lambda s: f(s["i"], s["x"])), F.lit(1)),
        "foldl": fold_left,
        "foldli": lambda f, start, c: F.aggregate(indexed(c), start, lambda acc, s: f(s["i"], s["x"], acc)),
        "foldr": fold_right,
        "foldri": lambda f, start, c: F.aggregate(F.reverse(indexed(c)), start, lambda acc, s: f(s["i"], s["x"], acc)),
        "fromList": lambda c: c,
        "mapi": lambda f, c: F.transform(c, lambda x, i: f(i, x)),
        "maxLen": lambda: F.lit(MAX_LENGTH),
        "sub": at,
        "update": lambda c, i, x: guarded((i >= 0) & (i < F.size(c)), F.transform(c, lambda y, k: F.when(k == i, x).otherwise(y)), "Subscript"),
    },
    "ListPair": {
        "all": lambda f, a, b: F.forall(zipped(a, b), lambda p: f(p["_1"], p["_2"])),
        "allEq": lambda f, a, b: (F.size(a) == F.size(b)) & F.forall(zipped(a, b), lambda p: f(p["_1"], p["_2"])),
        "app": lambda f, a, b: F.size(F.transform(zipped(a, b), lambda p: f(p["_1"], p["_2"]))) * 0,
        "appEq": lambda f, a, b: equal_sizes(a, b, F.size(F.transform(zipped(a, b), lambda p: f(p["_1"], p["_2"]))) * 0),
        "exists": lambda f, a, b: F.exists(zipped(a, b), lambda p: f(p["_1"], p["_2"])),
        "foldl": lambda f, start, a, b: F.aggregate(zipped(a, b), start, lambda acc, p: f(p["_1"], p["_2"], acc)),
        "foldlEq": lambda f, start, a, b: equal_sizes(a, b, F.aggregate(zipped(a, b), start, lambda acc, p: f(p["_1"], p["_2"], acc))),
        "foldr": lambda f, start, a, b: F.aggregate(F.reverse(zipped(a, b)), start, lambda acc, p: f(p["_1"], p["_2"], acc)),
        "foldrEq": lambda f, start, a, b: equal_sizes(a, b, F.aggregate(F.reverse(zipped(a, b)), start, lambda acc, p: f(p["_1"], p["_2"], acc))),
        "map": lambda f, a, b: F.transform(zipped(a, b), lambda p: f(p["_1"], p["_2"])),
        "mapEq": lambda f, a, b: equal_sizes(a, b, F.transform(zipped(a, b), lambda p: f(p["_1"], p["_2"]))),
        "unzip": lambda c: F.struct(F.transform(c, lambda p: p["_1"]).alias("_1"), F.transform(c, lambda p: p["_2"]).alias("_2")),
        "zip": zipped,
        "zipEq": lambda a, b: equal_sizes(a, b, zipped(a, b)),
    },
    "Relational": {
        "compare": order_of,
        "count": F.size,
        "empty": lambda c: F.size(c) == 0,
        "max": lambda c: extreme(c, True),
        "maxBy": lambda f, c: extreme_by(f, c, True),
        "min": lambda c: extreme(c, False),
        "minBy": lambda f, c: extreme_by(f, c, False),
        "nonEmpty": lambda c: F.size(c) > 0,
        "only": only,
        "sum": total,
    },
}
