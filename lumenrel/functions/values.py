"""Option, Either, Range, Date, Time and Variant functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenrel.functions.collections import MAX_LENGTH, order_of
from lumenrel.functions.scalars import _COMPARE
from lumenrel.plans.errors import fail, guarded


def either(tag: str, left: Column, right: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), left.alias("left"), right.alias("right"))


def is_left(e: Column) -> Column:
    return e["tag"] == "INL"


def _either_map(f: Callable, g: Callable) -> Callable[[Column], Column]:
    def run(e: Column) -> Column:
        left = F.when(is_left(e), f(e["left"]))
        return F.struct(e["tag"].alias("tag"), left.alias("left"), F.when(~is_left(e), g(e["right"])).alias("right"))
    return run


def range_of(kind: str, low=None, low_in: bool = False, high=None, high_in: bool = False) -> Column:
    as_column = lambda x: F.lit(None) if x is None else x if isinstance(x, Column) else F.lit(x)
    low, high = as_column(low), as_column(high)
    return F.struct(F.lit(kind).alias("kind"), low.alias("lo"), F.lit(low_in).alias("lo_incl"), high.alias("hi"), F.lit(high_in).alias("hi_incl"))


def contains(r: Column, x: Column) -> Column:
    above = r["lo"].isNull() | (x > r["lo"]) | (r["lo_incl"] & (x == r["lo"]))
    below = r["hi"].isNull() | (x < r["hi"]) | (r["hi_incl"] & (x == r["hi"]))
    return above & below


def members(r: Column) -> Column:
    """The ints of a range; Size if it has no end or too many."""
    low = F.when(r["lo_incl"], r["lo"]).otherwise(r["lo"] + 1).cast("long")
    high = F.when(r["hi_incl"], r["hi"]).otherwise(r["hi"] - 1).cast("long")
    none = F.filter(F.sequence(F.lit(0), F.lit(0)), lambda _: F.lit(False))
    few = F.transform(F.sequence(low, high), lambda x: x.cast("int"))
    return F.when(r["lo"].isNull() | r["hi"].isNull(), fail("Size")).when(high < low, none).when(high - low >= MAX_LENGTH, fail("Size")).otherwise(few)


_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _named(names: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), number)


def date(ts: Column, offset: Column | None = None) -> Column:
    """A date: a timestamp of local time and its offset west of UTC in seconds."""
    return F.struct(ts.alias("ts"), (F.lit(0) if offset is None else offset).cast("int").alias("offset"))


#: Strftime letters and the patterns they stand for.
_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "%": "%"}


def date_format(pattern: str, d: Column) -> Column:
    parts, i, plain = [], 0, ""
    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern) and pattern[i + 1] in _STRFTIME:
            if plain:
                parts.append(F.lit(plain))
            plain = ""
            parts.append(F.lit("%") if pattern[i + 1] == "%" else F.date_format(d["ts"], _STRFTIME[pattern[i + 1]]))
            i += 2
        else:
            plain, i = plain + pattern[i], i + 1
    return F.concat(*parts, F.lit(plain))


def parsed_date(s: Column) -> Column:
    """The date of a text as toString writes it; the day of the week is not looked at (Spark's parser knows none)."""
    ts = F.try_to_timestamp(F.substring(F.ltrim(s), 5, 64), F.lit("MMM dd HH:mm:ss yyyy"))
    return F.when(ts.isNotNull(), date(ts))


NANOS = {"Nanoseconds": 1, "Microseconds": 10**3, "Milliseconds": 10**6, "Seconds": 10**9}


def _floor_to(n: int) -> Callable[[Column], Column]:
    return lambda t: F.floor(t.cast("decimal(20,0)") / F.lit(n)).cast("long")


def time_text(digits: int, t: Column) -> Column:
    return F.translate(F.bround(t.cast("decimal(28,9)") / F.lit(10**9), digits).cast(f"decimal(30,{digits})").cast("string"), "-", "~")


def variant(tag: str) -> Callable[[Column], Column]:
    return lambda x: F.to_variant_object(F.struct(F.lit(tag).alias("tag"), x.alias("value")))


STRUCTURES = {
    "Option": {
        "app": lambda f, o: F.when(o.isNotNull(), f(o)), "compose": lambda f, g: lambda x: F.when(g(x).isNotNull(), f(g(x))), "composePartial": lambda f, g: lambda x: F.when(g(x).isNotNull(), f(g(x))),
        "filter": lambda f, x: F.when(f(x), x), "getOpt": lambda o, x: F.coalesce(o, x), "isSome": lambda o: o.isNotNull(), "join": lambda o: o, "map": lambda f, o: F.when(o.isNotNull(), f(o)), "mapPartial": lambda f, o: F.when(o.isNotNull(), f(o)),
        "NONE": lambda kind="int": F.lit(None).cast(kind), "SOME": lambda x: x, "valOf": lambda o: guarded(o.isNotNull(), o, "Option"),
    },
    "Either": {
        "INL": lambda x, other="int": either("INL", x, F.lit(None).cast(other)), "INR": lambda x, other="int": either("INR", F.lit(None).cast(other), x), "asLeft": lambda e: F.when(is_left(e), e["left"]), "asRight": lambda e: F.when(~is_left(e), e["right"]),
        "isLeft": is_left, "isRight": lambda e: ~is_left(e), "proj": lambda e: F.when(is_left(e), e["left"]).otherwise(e["right"]), "fold": lambda f, g: lambda start, e: F.when(is_left(e), f(e["left"], start)).otherwise(g(e["right"], start)),
        "map": _either_map, "mapLeft": lambda f: _either_map(f, lambda x: x), "mapRight": lambda g: _either_map(lambda x: x, g), "app": _either_map, "appLeft": lambda f: _either_map(f, lambda x: x), "appRight": lambda g: _either_map(lambda x: x, g),
        "partition": lambda c: F.struct(F.transform(F.filter(c, is_left), lambda e: e["left"]).alias("_1"), F.transform(F.filter(c, lambda e: ~is_left(e)), lambda e: e["right"]).alias("_2")),
    },
    "Range": {
        "ALL": lambda: range_of("ALL"), "AT_LEAST": lambda x: range_of("AT_LEAST", x, True), "AT_MOST": lambda x: range_of("AT_MOST", None, False, x, True), "GREATER_THAN": lambda x: range_of("GREATER_THAN", x), "LESS_THAN": lambda x: range_of("LESS_THAN", None, False, x),
        "CLOSED": lambda a, b: range_of("CLOSED", a, True, b, True), "CLOSED_OPEN": lambda a, b: range_of("CLOSED_OPEN", a, True, b, False), "OPEN": lambda a, b: range_of("OPEN", a, False, b, False), "OPEN_CLOSED": lambda a, b: range_of("OPEN_CLOSED", a, False, b, True), "POINT": lambda x: range_of("POINT", x, True, x, True),
        "contains": contains, "flatten": lambda c: F.flatten(F.transform(c, members)), "toList": lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform(c, members)))), "toBag": lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform(c, members)))),
        "CONTINUOUS_SET": lambda c: c, "DISCRETE_SET": lambda c: c, "ranges": lambda c: c, "setContains": lambda c, x: F.exists(c, lambda r: contains(r, x)),
    },
    "Date": {
        "compare": lambda a, b: order_of(a["ts"], b["ts"]), "date": lambda year, month, day, hour, minute, second: date(F.make_timestamp(year, month, day, hour, minute, second)), "day": lambda d: F.dayofmonth(d["ts"]), "hour": lambda d: F.hour(d["ts"]), "minute": lambda d: F.minute(d["ts"]), "second": lambda d: F.second(d["ts"]),
        "year": lambda d: F.year(d["ts"]), "yearDay": lambda d: F.dayofyear(d["ts"]) - 1, "month": lambda d: _named(_MONTHS, F.month(d["ts"])), "weekDay": lambda d: _named(_DAYS, F.weekday(d["ts"]) + 1), "isDst": lambda d: F.lit(None).cast("boolean"), "fmt": date_format,
        "fromString": parsed_date, "toString": lambda d: F.date_format(d["ts"], "EEE MMM dd HH:mm:ss yyyy"),
        "fromTimeUniv": lambda t: date(F.timestamp_micros(_floor_to(1000)(t))), "fromTimeLocal": lambda t: date(F.timestamp_micros(_floor_to(1000)(t))), "toTime": lambda d: (F.unix_micros(d["ts"]) + d["offset"] * 1_000_000) * 1000, "localOffset": lambda: F.lit(0).cast("long"),
    }
    | {m: (lambda m=m: F.lit(m)) for m in (*_MONTHS, *_DAYS)},
    "Time": _COMPARE
    | {f"from{k}": (lambda x, n=n: x.cast("long") * n) for k, n in NANOS.items()}
    | {f"to{k}": _floor_to(n) for k, n in NANOS.items()}
    | {
        "+": lambda a, b: a + b, "-": lambda a, b: a - b, "compare": order_of, "fmt": time_text, "fromReal": lambda r: guarded(~F.isnan(r) & (F.abs(r) < 9.2e9), F.rint(r * 1e9).cast("long"), "Time"), "toReal": lambda t: t / 1e9,
        "fromString": lambda s: F.rint(F.translate(s, "~", "-").try_cast("double") * 1e9).cast("long"), "now": lambda: F.unix_micros(F.current_timestamp()) * 1000, "toString": lambda t: time_text(3, t), "zeroTime": lambda: F.lit(0).cast("long"),
    },
    "Variant": {k: variant(k) for k in ("BAG", "BOOL", "CHAR", "CONSTANT", "INT", "LIST", "REAL", "RECORD", "STRING", "VECTOR")}
    | {"UNIT": lambda: F.parse_json(F.lit('{"tag":"UNIT"}')), "VARIANT_NONE": lambda: F.parse_json(F.lit('{"tag":"VARIANT_NONE"}')), "VARIANT_SOME": variant("VARIANT_SOME"), "CONSTRUCT": lambda name, x: F.to_variant_object(F.struct(F.lit("CONSTRUCT").alias("tag"), name.alias("name"), x.alias("value"))), "parse": F.parse_json, "print": F.to_json},
}
