"""Range sets, scanners, top-level operators, and the structures of the driver: Datalog, Sys, Interact, Test and PP."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenrel.functions import collections, scalars, text, values
from lumenrel.operators import datalog
from lumenrel.operators.fixpoint import iterate
from lumenrel.plans import errors, pretty
from lumenrel.plans.query import Desc
from lumenrel.plans.settings import Sys


# Sets of ranges: arrays of range structs, ascending and disjoint.

def _bounds(r: Column) -> Column:
    """A struct that sorts by lower bound, unbounded and inclusive first."""
    return F.struct(r["lo"].isNotNull().alias("b"), r["lo"].alias("l"), (~r["lo_incl"]).alias("e"), r.alias("r"))


def _kind(r: Column) -> Column:
    low, high = r["lo"].isNotNull(), r["hi"].isNotNull()
    name = (
        F.when(~low & ~high, "ALL").when(~high, F.when(r["lo_incl"], "AT_LEAST").otherwise("GREATER_THAN")).when(~low, F.when(r["hi_incl"], "AT_MOST").otherwise("LESS_THAN"))
        .when(r["lo"] == r["hi"], "POINT").when(r["lo_incl"] & r["hi_incl"], "CLOSED").when(r["lo_incl"], "CLOSED_OPEN").when(r["hi_incl"], "OPEN_CLOSED").otherwise("OPEN")
    )
    return F.struct(name.alias("kind"), r["lo"].alias("lo"), r["lo_incl"].alias("lo_incl"), r["hi"].alias("hi"), r["hi_incl"].alias("hi_incl"))


def _range(lo: Column, lo_incl: Column, hi: Column, hi_incl: Column) -> Column:
    return F.struct(F.lit("").alias("kind"), lo.alias("lo"), F.coalesce(lo_incl, F.lit(False)).alias("lo_incl"), hi.alias("hi"), F.coalesce(hi_incl, F.lit(False)).alias("hi_incl"))


def _some(r: Column) -> Column:
    return r["lo"].isNull() | r["hi"].isNull() | (r["lo"] < r["hi"]) | ((r["lo"] == r["hi"]) & r["lo_incl"] & r["hi_incl"])


def _merged(c: Column, touch: Callable[[Column, Column], Column]) -> Column:
    ordered = F.transform(F.array_sort(F.transform(F.filter(c, _some), _bounds)), lambda s: s["r"])
    plain = F.transform(ordered, lambda r: _range(r["lo"], r["lo_incl"], r["hi"], r["hi_incl"]))

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, F.lit(-1))
        further = r["hi"].isNull() | (last["hi"].isNotNull() & ((r["hi"] > last["hi"]) | ((r["hi"] == last["hi"]) & r["hi_incl"])))
        grown = _range(last["lo"], last["lo_incl"], F.when(~further, last["hi"]).otherwise(r["hi"]), F.when(~further, last["hi_incl"]).otherwise(r["hi_incl"]))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))
        return F.when(last["hi"].isNull() | touch(last, r), joined).otherwise(F.concat(acc, F.array(r)))

    whole = F.aggregate(F.slice(plain, F.lit(2), F.greatest(F.size(plain) - 1, F.lit(0))), F.slice(plain, 1, 1), step)
    return F.transform(whole, _kind)


def continuous_set(c: Column) -> Column:
    """Overlapping and touching ranges made one."""
    return _merged(c, lambda a, b: b["lo"].isNull() | (b["lo"] < a["hi"]) | ((b["lo"] == a["hi"]) & (b["lo_incl"] | a["hi_incl"])))


def discrete_set(c: Column) -> Column:
    """Ranges of ints with closed bounds; overlapping and adjacent ones made one."""
    closed = F.transform(c, lambda r: _range(F.when(r["lo_incl"], r["lo"]).otherwise(r["lo"] + 1), r["lo"].isNotNull(), F.when(r["hi_incl"], r["hi"]).otherwise(r["hi"] - 1), r["hi"].isNotNull()))
    return _merged(closed, lambda a, b: b["lo"].isNull() | (b["lo"] <= a["hi"] + 1))


def complement(c: Column) -> Column:
    """The gaps of a continuous set."""
    none = F.lit(None)
    n = F.size(c)
    before = F.filter(F.slice(c, 1, 1), lambda r: r["lo"].isNotNull())
    first = F.transform(before, lambda r: _range(F.nullif(r["lo"], r["lo"]), F.lit(False), r["lo"], ~r["lo_incl"]))
    inner = F.zip_with(F.slice(c, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: _range(a["hi"], ~a["hi_incl"], b["lo"], ~b["lo_incl"]))
    after = F.filter(F.slice(F.reverse(c), 1, 1), lambda r: r["hi"].isNotNull())
    last = F.transform(after, lambda r: _range(r["hi"], ~r["hi_incl"], F.nullif(r["hi"], r["hi"]), F.lit(False)))
    gaps = F.transform(F.concat(first, inner, last), _kind)
    return F.when(n > 0, gaps).otherwise(F.array(values.range_of("ALL", none.cast("int"), False, none.cast("int"), False)))


def _scanner(pattern: str, read: Callable[[Column], Column], skip: str = r"\s*") -> Callable[[Column], Column]:
    """From a text to an option of (value, rest): the longest prefix, after what is skipped (white space), that reads as a value."""
    def run(s: Column) -> Column:
        found = F.regexp_extract(s, rf"^({skip}(?:{pattern}))", 1)
        value = read(F.ltrim(found) if skip else found)
        return F.when((found != "") & value.isNotNull(), F.struct(value.alias("_1"), F.substring(s, F.length(found) + 1, F.length(s)).alias("_2")))
    return run


def real_format(form: tuple[str, int | None], r: Column) -> Column:
    """SCI, FIX or GEN with a number of digits, or EXACT."""
    kind, digits = form
    if digits is not None and digits < 0:
        raise errors.Size
    if kind == "FIX":
        made = F.format_string(f"%.{6 if digits is None else digits}f", r.cast("double"))
    elif kind == "SCI":
        made = F.regexp_replace(F.upper(F.format_string(f"%.{6 if digits is None else digits}e", r.cast("double"))), r"E\+?(-?)0*(\d)", "E$1$2")
    else:
        return scalars.real_text(r)
    return F.translate(made, "-", "~")


S = scalars.STRUCTURES
ANY = {"=": lambda a, b: a.eqNullSafe(b), "<>": lambda a, b: ~a.eqNullSafe(b), "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_vector = {"vector": lambda c: c, "bag": lambda c: c}


def use(session, path: str):
    """Run a script in a session."""
    with open(path) as f:
        return session.run(f.read())


STRUCTURES = {
    "Range": {"continuousSetOf": continuous_set, "discreteSetOf": discrete_set, "complement": complement},
    "Relational": {"DESC": Desc, "iterate": iterate},
    "Top-level": {f"op {k}": f for k, f in ANY.items()}
    | ANY
    | _vector
    | {
        "true": lambda: F.lit(True), "false": lambda: F.lit(False), "INL": values.STRUCTURES["Either"]["INL"], "INR": values.STRUCTURES["Either"]["INR"], "abs": F.abs, "op div": scalars.floor_div, "op mod": scalars.floor_mod, "op /": scalars.divide, "op +": lambda a, b: a + b, "op -": lambda a, b: a - b,
        "op *": lambda a, b: a * b, "op ~": lambda a: -a, "op ::": collections.STRUCTURES["List"]["::"], "op elem": collections.STRUCTURES["List"]["elem"], "op notelem": collections.STRUCTURES["List"]["notelem"], "real": lambda i: i.cast("float"),
        "sum$int": collections.total, "sum$real": lambda c: collections.total(c, F.lit(0.0)), "sum$decimal": lambda c: collections.total(c, F.lit(0).cast("decimal(38,10)")), "$csContains": values.STRUCTURES["Range"]["setContains"], "$dsContains": values.STRUCTURES["Range"]["setContains"],
        "$dsComplement": lambda c: discrete_set(complement(c)), "$dsRanges": lambda c: c, "$check": lambda ok, v, name: errors.guarded(ok, v, name), "$attempt": lambda ok, v: F.when(ok, v), "$require": lambda ok, name: errors.guarded(ok, F.lit(True), name),
    },
    "Int": {"scan": _scanner(r"[~+-]?[0-9]+", scalars.int_parse)},
    "Word": {"scan": _scanner(r"(?:0w)?x?[0-9A-Fa-f]+", S["Word"]["fromString"])},
    "Real": {"scan": _scanner(r"[~+-]?[0-9]*\.?[0-9]+(?:[eE][~+-]?[0-9]+)?", S["Real"]["fromString"]), "fmt": real_format},
    "Bool": {"scan": _scanner(r"(?i:true|false)", S["Bool"]["fromString"])},
    "Char": {"scan": _scanner(r"\\.|[^\\]", text.STRUCTURES["Char"]["fromString"], skip="")},
    "String": {"scan": _scanner(r"(?:\\.|[^\\])+", text.STRUCTURES["String"]["fromString"], skip="")},
    "Time": {"scan": _scanner(r"[~+-]?[0-9]*\.?[0-9]+", values.STRUCTURES["Time"]["fromString"])},
    "Date": {"scan": _scanner(r"[A-Z][a-z]{2} [A-Z][a-z]{2} \d\d \d\d:\d\d:\d\d \d{4}", values.STRUCTURES["Date"]["fromString"])},
    "Decimal": {"maxFinite": lambda: F.lit("9" * 28 + "." + "9" * 10).cast("decimal(38,10)"), "minPos": lambda: F.lit("0.0000000001").cast("decimal(38,10)")},
    "Datalog": {"execute": datalog.execute, "validate": datalog.validate, "translate": lambda source: None if datalog.validate(source) else repr(datalog.parse(source))},
    "Sys": {"clearEnv": Sys.clear_env, "env": Sys.env, "plan": Sys.plan, "planEx": lambda q, phase=None: q.frame()._jdf.queryExecution().toString(), "planOf": lambda q: q.frame()._jdf.queryExecution().analyzed().toString(), "set": Sys.set, "show": Sys.show, "showAll": Sys.show_all, "unset": Sys.unset},
    "Interact": {"use": use, "useSilently": lambda session, path: use(session, path) and None},
    "Test": {"bagSum": collections.total, "listSum": collections.total, "overSum": collections.total, "overCount": F.size, "foo": lambda i: i + 1, "highlight": lambda s: s},
    "PP": pretty.STRUCTURE,
    "Exceptions": {n: getattr(errors, n) for n in errors.NAMES},
}
