"""String, StringCvt and Char functions. A char is a one-character string; predicates on chars work on such columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenrel.functions.collections import collate, order_of
from lumenrel.functions.scalars import _COMPARE
from lumenrel.plans.errors import fail, guarded


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def substring(s: Column, start: Column, n: Column) -> Column:
    ok = (start >= 0) & (n >= 0) & (start + n <= F.length(s))
    return guarded(ok, F.substring(s, start + 1, n), "Subscript")


def extract(s: Column, start: Column, n: Column | None = None) -> Column:
    if n is None:
        return guarded((start >= 0) & (start <= F.length(s)), F.substring(s, start + 1, F.length(s)), "Subscript")
    return substring(s, start, n)


def split_where(is_cut: Callable[[Column], Column], s: Column) -> Column:
    """The fields of s between characters that meet is_cut."""
    start = F.array(F.lit(""))
    def step(acc: Column, ch: Column) -> Column:
        kept = F.slice(acc, F.lit(1), F.size(acc) - 1)
        last = F.element_at(acc, F.lit(-1))
        return F.when(is_cut(ch), F.concat(acc, F.array(F.lit("")))).otherwise(F.concat(kept, F.array(F.concat(last, ch))))
    return F.aggregate(chars(s), start, step)


def _class(pattern: str) -> Callable[[Column], Column]:
    return lambda c: c.rlike(f"^{pattern}$")


def padded(left: bool) -> Callable[[Column, int, Column], Column]:
    def pad(ch: Column, n: int, s: Column) -> Column:
        more = F.repeat(ch, F.greatest(F.lit(n) - F.length(s), F.lit(0)))
        return F.concat(more, s) if left else F.concat(s, more)
    return pad


#: Escapes of the two text forms.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\x07": "\\a", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\x0b": "\\v", "\f": "\\f", "\r": "\\r"}
_C_ESCAPES = _ESCAPES | {"'": "\\'", "?": "\\?"}


def escaped(table: dict[str, str], octal: bool) -> Callable[[Column], Column]:
    def one(ch: Column) -> Column:
        code = F.ascii(ch)
        out = F.when(ch == F.lit(next(iter(table))), F.lit(table[next(iter(table))]))
        for k, v in list(table.items())[1:]:
            out = out.when(ch == F.lit(k), F.lit(v))
        number = F.concat(F.lit("\\"), F.lpad(F.conv(code.cast("string"), 10, 8) if octal else code.cast("string"), 3, "0"))
        control = F.concat(F.lit("\\^"), F.char(code + 64))
        return out.when(code < 32, number if octal else control).when(code >= 127, number).otherwise(ch)
    return lambda s: F.array_join(F.transform(chars(s), one), "")


def unescaped(table: dict[str, str]) -> Callable[[Column], Column]:
    """The value of an escaped text; none if an escape is unknown."""
    def parse(s: Column) -> Column:
        out = F.regexp_replace(s, r"\\\\", "\x01")
        for k, v in table.items():
            if k != "\\":
                out = F.replace(out, F.lit(v), F.lit(k))
        return F.when(~out.contains("\\"), F.replace(out, F.lit("\x01"), F.lit("\\")))
    return parse


def code(c: Column) -> Column:
    return F.ascii(c)


def char_of(i: Column) -> Column:
    return guarded((i >= 0) & (i <= 255), F.char(i), "Chr")


def prefix(f: Callable[[Column], Column], s: Column) -> Column:
    """The number of leading characters that meet f."""
    bad = F.array_position(F.transform(chars(s), lambda c: ~f(c)), F.lit(True))
    return F.when(bad == 0, F.length(s)).otherwise(bad - 1).cast("int")


STRUCTURES = {
    "String": _COMPARE
    | {
        "^": lambda a, b: F.concat(a, b), "collate": lambda f, a, b: collate(f, chars(a), chars(b)), "compare": order_of, "concat": lambda c: F.array_join(c, ""), "concatWith": lambda sep, c: F.concat_ws("", F.slice(c, 1, 1), F.flatten(F.transform(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda x: F.array(sep, x)))),
        "explode": chars, "extract": extract, "fields": split_where, "fromCString": unescaped(_C_ESCAPES), "fromString": unescaped(_ESCAPES), "implode": lambda c: F.array_join(c, ""),
        "isPrefix": lambda p, s: F.startswith(s, p), "isSubstring": lambda p, s: F.contains(s, p), "isSuffix": lambda p, s: F.endswith(s, p),
        "map": lambda f, s: F.array_join(F.transform(chars(s), f), ""), "maxSize": lambda: F.lit(2**31 - 1), "size": F.length, "str": lambda c: c,
        "sub": lambda s, i: guarded((i >= 0) & (i < F.length(s)), F.substring(s, i + 1, F.lit(1)), "Subscript"), "substring": substring,
        "toCString": escaped(_C_ESCAPES, True), "toString": escaped(_ESCAPES, False), "tokens": lambda f, s: F.filter(split_where(f, s), lambda x: x != ""), "translate": lambda f, s: F.array_join(F.transform(chars(s), f), ""),
    },
    "StringCvt": {
        "padLeft": padded(True), "padRight": padded(False), "BIN": lambda: "BIN", "OCT": lambda: "OCT", "DEC": lambda: "DEC", "HEX": lambda: "HEX",
        "EXACT": lambda: ("EXACT", None), "FIX": lambda n=None: ("FIX", n), "GEN": lambda n=None: ("GEN", n), "SCI": lambda n=None: ("SCI", n),
        "skipWS": lambda s: F.regexp_replace(s, r"^\s+", ""), "dropl": lambda f, s: F.substring(s, prefix(f, s) + 1, F.length(s)), "takel": lambda f, s: F.substring(s, F.lit(1), prefix(f, s)),
        "splitl": lambda f, s: F.struct(F.substring(s, F.lit(1), prefix(f, s)).alias("_1"), F.substring(s, prefix(f, s) + 1, F.length(s)).alias("_2")),
        "scanString": lambda f, s: f(s),
    },
    "Char": _COMPARE
    | {
        "chr": char_of, "compare": lambda a, b: order_of(code(a), code(b)), "contains": lambda s, c: F.contains(s, c), "notContains": lambda s, c: ~F.contains(s, c), "fromInt": lambda i: F.when((i >= 0) & (i <= 255), F.char(i)),
        "fromString": lambda s: F.when(F.length(s) > 0, F.substring(unescaped(_ESCAPES)(s), 1, 1)), "fromCString": lambda s: F.when(F.length(s) > 0, F.substring(unescaped(_C_ESCAPES)(s), 1, 1)),
        "isAlpha": _class("[A-Za-z]"), "isAlphaNum": _class("[A-Za-z0-9]"), "isAscii": _class(r"[\x00-\x7f]"), "isCntrl": _class(r"[\x00-\x1f\x7f]"), "isDigit": _class("[0-9]"), "isGraph": _class("[!-~]"), "isHexDigit": _class("[0-9A-Fa-f]"),
        "isLower": _class("[a-z]"), "isOctDigit": _class("[0-7]"), "isPrint": _class("[ -~]"), "isPunct": _class(r"\p{Punct}"), "isSpace": _class(r"[ \t\n\x0b\f\r]"), "isUpper": _class("[A-Z]"),
        "maxChar": lambda: F.char(F.lit(255)), "maxOrd": lambda: F.lit(255), "minChar": lambda: F.char(F.lit(0)), "ord": code,
        "pred": lambda c: guarded(code(c) > 0, F.char(code(c) - 1), "Chr"), "succ": lambda c: guarded(code(c) < 255, F.char(code(c) + 1), "Chr"),
        "toCString": escaped(_C_ESCAPES, True), "toString": escaped(_ESCAPES, False), "toLower": F.lower, "toUpper": F.upper,
    },
}
