"""Int, Word, Real, Math, Decimal, Bool, Order, General and Fn functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenrel.functions.collections import order_of
from lumenrel.plans.errors import fail, guarded

INF = float("inf")


def floor_div(a: Column, b: Column) -> Column:
    """Division towards minus infinity; ints are exact as doubles."""
    safe = F.when(b == 0, F.lit(None)).otherwise(b).cast("double")
    return F.when(b == 0, fail("Div")).otherwise(F.floor(a.cast("double") / safe)).cast("int")


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the sign of the divisor."""
    safe = F.when(b == 0, F.lit(None)).otherwise(b)
    return F.when(b == 0, fail("Div")).otherwise((a % safe + safe) % safe).cast("int")


def quot(a: Column, b: Column) -> Column:
    safe = F.when(b == 0, F.lit(None)).otherwise(b)
    r = a.cast("double") / safe
    return F.when(b == 0, fail("Div")).otherwise(F.when(r < 0, F.ceil(r)).otherwise(F.floor(r))).cast("int")


def rem(a: Column, b: Column) -> Column:
    safe = F.when(b == 0, F.lit(None)).otherwise(b)
    return F.when(b == 0, fail("Div")).otherwise(a % safe).cast("int")


def int_text(i: Column) -> Column:
    return F.when(i < 0, F.concat(F.lit("~"), (-i.cast("long")).cast("string"))).otherwise(i.cast("string"))


RADIX = {"BIN": 2, "OCT": 8, "DEC": 10, "HEX": 16}


def int_format(radix: str, i: Column) -> Column:
    digits = F.conv(F.abs(i.cast("long")).cast("string"), 10, RADIX[radix])
    return F.when(i < 0, F.concat(F.lit("~"), digits)).otherwise(digits)


def int_parse(s: Column) -> Column:
    found = F.regexp_extract(s, r"^\s*([~+-]?[0-9]+)", 1)
    return F.when(found != "", F.translate(found, "~", "-")).try_cast("int")


def whole(r: Column) -> Column:
    """A real as an int, or Overflow."""
    return guarded(~F.isnan(r) & (F.abs(r) <= 2147483648.0), r.cast("long").cast("int"), "Overflow")


def trunc(r: Column) -> Column:
    return F.when(r < 0, F.ceil(r)).otherwise(F.floor(r))


def ieee(op: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A comparison in which NaN is unordered."""
    return lambda a, b: ~F.isnan(a) & ~F.isnan(b) & op(a, b)


def divide(a: Column, b: Column) -> Column:
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when((a > 0) == ~sign_bit(b), F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, zero.cast("double")).otherwise(F.try_divide(a, b))


def sign_bit(r: Column) -> Column:
    return (r < 0) | (r.cast("string") == "-0.0")


def real_text(r: Column) -> Column:
    """With ~ for minus, and no fraction where there is none."""
    plain = F.regexp_replace(F.translate(r.cast("string"), "-", "~"), r"\.0$|\.0(?=E)", "")
    return F.when(F.isnan(r), "nan").when(r == INF, "inf").when(r == -INF, "~inf").otherwise(plain)


def nan_aware(pick: Callable[..., Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(pick(a, b))


def logarithm(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda r: F.when(r == 0, F.lit(-INF)).when((r < 0) | F.isnan(r), F.lit(float("nan"))).otherwise(f(r))


WORD = "decimal(38,0)"
MODULUS = 2**64


def word(x: Column) -> Column:
    """Any whole number as an unsigned 64-bit word, wrapping."""
    m = F.lit(str(MODULUS)).cast(WORD)
    return ((x.cast(WORD) % m + m) % m).cast("decimal(20,0)")


def bits(w: Column) -> Column:
    """A word's bits as a long."""
    w = w.cast("decimal(20,0)")
    return F.when(w >= F.lit(str(2**63)).cast("decimal(20,0)"), w - F.lit(str(MODULUS)).cast("decimal(21,0)")).otherwise(w).cast("decimal(20,0)").cast("long")


def _times(a: Column, b: Column) -> Column:
    """The product modulo 2^64, in halves that fit a decimal."""
    half = F.lit(str(2**32)).cast(WORD)
    a, b = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
    a_high, a_low = F.floor(a / half).cast(WORD), (a % half).cast(WORD)
    b_high, b_low = F.floor(b / half).cast(WORD), (b % half).cast(WORD)
    cross = ((a_high * b_low).cast(WORD) + (a_low * b_high).cast(WORD)) % half
    return word((cross * half).cast(WORD) + (a_low * b_low).cast(WORD))


def _shift(f: Callable[[Column, Column], Column], w: Column, n: Column, empty: int = 0) -> Column:
    return word(F.when(n >= 64, F.lit(empty).cast("long")).otherwise(f(bits(w), n)))


def _sql_shift(name: str) -> Callable[[Column, Column], Column]:
    return lambda w, n: F.call_function(name, w, n.cast("int"))


def _guard_zero(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(b == 0, fail("Div")).otherwise(f(a, F.when(b == 0, F.lit(None)).otherwise(b)))


_COMPARE = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "~": lambda a: -a}
same = lambda x: x


def repeat(n: int, f: Callable) -> Callable:
    def run(x):
        for _ in range(n):
            x = f(x)
        return x
    return run


STRUCTURES = {
    "Int": _COMPARE
    | _ARITHMETIC
    | {
        "abs": F.abs, "compare": order_of, "div": floor_div, "fmt": int_format, "fromInt": same, "fromLarge": same, "fromString": int_parse,
        "max": F.greatest, "min": F.least, "maxInt": lambda: F.lit(2**31 - 1), "minInt": lambda: F.lit(-(2**31)), "mod": floor_mod,
        "precision": lambda: F.lit(32), "quot": quot, "rem": rem, "sameSign": lambda a, b: F.signum(a) == F.signum(b), "sign": lambda a: F.signum(a).cast("int"),
        "toInt": same, "toLarge": same, "toString": int_text,
    },
    "Word": _COMPARE
    | {
        "andb": lambda a, b: word(bits(a).bitwiseAND(bits(b))), "orb": lambda a, b: word(bits(a).bitwiseOR(bits(b))), "xorb": lambda a, b: word(bits(a).bitwiseXOR(bits(b))), "notb": lambda a: word(F.bitwise_not(bits(a))),
        "compare": order_of, "div": _guard_zero(lambda a, b: F.floor(a / b).cast("decimal(20,0)")), "mod": _guard_zero(lambda a, b: (a % b).cast("decimal(20,0)")),
        "fmt": lambda radix, w: F.conv(w.cast("string"), 10, RADIX[radix]), "fromInt": word, "fromLarge": word, "fromLargeInt": word, "fromLargeWord": word,
        "fromString": lambda s: F.when(F.regexp_extract(s, r"^(0w)?x?([0-9A-Fa-f]+)", 2) != "", F.conv(F.regexp_extract(s, r"^(0w)?x?([0-9A-Fa-f]+)", 2), 16, 10)).try_cast("decimal(20,0)"),
        "max": F.greatest, "min": F.least, "+": lambda a, b: word(a.cast(WORD) + b.cast(WORD)), "-": lambda a, b: word(a.cast(WORD) - b.cast(WORD)), "*": _times, "~": lambda a: word(-a.cast(WORD)),
        "<<": lambda w, n: _shift(_sql_shift("shiftleft"), w, n), ">>": lambda w, n: _shift(_sql_shift("shiftrightunsigned"), w, n),
        "~>>": lambda w, n: word(_sql_shift("shiftright")(bits(w), F.least(n, F.lit(63)))),
        "toInt": lambda w: guarded(w <= 2147483647, w.try_cast("int"), "Overflow"), "toIntX": bits, "toLarge": same, "toLargeInt": same, "toLargeIntX": bits, "toLargeWord": same,
        "toLargeWordX": same, "toLargeX": same, "toString": lambda w: F.conv(w.cast("string"), 10, 16), "wordSize": lambda: F.lit(64),
    },
    "Real": {k: ieee(f) for k, f in _COMPARE.items() if k != "<>"}
    | _ARITHMETIC
    | {
        "<>": lambda a, b: F.isnan(a) | F.isnan(b) | (a != b), "/": divide, "abs": F.abs, "ceil": lambda r: whole(F.ceil(r).cast("double")), "floor": lambda r: whole(F.floor(r).cast("double")), "round": lambda r: whole(F.rint(r)), "trunc": lambda r: whole(trunc(r).cast("double")),
        "checkFloat": lambda r: F.when(F.isnan(r), fail("Div")).when(F.abs(r) == INF, fail("Overflow")).otherwise(r),
        "compare": lambda a, b: F.when(F.isnan(a) | F.isnan(b), fail("Unordered")).otherwise(order_of(a, b)),
        "copySign": lambda a, b: F.when(sign_bit(b), -F.abs(a)).otherwise(F.abs(a)), "fromInt": lambda i: i.cast("float"), "fromManExp": lambda r: r["man"] * F.pow(F.lit(2.0), r["exp"]),
        "fromString": lambda s: F.translate(F.regexp_extract(s, r"^\s*([~+-]?[0-9]*\.?[0-9]+([eE][~+-]?[0-9]+)?)", 1), "~", "-").try_cast("double"),
        "isFinite": lambda r: ~F.isnan(r) & (F.abs(r) < INF), "isNan": F.isnan, "isNormal": lambda r: ~F.isnan(r) & (F.abs(r) < INF) & (F.abs(r) >= 1.17549435e-38), "max": nan_aware(F.greatest), "min": nan_aware(F.least),
        "maxFinite": lambda: F.lit(3.4028234663852886e38).cast("float"), "minNormalPos": lambda: F.lit(1.17549435e-38).cast("float"), "minPos": lambda: F.lit(1.401298464324817e-45).cast("float"),
        "negInf": lambda: F.lit(-INF), "posInf": lambda: F.lit(INF), "precision": lambda: F.lit(24), "radix": lambda: F.lit(2),
        "realCeil": lambda r: F.ceil(r).cast("double"), "realFloor": lambda r: F.floor(r).cast("double"), "realRound": F.rint, "realTrunc": lambda r: trunc(r).cast("double"), "realMod": lambda r: r - trunc(r),
        "rem": lambda a, b: a % b, "sameSign": lambda a, b: sign_bit(a) == sign_bit(b), "sign": lambda r: F.when(F.isnan(r), fail("Domain")).otherwise(F.signum(r)).cast("int"), "signBit": sign_bit,
        "split": lambda r: F.struct((r - trunc(r)).alias("frac"), trunc(r).cast("double").alias("whole")),
        "toManExp": lambda r: F.when(r == 0, F.struct(F.lit(0).alias("exp"), r.alias("man"))).otherwise(F.struct((F.floor(F.log2(F.abs(r))) + 1).cast("int").alias("exp"), (r / F.pow(F.lit(2.0), F.floor(F.log2(F.abs(r))) + 1)).alias("man"))),
        "toString": real_text, "unordered": lambda a, b: F.isnan(a) | F.isnan(b),
    },
    "Math": {
        "acos": F.acos, "asin": F.asin, "atan": F.atan, "atan2": F.atan2, "cos": F.cos, "cosh": F.cosh, "e": F.e, "exp": F.exp, "ln": logarithm(F.ln), "log10": logarithm(F.log10), "pi": F.pi, "pow": F.pow,
        "sin": F.sin, "sinh": F.sinh, "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh,
    },
    "Decimal": _COMPARE
    | _ARITHMETIC
    | {
        "abs": F.abs, "ceil": lambda d: F.ceil(d).cast("int"), "compare": order_of, "decimal": lambda s: F.coalesce(s.try_cast("decimal(38,10)"), fail("Domain").cast("decimal(38,10)")), "/": _guard_zero(lambda a, b: a / b), "floor": lambda d: F.floor(d).cast("int"),
        "fmt": lambda digits, d: F.translate(F.bround(d, digits).cast(f"decimal(38,{digits})").cast("string"), "-", "~"), "fromInt": lambda i: i.cast("decimal(38,10)"), "fromReal": lambda r: r.cast("decimal(38,10)"), "fromString": lambda s: F.translate(s, "~", "-").try_cast("decimal(38,10)"),
        "max": F.greatest, "min": F.least, "precision": lambda: F.lit(34), "radix": lambda: F.lit(10), "realCeil": F.ceil, "realFloor": F.floor, "realRound": lambda d: F.bround(d, 0), "realTrunc": trunc,
        "rem": _guard_zero(lambda a, b: a % b), "round": lambda d: F.bround(d, 0).cast("int"), "sign": lambda d: F.signum(d).cast("int"), "toReal": lambda d: d.cast("float"), "trunc": lambda d: trunc(d).cast("int"),
        "toString": lambda d: F.regexp_replace(F.regexp_replace(F.translate(d.cast("string"), "-", "~"), r"(\.\d*?)0+$", "$1"), r"\.$", ""),
    },
    "Bool": {k: _COMPARE[k] for k in ("=", "<>", "<", ">")}
    | {
        "andalso": lambda a, b: a & b, "orelse": lambda a, b: a | b, "implies": lambda a, b: ~a | b, "not": lambda a: ~a, "toString": lambda b: b.cast("string"),
        "fromString": lambda s: F.when(F.lower(F.ltrim(s)).startswith("true"), True).when(F.lower(F.ltrim(s)).startswith("false"), False),
    },
    "Order": {"LESS": lambda: F.lit(-1), "EQUAL": lambda: F.lit(0), "GREATER": lambda: F.lit(1)},
    "Fn": {
        "apply": lambda f, x: f(x), "const": lambda x: lambda _: x, "curry": lambda f: lambda a: lambda b: f(a, b), "equal": lambda a: lambda b: a == b, "flip": lambda f: lambda a, b: f(b, a), "id": same,
        "notEqual": lambda a: lambda b: a != b, "o": lambda f, g: lambda x: f(g(x)), "repeat": lambda n: lambda f: repeat(n, f), "uncurry": lambda f: lambda a, b: f(a)(b),
    },
    "General": {"before": lambda a, _: a, "exnMessage": str, "exnName": lambda e: type(e).__name__, "ignore": lambda _: None, "o": lambda f, g: lambda x: f(g(x))},
}
