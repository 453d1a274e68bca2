"""One wide query a structure of the function library: every function over columns of a table, beside its SQL.

An entry is name: (kind, function of the base columns, SQL). Kinds: i whole number, d real (to six places, no zero below zero), s text, b truth value, ai and as lists.
Base columns are (name, expression) where one text serves both engines, else (name, Spark's, SQL's).
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrel.functions import library as L
from lumenrel.functions.collections import order_of
from lumenrel.plans.query import from_
from lumenrel.sources.files import parquet

lit = F.lit
_SPARK = {"i": lambda c: c.cast("long"), "d": lambda c: F.round(c.cast("double"), 6) + lit(0.0), "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean"), "ai": lambda c: c.cast("array<bigint>"), "as": lambda c: c.cast("array<string>")}
_DUCK = {"i": "CAST({} AS BIGINT)", "d": "round(CAST({} AS DOUBLE), 6) + 0::DOUBLE", "s": "CAST({} AS VARCHAR)", "b": "CAST({} AS BOOLEAN)", "ai": "CAST({} AS BIGINT[])", "as": "CAST({} AS VARCHAR[])"}

QUERIES: dict = {}
SQL: dict[str, str] = {}


def wide(name: str, table: str, key: str, base: list[tuple], entries: dict) -> None:
    """Register a query that gives key and each entry's value for every row of the table."""

    def made(spark, d) -> DataFrame:
        from lumenrel.plans.query import bag

        rows = bag(parquet(spark, d, table).selectExpr(f"{key} AS k", *(f"{b[1]} AS {b[0]}" for b in base)))
        q = from_(r=rows)
        columns = [b[0] for b in base] + ["k"]

        def of(kind, f):
            return lambda r: _SPARK[kind](f(SimpleNamespace(**{c: r[c] for c in columns})))

        return q.yield_({"k": lambda r: r.k} | {n: of(kind, f) for n, (kind, f, _) in entries.items()}).frame()

    QUERIES[name] = made
    inner = ", ".join(f"{b[-1]} AS {b[0]}" for b in base)
    SQL[name] = f"SELECT k, {', '.join(_DUCK[kind].format(sql) + f' AS {n}' for n, (kind, _, sql) in entries.items())} FROM (SELECT {key} AS k, {inner} FROM {table})"


def compare_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} < {b} THEN -1 WHEN {a} = {b} THEN 0 ELSE 1 END"


def comparisons(s: dict, prefix: str, a, b, sa: str, sb: str) -> dict:
    names = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    return {f"{prefix}{n}": ("b", (lambda op: lambda r: s[op](a(r), b(r)))(op), f"({sa} {op} {sb})") for n, op in names.items() if op in s}


def nullary(s: dict, prefix: str, kind: str, **values: str) -> dict:
    return {f"{prefix}{n}": (kind, (lambda n: lambda r: s[n]())(n), v) for n, v in values.items()}


I, W, R, M, D, B, O, G = (L[x] for x in ("Int", "Word", "Real", "Math", "Decimal", "Bool", "Order", "General"))
a_, b_ = (lambda r: r.a), (lambda r: r.b)

# -- whole numbers

wide(
    "lib_int", "part", "p_partkey",
    [("a", "CAST(p_partkey % 83 - 41 AS INT)"), ("b", "CAST(CASE WHEN p_size % 2 = 0 THEN -7 ELSE p_size END AS INT)"), ("t", "concat(' ', CASE WHEN p_partkey % 9 = 0 THEN 'x' WHEN p_partkey % 83 < 41 THEN '~' ELSE '' END, CAST(p_partkey % 83 AS STRING), 'y')")],
    comparisons(I, "", a_, b_, "a", "b")
    | {
        "plus": ("i", lambda r: I["+"](r.a, r.b), "a + b"), "minus": ("i", lambda r: I["-"](r.a, r.b), "a - b"), "times": ("i", lambda r: I["*"](r.a, r.b), "a * b"), "negate": ("i", lambda r: I["~"](r.a), "-a"),
        "abs": ("i", lambda r: I["abs"](r.a), "abs(a)"), "compare": ("i", lambda r: I["compare"](r.a, r.b), compare_sql("a", "b")), "div": ("i", lambda r: I["div"](r.a, r.b), "floor(a / b)"), "mod": ("i", lambda r: I["mod"](r.a, r.b), "a - b * floor(a / b)"),
        "quot": ("i", lambda r: I["quot"](r.a, r.b), "trunc(a / b)"), "rem": ("i", lambda r: I["rem"](r.a, r.b), "a % b"), "max": ("i", lambda r: I["max"](r.a, r.b), "greatest(a, b)"), "min": ("i", lambda r: I["min"](r.a, r.b), "least(a, b)"),
        "sign": ("i", lambda r: I["sign"](r.a), "sign(a)"), "same_sign": ("b", lambda r: I["sameSign"](r.a, r.b), "sign(a) = sign(b)"), "to_string": ("s", lambda r: I["toString"](r.a), "CASE WHEN a < 0 THEN '~' ELSE '' END || abs(a)"),
        "from_string": ("i", lambda r: I["fromString"](r.t), "CASE WHEN NOT starts_with(t, ' x') THEN replace(replace(t, '~', '-'), 'y', '') END"),
        "scan_value": ("i", lambda r: I["scan"](r.t)["_1"], "CASE WHEN NOT starts_with(t, ' x') THEN replace(replace(t, '~', '-'), 'y', '') END"), "scan_rest": ("s", lambda r: I["scan"](r.t)["_2"], "CASE WHEN NOT starts_with(t, ' x') THEN 'y' END"),
        "from_int": ("i", lambda r: I["fromInt"](r.a), "a"), "from_large": ("i", lambda r: I["fromLarge"](r.a), "a"), "to_int": ("i", lambda r: I["toInt"](r.a), "a"), "to_large": ("i", lambda r: I["toLarge"](r.a), "a"),
    }
    | {f"fmt_{k}": ("s", (lambda k: lambda r: I["fmt"](k, r.a))(k), f"CASE WHEN a < 0 THEN '~' ELSE '' END || {sql}") for k, sql in {"BIN": "format('{:b}', abs(a))", "OCT": "format('{:o}', abs(a))", "DEC": "abs(a)", "HEX": "format('{:X}', abs(a))"}.items()}
    | nullary(I, "", "i", maxInt="2147483647", minInt="-2147483648", precision="32"),
)

_MOD = "18446744073709551616::HUGEINT"
_u = lambda x: f"((({x}) % {_MOD} + {_MOD}) % {_MOD})"
_signed = lambda x: f"(CASE WHEN {x} >= 9223372036854775808::HUGEINT THEN {x} - {_MOD} ELSE {x} END)"
_x, _y = "(" + _u("a::HUGEINT") + ")", "(" + _u("b::HUGEINT") + ")"
_w, _v = (lambda r: W["fromInt"](r.a)), (lambda r: W["fromInt"](r.b))
wide(
    "lib_word", "part", "p_partkey",
    [("a", "CAST(p_partkey * 7919 - 5000000 AS BIGINT)"), ("b", "CAST(p_size * 104729 - 900000 AS BIGINT)"), ("n", "CAST(p_size % 21 AS INT)"), ("a_size", "p_size"), ("t", "concat(CASE WHEN p_partkey % 11 = 0 THEN 'zz' WHEN p_size % 3 = 0 THEN '0wxb' ELSE 'b' END, CAST(p_size AS STRING))")],
    comparisons(W, "", _w, _v, _x, _y)
    | {
        "andb": ("s", lambda r: W["andb"](_w(r), _v(r)), f"({_x}::UBIGINT & {_y}::UBIGINT)"), "orb": ("s", lambda r: W["orb"](_w(r), _v(r)), f"({_x}::UBIGINT | {_y}::UBIGINT)"), "xorb": ("s", lambda r: W["xorb"](_w(r), _v(r)), f"xor({_x}::UBIGINT, {_y}::UBIGINT)"),
        "notb": ("s", lambda r: W["notb"](_w(r)), f"({_MOD} - 1 - {_x})"), "compare": ("i", lambda r: W["compare"](_w(r), _v(r)), compare_sql(_x, _y)), "div": ("s", lambda r: W["div"](_w(r), _v(r)), f"({_x} // {_y})"), "mod": ("s", lambda r: W["mod"](_w(r), _v(r)), f"({_x} % {_y})"),
        "max": ("s", lambda r: W["max"](_w(r), _v(r)), f"greatest({_x}, {_y})"), "min": ("s", lambda r: W["min"](_w(r), _v(r)), f"least({_x}, {_y})"), "plus": ("s", lambda r: W["+"](_w(r), _v(r)), _u(f"{_x} + {_y}")), "minus": ("s", lambda r: W["-"](_w(r), _v(r)), _u(f"{_x} - {_y}")),
        "times": ("s", lambda r: W["*"](_w(r), _v(r)), _u("a::HUGEINT * b::HUGEINT")), "negate": ("s", lambda r: W["~"](_w(r)), _u(f"-{_x}")), "shl": ("s", lambda r: W["<<"](_w(r), r.n), _u("a::HUGEINT * (2 ** n)::HUGEINT")), "shr": ("s", lambda r: W[">>"](_w(r), r.n), f"({_x} // (2 ** n)::HUGEINT)"),
        "sar": ("s", lambda r: W["~>>"](_w(r), r.n), _u("(a::HUGEINT - ((a::HUGEINT % (2 ** n)::HUGEINT) + (2 ** n)::HUGEINT) % (2 ** n)::HUGEINT) // (2 ** n)::HUGEINT")), "fmt_hex": ("s", lambda r: W["fmt"]("HEX", _w(r)), f"to_hex({_x}::UBIGINT)"), "fmt_dec": ("s", lambda r: W["fmt"]("DEC", _w(r)), _x),
        "from_string": ("s", lambda r: W["fromString"](r.t), "CASE WHEN NOT contains(t, 'z') THEN CASE WHEN a_size < 10 THEN 176 + a_size ELSE 2816 + 16 * (a_size // 10) + a_size % 10 END END"),
        "scan_rest": ("s", lambda r: W["scan"](F.concat(r.t, lit(" z")))["_2"], "CASE WHEN NOT contains(t, 'z') THEN ' z' END"),
        "from_int": ("s", _w, _x), "from_large": ("s", lambda r: W["fromLarge"](r.a), _x), "from_large_int": ("s", lambda r: W["fromLargeInt"](r.a), _x), "from_large_word": ("s", lambda r: W["fromLargeWord"](_w(r)), _x),
        "to_int": ("i", lambda r: W["toInt"](F.abs(r.b)), "abs(b)"), "to_int_x": ("i", lambda r: W["toIntX"](_w(r)), "a"), "to_large": ("s", lambda r: W["toLarge"](_w(r)), _x), "to_large_int": ("s", lambda r: W["toLargeInt"](_w(r)), _x), "to_large_int_x": ("i", lambda r: W["toLargeIntX"](_w(r)), "a"),
        "to_large_word": ("s", lambda r: W["toLargeWord"](_w(r)), _x), "to_large_word_x": ("s", lambda r: W["toLargeWordX"](_w(r)), _x), "to_large_x": ("s", lambda r: W["toLargeX"](_w(r)), _x), "to_string": ("s", lambda r: W["toString"](_w(r)), f"to_hex({_x}::UBIGINT)"), "word_size": ("i", lambda r: W["wordSize"](), "64"),
    },
)

# -- reals and decimals

_nan = "CASE WHEN p_partkey % 17 = 0 THEN CAST('NaN' AS DOUBLE) WHEN p_partkey % 19 = 0 THEN -CAST('Infinity' AS DOUBLE) ELSE p_retailprice - 1200 END"
_n = "isnan(x)"
_same_bit = lambda v: f"({v} < 0)"
_even = lambda v: f"(CASE WHEN abs({v} - trunc({v})) = 0.5 THEN 2 * round({v} / 2) ELSE round({v}) END)"
wide(
    "lib_real", "part", "p_partkey",
    [("x", _nan), ("y", "CAST(p_size * 0.5 - 12 AS DOUBLE)"), ("z", "p_retailprice - 1200"), ("h", "CAST(p_partkey % 9 - 4 AS DOUBLE) / 2"), ("t", "concat(' ', CASE WHEN p_partkey % 8 = 0 THEN 'w' WHEN p_size % 2 = 0 THEN '~' ELSE '' END, CAST(p_size AS STRING), '.25e1 !')")],
    {
        "eq": ("b", lambda r: R["="](r.x, r.y), f"(NOT {_n} AND x = y)"), "ne": ("b", lambda r: R["<>"](r.x, r.y), f"({_n} OR x <> y)"), "lt": ("b", lambda r: R["<"](r.x, r.y), f"(NOT {_n} AND x < y)"), "le": ("b", lambda r: R["<="](r.x, r.y), f"(NOT {_n} AND x <= y)"),
        "gt": ("b", lambda r: R[">"](r.x, r.y), f"(NOT {_n} AND x > y)"), "ge": ("b", lambda r: R[">="](r.x, r.y), f"(NOT {_n} AND x >= y)"), "unordered": ("b", lambda r: R["unordered"](r.x, r.y), _n), "is_nan": ("b", lambda r: R["isNan"](r.x), _n),
        "is_finite": ("b", lambda r: R["isFinite"](r.x), "isfinite(x)"), "is_normal": ("b", lambda r: R["isNormal"](r.y), "y <> 0"), "plus": ("d", lambda r: R["+"](r.z, r.y), "z + y"), "minus": ("d", lambda r: R["-"](r.z, r.y), "z - y"), "times": ("d", lambda r: R["*"](r.z, r.y), "z * y"),
        "negate": ("d", lambda r: R["~"](r.z), "-z"), "divide": ("s", lambda r: R["toString"](R["/"](lit(1.0), r.h)), "CASE WHEN h = 0 THEN 'inf' ELSE CASE WHEN h < 0 THEN '~' ELSE '' END || CASE abs(h) WHEN 0.5 THEN '2' WHEN 1 THEN '1' WHEN 1.5 THEN '0.6666666666666666' ELSE '0.5' END END"),
        "abs": ("d", lambda r: R["abs"](r.z), "abs(z)"), "ceil": ("i", lambda r: R["ceil"](r.z), "ceil(z)"), "floor": ("i", lambda r: R["floor"](r.z), "floor(z)"), "round": ("i", lambda r: R["round"](r.h), _even("h")), "trunc": ("i", lambda r: R["trunc"](r.z), "trunc(z)"),
        "check_float": ("d", lambda r: R["checkFloat"](r.z), "z"), "compare": ("i", lambda r: R["compare"](r.z, r.y), compare_sql("z", "y")), "copy_sign": ("d", lambda r: R["copySign"](r.z, r.y), "CASE WHEN y < 0 THEN -abs(z) ELSE abs(z) END"), "from_int": ("d", lambda r: R["fromInt"](r.y.cast("int")), "trunc(y)"),
        "from_man_exp": ("d", lambda r: R["fromManExp"](F.struct(r.y.alias("man"), lit(3).alias("exp"))), "y * 8"), "from_string": ("d", lambda r: R["fromString"](r.t), "CASE WHEN NOT contains(t, 'w') THEN replace(split_part(t, '.', 1), '~', '-')::DOUBLE * 10 + CASE WHEN contains(t, '~') THEN -2.5 ELSE 2.5 END END"),
        "scan_rest": ("s", lambda r: R["scan"](r.t)["_2"], "CASE WHEN NOT contains(t, 'w') THEN ' !' END"), "max": ("d", lambda r: R["max"](r.x, r.y), f"CASE WHEN {_n} THEN y ELSE greatest(x, y) END"), "min": ("s", lambda r: R["min"](r.x, r.y) < 0, f"CASE WHEN {_n} THEN y < 0 ELSE least(x, y) < 0 END"),
        "real_ceil": ("d", lambda r: R["realCeil"](r.z), "ceil(z)"), "real_floor": ("d", lambda r: R["realFloor"](r.z), "floor(z)"), "real_round": ("d", lambda r: R["realRound"](r.h), _even("h")), "real_trunc": ("d", lambda r: R["realTrunc"](r.z), "trunc(z)"), "real_mod": ("d", lambda r: R["realMod"](r.h), "h - trunc(h)"),
        "rem": ("d", lambda r: R["rem"](r.h, lit(1.5)), "h - 1.5 * trunc(h / 1.5)"), "same_sign": ("b", lambda r: R["sameSign"](r.z, r.y), "(z < 0) = (y < 0)"), "sign": ("i", lambda r: R["sign"](r.y), "sign(y)"), "sign_bit": ("b", lambda r: R["signBit"](r.y), "y < 0"),
        "split_frac": ("d", lambda r: R["split"](r.h)["frac"], "h - trunc(h)"), "split_whole": ("d", lambda r: R["split"](r.h)["whole"], "trunc(h)"), "man": ("d", lambda r: R["toManExp"](r.y)["man"], "CASE WHEN y = 0 THEN 0 ELSE y / 2 ** (floor(log2(abs(y))) + 1) END"), "exp": ("i", lambda r: R["toManExp"](r.y)["exp"], "CASE WHEN y = 0 THEN 0 ELSE floor(log2(abs(y))) + 1 END"),
        "to_string": ("s", lambda r: R["toString"](r.h), "CASE WHEN h < 0 THEN '~' ELSE '' END || CASE WHEN h = trunc(h) THEN abs(h)::INT::VARCHAR ELSE abs(h)::VARCHAR END"), "fmt_fix": ("s", lambda r: R["fmt"](L["StringCvt"]["FIX"](1), r.h), "CASE WHEN h < 0 THEN '~' ELSE '' END || format('{:.1f}', abs(h))"),
        "fmt_sci": ("s", lambda r: R["fmt"](L["StringCvt"]["SCI"](1), r.h), "CASE WHEN h < 0 THEN '~' ELSE '' END || CASE WHEN abs(h) = 0.5 THEN '5.0E-1' ELSE format('{:.1f}', abs(h)) || 'E0' END".replace("E-1", "E~1")), "fmt_gen": ("s", lambda r: R["fmt"](L["StringCvt"]["GEN"](), r.h), "CASE WHEN h < 0 THEN '~' ELSE '' END || CASE WHEN h = trunc(h) THEN abs(h)::INT::VARCHAR ELSE abs(h)::VARCHAR END"),
        "fmt_exact": ("s", lambda r: R["fmt"](L["StringCvt"]["EXACT"](), r.h), "CASE WHEN h < 0 THEN '~' ELSE '' END || CASE WHEN h = trunc(h) THEN abs(h)::INT::VARCHAR ELSE abs(h)::VARCHAR END"),
        "pos_inf": ("b", lambda r: R["posInf"]() > r.z, "true"), "neg_inf": ("b", lambda r: R["negInf"]() < r.z, "true"), "max_finite": ("d", lambda r: R["maxFinite"]() / lit(1e38), "3.4028234663852886"), "min_normal": ("d", lambda r: R["minNormalPos"]().cast("double") * lit(1e38), "1.17549435"), "min_pos": ("d", lambda r: R["minPos"]().cast("double") * lit(1e45), "1.401298"),
    }
    | nullary(R, "", "i", precision="24", radix="2"),
)

wide(
    "lib_math", "part", "p_partkey", [("x", "CAST(p_size - 25 AS DOUBLE) / 10"), ("u", "CAST(p_size AS DOUBLE) / 60"), ("w", "CAST(p_size - 1 AS DOUBLE)")],
    {k: ("d", (lambda k: lambda r: M[k](r.x))(k), f"{k}(x)") for k in ("atan", "cos", "cosh", "exp", "sin", "sinh", "tan", "tanh")}
    | {k: ("d", (lambda k: lambda r: M[k](r.u))(k), f"{k}(u)") for k in ("acos", "asin", "sqrt")}
    | {
        "atan2": ("d", lambda r: M["atan2"](r.x, r.u), "atan2(x, u)"), "pow": ("d", lambda r: M["pow"](r.u, r.x), "pow(u, x)"), "ln": ("s", lambda r: F.round(M["ln"](r.w), 4) > 2, "(w > 0 AND round(ln(greatest(w, 1)), 4) > 2)"),
        "log10": ("d", lambda r: M["log10"](r.w + 1), "log10(w + 1)"), "e": ("d", lambda r: M["e"](), "exp(1)"), "pi": ("d", lambda r: M["pi"](), "pi()"),
    },
)

_dec = "CAST(CAST(p_partkey % 41 - 20 AS DECIMAL(20,4)) / 8 AS DECIMAL(20,4))"
_round_even = "(CASE WHEN abs(a - trunc(a)) = 0.5 THEN 2 * round(a / 2) ELSE round(a) END)"
wide(
    "lib_decimal", "part", "p_partkey", [("a", _dec, "CAST((p_partkey % 41 - 20) / 8 AS DECIMAL(20,4))"), ("b", "CAST(p_size AS DECIMAL(20,4))"), ("t", "concat(CASE WHEN p_partkey % 7 = 0 THEN 'q' WHEN p_size % 2 = 0 THEN '~' ELSE '' END, CAST(p_size AS STRING), '.5')")],
    comparisons(D, "", a_, b_, "a", "b")
    | {
        "plus": ("d", lambda r: D["+"](r.a, r.b), "a + b"), "minus": ("d", lambda r: D["-"](r.a, r.b), "a - b"), "times": ("d", lambda r: D["*"](r.a, r.b), "a::DOUBLE * b::DOUBLE"), "negate": ("d", lambda r: D["~"](r.a), "-a"), "divide": ("d", lambda r: F.round(D["/"](r.a, r.b).cast("double"), 4), "round(a::DOUBLE / b::DOUBLE, 4)"),
        "abs": ("d", lambda r: D["abs"](r.a), "abs(a)"), "ceil": ("i", lambda r: D["ceil"](r.a), "ceil(a)"), "floor": ("i", lambda r: D["floor"](r.a), "floor(a)"), "round": ("i", lambda r: D["round"](r.a), _round_even), "trunc": ("i", lambda r: D["trunc"](r.a), "trunc(a::DOUBLE)"),
        "real_ceil": ("d", lambda r: D["realCeil"](r.a), "ceil(a)"), "real_floor": ("d", lambda r: D["realFloor"](r.a), "floor(a)"), "real_round": ("d", lambda r: D["realRound"](r.a), _round_even), "real_trunc": ("d", lambda r: D["realTrunc"](r.a), "trunc(a::DOUBLE)"),
        "compare": ("i", lambda r: D["compare"](r.a, r.b), compare_sql("a", "b")), "decimal": ("d", lambda r: D["decimal"](r.b.cast("string")), "b"), "fmt": ("s", lambda r: D["fmt"](3, r.a), "CASE WHEN a < 0 THEN '~' ELSE '' END || format('{:.3f}', abs(a)::DOUBLE)"),
        "from_int": ("d", lambda r: D["fromInt"](r.b.cast("int")), "b"), "from_real": ("d", lambda r: D["fromReal"](r.a.cast("double")), "a"), "from_string": ("d", lambda r: D["fromString"](r.t), "TRY_CAST(replace(t, '~', '-') AS DOUBLE)"), "max": ("d", lambda r: D["max"](r.a, r.b), "greatest(a, b)"), "min": ("d", lambda r: D["min"](r.a, r.b), "least(a, b)"),
        "rem": ("d", lambda r: D["rem"](r.a, r.b), "a::DOUBLE - b::DOUBLE * trunc(a::DOUBLE / b::DOUBLE)"), "sign": ("i", lambda r: D["sign"](r.a), "sign(a)"), "to_real": ("d", lambda r: D["toReal"](r.a), "a"), "to_string": ("s", lambda r: D["toString"](r.a), "CASE WHEN a < 0 THEN '~' ELSE '' END || CASE WHEN a = trunc(a) THEN abs(a)::INT::VARCHAR ELSE (abs(a)::DOUBLE)::VARCHAR END"),
        "max_finite": ("s", lambda r: D["maxFinite"](), "repeat('9', 28) || '.' || repeat('9', 10)"), "min_pos": ("d", lambda r: D["minPos"]().cast("double") * lit(1e10), "1"),
    }
    | nullary(D, "", "i", precision="34", radix="10"),
)

# -- truth values, functions, order, top level

FN, T = L["Fn"], L["Top-level"]
wide(
    "lib_bool_fn", "part", "p_partkey",
    [("p", "p_size % 2 = 0"), ("q", "p_size % 3 = 0"), ("x", "CAST(p_size AS INT)"), ("y", "CAST(p_partkey % 7 - 3 AS INT)"), ("t", "concat(' ', CASE p_size % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' ELSE 'maybe' END, '!')"), ("xs", "array(p_size, p_partkey % 5)", "list_value(p_size, p_partkey % 5)")],
    {
        "eq": ("b", lambda r: B["="](r.p, r.q), "p = q"), "ne": ("b", lambda r: B["<>"](r.p, r.q), "p <> q"), "lt": ("b", lambda r: B["<"](r.p, r.q), "p < q"), "gt": ("b", lambda r: B[">"](r.p, r.q), "p > q"), "andalso": ("b", lambda r: B["andalso"](r.p, r.q), "p AND q"), "orelse": ("b", lambda r: B["orelse"](r.p, r.q), "p OR q"),
        "implies": ("b", lambda r: B["implies"](r.p, r.q), "NOT p OR q"), "not_": ("b", lambda r: B["not"](r.p), "NOT p"), "to_string": ("s", lambda r: B["toString"](r.p), "CASE WHEN p THEN 'true' ELSE 'false' END"), "from_string": ("b", lambda r: B["fromString"](r.t), "CASE WHEN contains(t, 'true') THEN true WHEN contains(t, 'FALSE') THEN false END"),
        "scan_rest": ("s", lambda r: B["scan"](r.t)["_2"], "CASE WHEN NOT contains(t, 'maybe') THEN '!' END"), "less": ("i", lambda r: O["LESS"](), "-1"), "equal": ("i", lambda r: O["EQUAL"](), "0"), "greater": ("i", lambda r: O["GREATER"](), "1"),
        "fn_apply": ("i", lambda r: FN["apply"](lambda v: v + 1, r.x), "x + 1"), "fn_const": ("i", lambda r: FN["const"](r.x)(r.y), "x"), "fn_curry": ("i", lambda r: FN["curry"](lambda u, v: u - v)(r.x)(r.y), "x - y"), "fn_uncurry": ("i", lambda r: FN["uncurry"](lambda u: lambda v: u - v)(r.x, r.y), "x - y"), "fn_equal": ("b", lambda r: FN["equal"](r.x)(r.y), "x = y"),
        "fn_not_equal": ("b", lambda r: FN["notEqual"](r.x)(r.y), "x <> y"), "fn_flip": ("i", lambda r: FN["flip"](lambda u, v: u - v)(r.x, r.y), "y - x"), "fn_id": ("i", lambda r: FN["id"](r.x), "x"), "fn_o": ("i", lambda r: FN["o"](lambda v: v * 2, lambda v: v + 1)(r.x), "(x + 1) * 2"), "fn_repeat": ("i", lambda r: FN["repeat"](3)(lambda v: v * 2)(r.x), "x * 8"),
        "general_before": ("i", lambda r: G["before"](r.x, r.y), "x"), "general_o": ("i", lambda r: G["o"](lambda v: v * 2, lambda v: v + 1)(r.x), "(x + 1) * 2"),
        "op_div": ("i", lambda r: T["op div"](r.x, lit(-7)), "floor(x / -7)"), "op_mod": ("i", lambda r: T["op mod"](r.y, lit(5)), "((y % 5) + 5) % 5"), "op_slash": ("d", lambda r: T["op /"](r.x.cast("double"), lit(4.0)), "x / 4"), "op_plus": ("i", lambda r: T["op +"](r.x, r.y), "x + y"), "op_minus": ("i", lambda r: T["op -"](r.x, r.y), "x - y"), "op_times": ("i", lambda r: T["op *"](r.x, r.y), "x * y"),
        "op_negate": ("i", lambda r: T["op ~"](r.x), "-x"), "top_abs": ("i", lambda r: T["abs"](r.y), "abs(y)"), "op_cons": ("ai", lambda r: T["op ::"](r.y, r.xs), "list_concat([y], xs)"), "op_elem": ("b", lambda r: T["op elem"](r.x, r.xs), "list_contains(xs, x)"), "op_notelem": ("b", lambda r: T["op notelem"](r.y, r.xs), "NOT list_contains(xs, y)"),
        "top_true": ("b", lambda r: T["true"](), "true"), "top_false": ("b", lambda r: T["false"](), "false"), "top_bag": ("ai", lambda r: T["bag"](r.xs), "xs"), "top_vector": ("ai", lambda r: T["vector"](r.xs), "xs"), "top_real": ("d", lambda r: T["real"](r.x), "x"), "sum_int": ("i", lambda r: T["sum$int"](r.xs), "list_sum(xs)"), "sum_real": ("d", lambda r: T["sum$real"](r.xs.cast("array<double>")), "list_sum(xs)"),
        "sum_decimal": ("d", lambda r: F.aggregate(r.xs.cast("array<decimal(20,4)>"), lit(0).cast("decimal(38,10)"), lambda a, v: (a + v).cast("decimal(38,10)")), "list_sum(xs)"), "inl": ("i", lambda r: T["INL"](r.x)["left"], "x"), "inr": ("i", lambda r: T["INR"](r.y)["right"], "y"),
        "attempt": ("i", lambda r: T["$attempt"](r.p, r.x), "CASE WHEN p THEN x END"), "check": ("i", lambda r: T["$check"](r.x > 0, r.x, "Constraint"), "x"), "require": ("b", lambda r: T["$require"](r.x > 0, "Constraint"), "true"),
    }
    | comparisons(T, "any_", lambda r: r.x, lambda r: r.y, "x", "y")
    | {f"op_{n}": ("b", (lambda op: lambda r: T[f"op {op}"](r.x, r.y))(op), f"x {op} y") for n, op in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items()},
)

# -- text

S, C, V = L["String"], L["Char"], L["StringCvt"]
_o = lambda c: c == " "
_chars = "list_transform(range(1, length(s) + 1), lambda i: s[i])"
wide(
    "lib_string", "part", "p_partkey",
    [("s", "concat(p_name, CASE WHEN p_size % 4 = 0 THEN '  ' ELSE '' END, p_brand)"), ("u", "p_type"), ("n", "CAST(p_size % 3 AS INT)"), ("e", "concat('a', CASE p_size % 3 WHEN 0 THEN chr(9) WHEN 1 THEN chr(34) ELSE '' END, 'b', chr(92), chr(10))")],
    comparisons(S, "", lambda r: r.s, lambda r: r.u, "s", "u")
    | {
        "concat2": ("s", lambda r: S["^"](r.s, r.u), "s || u"), "collate": ("i", lambda r: S["collate"](order_of, r.s, r.u), compare_sql("s", "u")), "compare": ("i", lambda r: S["compare"](r.s, r.u), compare_sql("s", "u")), "concat": ("s", lambda r: S["concat"](F.array(r.s, r.u, r.s)), "s || u || s"), "concat_with": ("s", lambda r: S["concatWith"](lit(", "), F.array(r.s, r.u)), "s || ', ' || u"),
        "explode": ("as", lambda r: S["explode"](r.s), _chars), "extract": ("s", lambda r: S["extract"](r.s, r.n), "s[n + 1:]"), "extract_n": ("s", lambda r: S["extract"](r.s, r.n, lit(2)), "s[n + 1:n + 2]"), "fields": ("as", lambda r: S["fields"](_o, r.s), "string_split(s, ' ')"), "tokens": ("as", lambda r: S["tokens"](_o, r.s), "list_filter(string_split(s, ' '), lambda x: x <> '')"),
        "implode": ("s", lambda r: S["implode"](S["explode"](r.s)), "s"), "is_prefix": ("b", lambda r: S["isPrefix"](F.substring(r.u, 1, 1), r.s), "starts_with(s, u[1])"), "is_substring": ("b", lambda r: S["isSubstring"](lit("nd#1"), r.s), "contains(s, 'nd#1')"), "is_suffix": ("b", lambda r: S["isSuffix"](lit("3"), r.s), "ends_with(s, '3')"),
        "map": ("s", lambda r: S["map"](C["toUpper"], r.s), "upper(s)"), "translate": ("s", lambda r: S["translate"](lambda c: F.concat(c, c), r.u), "list_aggregate(list_transform(range(1, length(u) + 1), lambda i: u[i] || u[i]), 'string_agg', '')"), "size": ("i", lambda r: S["size"](r.s), "length(s)"), "str": ("s", lambda r: S["str"](F.substring(r.s, 1, 1)), "s[1]"),
        "sub": ("s", lambda r: S["sub"](r.s, r.n), "s[n + 1]"), "substring": ("s", lambda r: S["substring"](r.s, r.n, lit(3)), "s[n + 1:n + 3]"), "to_string": ("s", lambda r: S["toString"](r.e), r"replace(replace(replace(replace(e, '\', '\\'), chr(9), '\t'), chr(34), '\' || chr(34)), chr(10), '\n')"),
        "to_c_string": ("s", lambda r: S["toCString"](r.e), r"replace(replace(replace(replace(e, '\', '\\'), chr(9), '\t'), chr(34), '\' || chr(34)), chr(10), '\n')"), "from_string": ("s", lambda r: S["fromString"](S["toString"](r.e)), "e"), "from_c_string": ("s", lambda r: S["fromCString"](S["toCString"](r.e)), "e"), "scan": ("s", lambda r: S["scan"](r.s)["_1"], "s"), "max_size": ("i", lambda r: S["maxSize"](), "2147483647"),
        "pad_left": ("s", lambda r: V["padLeft"](lit("*"), 30, r.s), "CASE WHEN length(s) < 30 THEN lpad(s, 30, '*') ELSE s END"), "pad_right": ("s", lambda r: V["padRight"](lit("*"), 30, r.s), "CASE WHEN length(s) < 30 THEN rpad(s, 30, '*') ELSE s END"), "skip_ws": ("s", lambda r: V["skipWS"](F.concat(lit(" \t"), r.s)), "ltrim(s)"),
        "dropl": ("s", lambda r: V["dropl"](lambda c: c != " ", F.concat(r.s, lit(" "))), "(s || ' ')[strpos(s || ' ', ' '):]"), "takel": ("s", lambda r: V["takel"](lambda c: c != " ", F.concat(r.s, lit(" "))), "split_part(s, ' ', 1)"), "splitl_1": ("s", lambda r: V["splitl"](lambda c: c != " ", F.concat(r.s, lit(" ")))["_1"], "split_part(s, ' ', 1)"), "splitl_2": ("s", lambda r: V["splitl"](lambda c: c != " ", F.concat(r.s, lit(" ")))["_2"], "(s || ' ')[strpos(s || ' ', ' '):]"),
        "scan_string": ("i", lambda r: V["scanString"](I["fromString"], r.n.cast("string")), "n"),
    }
    | {f"radix_{k}": ("s", (lambda k: lambda r: I["fmt"](V[k](), r.n + 8))(k), f"format('{{:{f}}}', n + 8)") for k, f in {"BIN": "b", "OCT": "o", "DEC": "d", "HEX": "X"}.items()},
)

_class = {"isAlpha": "[A-Za-z]", "isAlphaNum": "[A-Za-z0-9]", "isAscii": r"[\x00-\x7f]", "isCntrl": r"[\x00-\x1f\x7f]", "isDigit": "[0-9]", "isGraph": "[!-~]", "isHexDigit": "[0-9A-Fa-f]", "isLower": "[a-z]", "isOctDigit": "[0-7]", "isPrint": "[ -~]", "isPunct": "[!-/:-@\\[-`{-~]", "isSpace": r"[ \t\n\x0b\f\r]", "isUpper": "[A-Z]"}
wide(
    "lib_char", "part", "p_partkey", [("i", "CAST(32 + p_partkey % 94 AS INT)"), ("c", "chr(CAST(32 + p_partkey % 94 AS INT))"), ("f", "chr(CAST(48 + p_size AS INT))"), ("w", "chr(CAST(9 + p_partkey % 30 AS INT))")],
    comparisons(C, "", lambda r: r.c, lambda r: r.f, "c", "f")
    | {k: ("b", (lambda k: lambda r: C[k](r.c))(k), f"regexp_full_match(c, '{p}')") for k, p in _class.items() if k not in ("isCntrl", "isSpace")}
    | {"isCntrl": ("b", lambda r: C["isCntrl"](r.w), "ord(w) < 32"), "isSpace": ("b", lambda r: C["isSpace"](r.w), "ord(w) BETWEEN 9 AND 13 OR ord(w) = 32")}
    | {
        "chr": ("s", lambda r: C["chr"](r.i), "c"), "compare": ("i", lambda r: C["compare"](r.c, r.f), compare_sql("ord(c)", "ord(f)")), "contains": ("b", lambda r: C["contains"](lit("abc123"), r.c), "contains('abc123', c)"), "not_contains": ("b", lambda r: C["notContains"](lit("abc123"), r.c), "NOT contains('abc123', c)"), "from_int": ("s", lambda r: C["fromInt"](r.i * 3), "CASE WHEN i * 3 <= 255 THEN chr(i * 3) END"),
        "from_string": ("s", lambda r: C["fromString"](C["toString"](r.c)), "c"), "from_c_string": ("s", lambda r: C["fromCString"](C["toCString"](r.c)), "c"), "ord": ("i", lambda r: C["ord"](r.c), "i"), "pred": ("s", lambda r: C["pred"](r.c), "chr(i - 1)"), "succ": ("s", lambda r: C["succ"](r.c), "chr(i + 1)"), "to_lower": ("s", lambda r: C["toLower"](r.c), "lower(c)"), "to_upper": ("s", lambda r: C["toUpper"](r.c), "upper(c)"),
        "to_string": ("s", lambda r: C["toString"](r.c), r"CASE WHEN i IN (34, 92) THEN '\' || c ELSE c END"), "to_c_string": ("s", lambda r: C["toCString"](r.c), r"CASE WHEN i IN (34, 39, 63, 92) THEN '\' || c ELSE c END"), "scan": ("s", lambda r: C["scan"](F.concat(C["toString"](r.c), lit("zz")))["_2"], "'zz'"),
        "max_ord": ("i", lambda r: C["maxOrd"](), "255"), "max_char": ("i", lambda r: C["ord"](C["maxChar"]()), "255"), "min_char": ("i", lambda r: C["ord"](C["minChar"]()), "0"),
    },
)

# -- collections

_XS = [
    ("xs", "filter(array(p_size % 5, p_size % 3, p_partkey % 4, p_size % 7), v -> v <> 2)", "list_filter([p_size % 5, p_size % 3, p_partkey % 4, p_size % 7], lambda v: v <> 2)"),
    ("ys", "filter(array(p_partkey % 3, p_size % 4, p_partkey % 5), v -> v <> 0)", "list_filter([p_partkey % 3, p_size % 4, p_partkey % 5], lambda v: v <> 0)"),
    ("zs", "array(p_size, p_size % 5, p_partkey % 4)", "[p_size, p_size % 5, p_partkey % 4]"), ("n", "CAST(p_size % 4 AS INT)"), ("x", "CAST(p_size AS INT)"),
]
_XS = [(n, f"CAST({b[0]} AS ARRAY<INT>)" if n.endswith("s") else b[0], b[-1]) for n, *b in _XS]
_fold, _foldr = "list_reduce(list_concat([0], xs), lambda a, v: v - a)", "list_reduce(list_concat([0], list_reverse(xs)), lambda a, v: v - a)"
_count = lambda of, v: f"len(list_filter({of}, lambda u: u = {v}))"


def _common(s: dict, p: str) -> dict:
    made = {
        "all": ("b", lambda r: s["all"](lambda v: v > 0, r.xs), "len(list_filter(xs, lambda v: v <= 0)) = 0"), "app": ("i", lambda r: s["app"](lambda v: v + 1, r.xs), "0"), "@": ("ai", lambda r: s["@"](r.xs, r.ys), "list_concat(xs, ys)"), "concat": ("ai", lambda r: s["concat"](F.array(r.xs, r.ys, r.xs)), "list_concat(list_concat(xs, ys), xs)"),
        "drop": ("ai", lambda r: s["drop"](r.zs, lit(2)), "zs[3:]"), "exists": ("b", lambda r: s["exists"](lambda v: v > 3, r.xs), "len(list_filter(xs, lambda v: v > 3)) > 0"), "filter": ("ai", lambda r: s["filter"](lambda v: v > 1, r.xs), "list_filter(xs, lambda v: v > 1)"), "find": ("i", lambda r: s["find"](lambda v: v > 1, r.xs), "list_filter(xs, lambda v: v > 1)[1]"),
        "getItem": ("i", lambda r: s["getItem"](r.xs)["_1"], "xs[1]"), "getItem_rest": ("ai", lambda r: s["getItem"](r.xs)["_2"], "CASE WHEN len(xs) > 0 THEN xs[2:] END"), "hd": ("i", lambda r: s["hd"](r.zs), "zs[1]"), "length": ("i", lambda r: s["length"](r.xs), "len(xs)"), "map": ("ai", lambda r: s["map"](lambda v: v * 3, r.xs), "list_transform(xs, lambda v: v * 3)"),
        "mapPartial": ("ai", lambda r: s["mapPartial"](lambda v: F.when(v > 1, v * 2), r.xs), "list_transform(list_filter(xs, lambda v: v > 1), lambda v: v * 2)"), "nil": ("i", lambda r: F.size(s["nil"]("int")), "0"), "nth": ("i", lambda r: s["nth"](r.zs, lit(1)), "zs[2]"), "null": ("b", lambda r: s["null"](r.xs), "len(xs) = 0"), "only": ("i", lambda r: s["only"](F.array(r.x)), "x"),
        "partition_1": ("ai", lambda r: s["partition"](lambda v: v > 1, r.xs)["_1"], "list_filter(xs, lambda v: v > 1)"), "partition_2": ("ai", lambda r: s["partition"](lambda v: v > 1, r.xs)["_2"], "list_filter(xs, lambda v: v <= 1)"), "tabulate": ("ai", lambda r: s["tabulate"](r.n, lambda i: i * i), "list_transform(range(0, n), lambda i: i * i)"), "take": ("ai", lambda r: s["take"](r.zs, lit(2)), "zs[1:2]"), "tl": ("ai", lambda r: s["tl"](r.zs), "zs[2:]"),
        "foldl": ("i", lambda r: s["foldl"](lambda v, a: v - a, lit(0), r.xs), _fold), "fold": ("i", lambda r: s["fold"](lambda v, a: v - a, lit(0), r.xs), _fold), "foldr": ("i", lambda r: s["foldr"](lambda v, a: v - a, lit(0), r.xs), _foldr), "fromList": ("ai", lambda r: s["fromList"](r.xs), "xs"), "toList": ("ai", lambda r: s["toList"](r.xs), "xs"),
        "collate": ("i", lambda r: s["collate"](order_of, r.xs, r.ys), compare_sql("xs", "ys")), "mapi": ("ai", lambda r: s["mapi"](lambda i, v: i * 10 + v, r.xs), "list_transform(xs, lambda v, i: (i - 1) * 10 + v)"),
    }
    return {f"{p}{k.replace('@', 'append')}": v for k, v in made.items() if k.split("_")[0] in s}


LI, BA, VE, LP, RE = L["List"], L["Bag"], L["Vector"], L["ListPair"], L["Relational"]
wide(
    "lib_list", "part", "p_partkey", _XS,
    _common(LI, "")
    | {
        "except": ("ai", lambda r: LI["except"](F.array(r.xs, r.ys)), f"list_filter(xs, lambda v, i: {_count('xs[1:i]', 'v')} > {_count('ys', 'v')})"), "intersect": ("ai", lambda r: LI["intersect"](F.array(r.xs, r.ys)), f"list_filter(xs, lambda v, i: {_count('xs[1:i]', 'v')} <= {_count('ys', 'v')})"),
        "last": ("i", lambda r: LI["last"](r.zs), "zs[3]"), "rev": ("ai", lambda r: LI["rev"](r.xs), "list_reverse(xs)"), "revAppend": ("ai", lambda r: LI["revAppend"](r.xs, r.ys), "list_concat(list_reverse(xs), ys)"), "cons": ("ai", lambda r: LI["::"](r.x, r.xs), "list_concat([x], xs)"), "elem": ("b", lambda r: LI["elem"](r.n, r.xs), "list_contains(xs, n)"), "notelem": ("b", lambda r: LI["notelem"](r.n, r.xs), "NOT list_contains(xs, n)"),
    },
)
wide("lib_bag", "part", "p_partkey", _XS, _common(BA, ""))
wide(
    "lib_vector", "part", "p_partkey", _XS,
    _common(VE, "")
    | {
        "appi": ("i", lambda r: VE["appi"](lambda i, v: i + v, r.xs), "0"), "findi_i": ("i", lambda r: VE["findi"](lambda i, v: v > i, r.xs)["i"], "list_filter(list_transform(xs, lambda v, i: CASE WHEN v > i - 1 THEN i - 1 END), lambda j: j IS NOT NULL)[1]"), "findi_x": ("i", lambda r: VE["findi"](lambda i, v: v > i, r.xs)["x"], "list_filter(xs, lambda v, i: v > i - 1)[1]"),
        "foldli": ("i", lambda r: VE["foldli"](lambda i, v, a: a + i * v, lit(0), r.xs), "coalesce(list_sum(list_transform(xs, lambda v, i: (i - 1) * v)), 0)"), "foldri": ("i", lambda r: VE["foldri"](lambda i, v, a: a + i * v, lit(0), r.xs), "coalesce(list_sum(list_transform(xs, lambda v, i: (i - 1) * v)), 0)"),
        "maxLen": ("i", lambda r: VE["maxLen"](), "16777215"), "sub": ("i", lambda r: VE["sub"](r.zs, lit(2)), "zs[3]"), "update": ("ai", lambda r: VE["update"](r.zs, lit(1), r.x * 2), "[zs[1], x * 2, zs[3]]"),
    },
)
_zip = "list_filter(list_zip(xs, ys), lambda p: p[1] IS NOT NULL AND p[2] IS NOT NULL)"
_pairs = "list_transform(" + _zip + ", lambda p: p[1] * 10 + p[2])"
_flat = lambda c: F.transform(c, lambda p: p["_1"] * 10 + p["_2"])
_add = lambda u, v: u * 10 + v
_half = lambda r: F.reverse(r.zs)
_fold2 = lambda lists, sign="": f"list_reduce(list_concat([0::BIGINT], {lists}), lambda a, v: v - a)"
_zz = "[zs[1] * 10 + zs[3], zs[2] * 11, zs[3] * 10 + zs[1]]"
wide(
    "lib_listpair", "part", "p_partkey", _XS,
    {
        "all": ("b", lambda r: LP["all"](lambda u, v: u <= v, r.xs, r.ys), f"len(list_filter({_zip}, lambda p: p[1] > p[2])) = 0"), "allEq": ("b", lambda r: LP["allEq"](lambda u, v: u <= v, r.xs, r.ys), f"len(xs) = len(ys) AND len(list_filter({_zip}, lambda p: p[1] > p[2])) = 0"), "app": ("i", lambda r: LP["app"](_add, r.xs, r.ys), "0"), "appEq": ("i", lambda r: LP["appEq"](_add, r.zs, _half(r)), "0"),
        "exists": ("b", lambda r: LP["exists"](lambda u, v: u == v, r.xs, r.ys), f"len(list_filter({_zip}, lambda p: p[1] = p[2])) > 0"), "foldl": ("i", lambda r: LP["foldl"](lambda u, v, a: u * 10 + v - a, lit(0), r.xs, r.ys), _fold2(_pairs)), "foldr": ("i", lambda r: LP["foldr"](lambda u, v, a: u * 10 + v - a, lit(0), r.xs, r.ys), _fold2(f"list_reverse({_pairs})")),
        "foldlEq": ("i", lambda r: LP["foldlEq"](lambda u, v, a: u * 10 + v - a, lit(0), r.zs, _half(r)), _fold2(_zz)), "foldrEq": ("i", lambda r: LP["foldrEq"](lambda u, v, a: u * 10 + v - a, lit(0), r.zs, _half(r)), _fold2(f"list_reverse({_zz})")), "map": ("ai", lambda r: LP["map"](_add, r.xs, r.ys), _pairs), "mapEq": ("ai", lambda r: LP["mapEq"](_add, r.zs, _half(r)), _zz),
        "zip": ("ai", lambda r: _flat(LP["zip"](r.xs, r.ys)), _pairs), "zipEq": ("ai", lambda r: _flat(LP["zipEq"](r.zs, _half(r))), _zz), "unzip_1": ("ai", lambda r: LP["unzip"](LP["zip"](r.xs, r.ys))["_1"], "xs[1:least(len(xs), len(ys))]"), "unzip_2": ("ai", lambda r: LP["unzip"](LP["zip"](r.xs, r.ys))["_2"], "ys[1:least(len(xs), len(ys))]"),
    },
)
wide(
    "lib_relational", "part", "p_partkey", _XS,
    {
        "compare": ("i", lambda r: RE["compare"](r.x, r.n), compare_sql("x", "n")), "count": ("i", lambda r: RE["count"](r.xs), "len(xs)"), "empty": ("b", lambda r: RE["empty"](r.xs), "len(xs) = 0"), "nonEmpty": ("b", lambda r: RE["nonEmpty"](r.xs), "len(xs) > 0"), "max": ("i", lambda r: RE["max"](r.zs), "list_max(zs)"), "min": ("i", lambda r: RE["min"](r.zs), "list_min(zs)"), "only": ("i", lambda r: RE["only"](F.array(r.n)), "n"), "sum": ("i", lambda r: RE["sum"](r.xs), "coalesce(list_sum(xs), 0)"),
        "maxBy": ("i", lambda r: RE["maxBy"](lambda v: v % 3, r.zs), "list_filter(zs, lambda v: v % 3 = list_max(list_transform(zs, lambda u: u % 3)))[1]"), "minBy": ("i", lambda r: RE["minBy"](lambda v: v % 3, r.zs), "list_filter(zs, lambda v: v % 3 = list_min(list_transform(zs, lambda u: u % 3)))[1]"),
        "test_sum": ("i", lambda r: L["Test"]["listSum"](r.xs), "coalesce(list_sum(xs), 0)"), "test_bag_sum": ("i", lambda r: L["Test"]["bagSum"](r.xs), "coalesce(list_sum(xs), 0)"), "test_over_sum": ("i", lambda r: L["Test"]["overSum"](r.xs), "coalesce(list_sum(xs), 0)"), "test_over_count": ("i", lambda r: L["Test"]["overCount"](r.xs), "len(xs)"), "test_foo": ("i", lambda r: L["Test"]["foo"](r.x), "x + 1"), "test_highlight": ("i", lambda r: L["Test"]["highlight"](r.x), "x"),
    },
)

# -- options, alternatives, ranges

OP, EI, RA = L["Option"], L["Either"], L["Range"]
_e = lambda r: F.when(r.x % 3 == 0, EI["INL"](r.x)).otherwise(EI["INR"](r.n))
_left = "x % 3 = 0"
wide(
    "lib_option_either", "part", "p_partkey", [("o", "CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS INT) END"), ("x", "CAST(p_size AS INT)"), ("n", "CAST(p_partkey % 7 AS INT)")],
    {
        "app": ("i", lambda r: OP["app"](lambda v: v + 1, r.o), "o + 1"), "compose": ("i", lambda r: OP["compose"](lambda v: v * 2, lambda v: F.when(v > 9, v))(r.x), "CASE WHEN x > 9 THEN x * 2 END"), "composePartial": ("i", lambda r: OP["composePartial"](lambda v: F.when(v > 30, v), lambda v: F.when(v > 9, v + 1))(r.x), "CASE WHEN x > 9 AND x + 1 > 30 THEN x + 1 END"),
        "filter": ("i", lambda r: OP["filter"](lambda v: v > 20, r.x), "CASE WHEN x > 20 THEN x END"), "getOpt": ("i", lambda r: OP["getOpt"](r.o, lit(-1)), "coalesce(o, -1)"), "isSome": ("b", lambda r: OP["isSome"](r.o), "o IS NOT NULL"), "join": ("i", lambda r: OP["join"](r.o), "o"), "map": ("i", lambda r: OP["map"](lambda v: v * 2, r.o), "o * 2"),
        "mapPartial": ("i", lambda r: OP["mapPartial"](lambda v: F.when(v > 9, v), r.o), "CASE WHEN o > 9 THEN o END"), "NONE": ("i", lambda r: OP["NONE"](), "NULL"), "SOME": ("i", lambda r: OP["SOME"](r.x), "x"), "valOf": ("i", lambda r: OP["valOf"](r.x), "x"),
        "INL": ("i", lambda r: EI["INL"](r.x)["left"], "x"), "INR": ("i", lambda r: EI["INR"](r.x)["right"], "x"), "asLeft": ("i", lambda r: EI["asLeft"](_e(r)), f"CASE WHEN {_left} THEN x END"), "asRight": ("i", lambda r: EI["asRight"](_e(r)), f"CASE WHEN NOT {_left} THEN n END"), "isLeft": ("b", lambda r: EI["isLeft"](_e(r)), _left), "isRight": ("b", lambda r: EI["isRight"](_e(r)), f"NOT {_left}"),
        "proj": ("i", lambda r: EI["proj"](_e(r)), f"CASE WHEN {_left} THEN x ELSE n END"), "fold": ("i", lambda r: EI["fold"](lambda v, a: v + a, lambda v, a: v * a)(lit(5), _e(r)), f"CASE WHEN {_left} THEN x + 5 ELSE n * 5 END"), "either_map": ("i", lambda r: EI["proj"](EI["map"](lambda v: v + 1, lambda v: v * 2)(_e(r))), f"CASE WHEN {_left} THEN x + 1 ELSE n * 2 END"),
        "mapLeft": ("i", lambda r: EI["proj"](EI["mapLeft"](lambda v: v + 1)(_e(r))), f"CASE WHEN {_left} THEN x + 1 ELSE n END"), "mapRight": ("i", lambda r: EI["proj"](EI["mapRight"](lambda v: v * 2)(_e(r))), f"CASE WHEN {_left} THEN x ELSE n * 2 END"), "either_app": ("i", lambda r: EI["proj"](EI["app"](lambda v: v, lambda v: -v)(_e(r))), f"CASE WHEN {_left} THEN x ELSE -n END"),
        "appLeft": ("i", lambda r: EI["proj"](EI["appLeft"](lambda v: v)(_e(r))), f"CASE WHEN {_left} THEN x ELSE n END"), "appRight": ("i", lambda r: EI["proj"](EI["appRight"](lambda v: v)(_e(r))), f"CASE WHEN {_left} THEN x ELSE n END"),
        "partition_1": ("ai", lambda r: EI["partition"](F.array(_e(r), EI["INL"](r.n)))["_1"], f"CASE WHEN {_left} THEN [x, n] ELSE [n] END"), "partition_2": ("ai", lambda r: EI["partition"](F.array(_e(r), EI["INR"](r.x)))["_2"], f"CASE WHEN {_left} THEN [x] ELSE [n, x] END"),
    },
)

_R = {
    "ALL": (lambda r: RA["ALL"](), "true"), "AT_LEAST": (lambda r: RA["AT_LEAST"](r.a), "x >= a"), "AT_MOST": (lambda r: RA["AT_MOST"](r.a), "x <= a"), "GREATER_THAN": (lambda r: RA["GREATER_THAN"](r.a), "x > a"), "LESS_THAN": (lambda r: RA["LESS_THAN"](r.a), "x < a"), "CLOSED": (lambda r: RA["CLOSED"](r.a, r.b), "x >= a AND x <= b"),
    "CLOSED_OPEN": (lambda r: RA["CLOSED_OPEN"](r.a, r.b), "x >= a AND x < b"), "OPEN": (lambda r: RA["OPEN"](r.a, r.b), "x > a AND x < b"), "OPEN_CLOSED": (lambda r: RA["OPEN_CLOSED"](r.a, r.b), "x > a AND x <= b"), "POINT": (lambda r: RA["POINT"](r.a), "x = a"),
}
_two = lambda r: F.array(RA["CLOSED"](r.a, r.b), RA["CLOSED_OPEN"](r.c, r.c + 3))
_union = "list_sort(list_distinct(list_concat(range(a, b + 1), range(c, c + 3))))"
_spans = lambda c, f: F.transform(c, f)
_touching = "(c <= b AND c + 3 >= a)"
wide(
    "lib_range", "part", "p_partkey", [("a", "CAST(p_size % 10 AS INT)"), ("b", "CAST(p_size % 10 + p_partkey % 4 AS INT)"), ("c", "CAST(p_partkey % 16 AS INT)"), ("x", "CAST(p_partkey % 13 AS INT)")],
    {f"contains_{k}": ("b", (lambda f: lambda r: RA["contains"](f(r), r.x))(f), sql) for k, (f, sql) in _R.items()}
    | {
        "flatten": ("ai", lambda r: RA["flatten"](_two(r)), "list_concat(range(a, b + 1), range(c, c + 3))"), "toList": ("ai", lambda r: RA["toList"](RA["discreteSetOf"](_two(r))), _union), "toBag": ("ai", lambda r: RA["toBag"](_two(r)), _union),
        "set_contains": ("b", lambda r: T["$csContains"](RA["CONTINUOUS_SET"](RA["continuousSetOf"](_two(r))), r.x), "(x >= a AND x <= b) OR (x >= c AND x < c + 3)"), "ds_contains": ("b", lambda r: T["$dsContains"](RA["DISCRETE_SET"](RA["discreteSetOf"](_two(r))), r.x), "(x >= a AND x <= b) OR (x >= c AND x < c + 3)"),
        "continuous_size": ("i", lambda r: F.size(RA["ranges"](RA["continuousSetOf"](_two(r)))), f"CASE WHEN {_touching} THEN 1 ELSE 2 END"), "discrete_size": ("i", lambda r: F.size(T["$dsRanges"](RA["discreteSetOf"](_two(r)))), "CASE WHEN c <= b + 1 AND c + 2 >= a - 1 THEN 1 ELSE 2 END"),
        "complement": ("b", lambda r: RA["setContains"](RA["complement"](RA["continuousSetOf"](_two(r))), r.x), "NOT ((x >= a AND x <= b) OR (x >= c AND x < c + 3))"), "ds_complement": ("b", lambda r: RA["setContains"](T["$dsComplement"](RA["discreteSetOf"](_two(r))), r.x), "NOT ((x >= a AND x <= b) OR (x >= c AND x < c + 3))"),
    },
)

# -- dates, times, variants

DA, TI, VA = L["Date"], L["Time"], L["Variant"]
_d = lambda r: F.struct(r.ts.alias("ts"), lit(0).alias("offset"))
_stamp = "strftime(ts, '%a %b %d %H:%M:%S %Y')"
wide(
    "lib_date", "orders", "o_orderkey", [("ts", "CAST(o_orderdate + INTERVAL 4321 SECOND AS TIMESTAMP)", "o_orderdate + INTERVAL 4321 SECOND"), ("us", "unix_micros(CAST(o_orderdate AS TIMESTAMP))", "epoch_us(o_orderdate)")],
    {
        "compare": ("i", lambda r: DA["compare"](_d(r), DA["date"](lit(1995), lit(6), lit(1), lit(0), lit(0), lit(0))), compare_sql("ts", "TIMESTAMP '1995-06-01'")), "date": ("i", lambda r: DA["year"](DA["date"](F.year(r.ts), lit(2), lit(28), lit(23), lit(59), lit(58))), "year(ts)"), "day": ("i", lambda r: DA["day"](_d(r)), "day(ts)"), "hour": ("i", lambda r: DA["hour"](_d(r)), "hour(ts)"), "minute": ("i", lambda r: DA["minute"](_d(r)), "minute(ts)"),
        "second": ("i", lambda r: DA["second"](_d(r)), "second(ts)"), "year": ("i", lambda r: DA["year"](_d(r)), "year(ts)"), "yearDay": ("i", lambda r: DA["yearDay"](_d(r)), "dayofyear(ts) - 1"), "month": ("s", lambda r: DA["month"](_d(r)), "strftime(ts, '%b')"), "weekDay": ("s", lambda r: DA["weekDay"](_d(r)), "strftime(ts, '%a')"), "isDst": ("b", lambda r: DA["isDst"](_d(r)), "NULL"),
        "fmt": ("s", lambda r: DA["fmt"]("%Y-%m-%d %H.%M.%S %y %b %B %a %A %j %I %p %%", _d(r)), "strftime(ts, '%Y-%m-%d %H.%M.%S %y %b %B %a %A %j %I %p %%')"), "toString": ("s", lambda r: DA["toString"](_d(r)), _stamp), "fromString": ("s", lambda r: DA["toString"](DA["fromString"](DA["toString"](_d(r)))), _stamp), "scan": ("s", lambda r: DA["scan"](F.concat(DA["toString"](_d(r)), lit(";")))["_2"], "';'"),
        "fromTimeUniv": ("i", lambda r: DA["year"](DA["fromTimeUniv"](r.us * 1000)), "year(make_timestamp(us))"), "fromTimeLocal": ("i", lambda r: DA["day"](DA["fromTimeLocal"](r.us * 1000)), "day(make_timestamp(us))"), "toTime": ("i", lambda r: DA["toTime"](_d(r)), "epoch_us(ts) * 1000"), "localOffset": ("i", lambda r: DA["localOffset"](), "0"),
    }
    | {m: ("b", (lambda m: lambda r: DA["month"](_d(r)) == DA[m]())(m), f"strftime(ts, '%b') = '{m}'") for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")}
    | {m: ("b", (lambda m: lambda r: DA["weekDay"](_d(r)) == DA[m]())(m), f"strftime(ts, '%a') = '{m}'") for m in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")},
)

_units = {"Nanoseconds": 1, "Microseconds": 10**3, "Milliseconds": 10**6, "Seconds": 10**9}
wide(
    "lib_time", "orders", "o_orderkey", [("t", "CAST(o_custkey * 1234567890 - 500000000000 AS BIGINT)"), ("u", "CAST(o_orderkey * 1000000 AS BIGINT)"), ("s", "concat(CASE WHEN o_custkey % 2 = 0 THEN '~' ELSE '' END, CAST(o_custkey AS STRING), '.5')")],
    comparisons(TI, "", lambda r: r.t, lambda r: r.u, "t", "u")
    | {f"from{k}": ("i", (lambda k: lambda r: TI[f"from{k}"](r.u % 1000))(k), f"(u % 1000) * {n}") for k, n in _units.items()}
    | {f"to{k}": ("i", (lambda k: lambda r: TI[f"to{k}"](r.t))(k), f"(t - ((t % {n}) + {n}) % {n}) // {n}") for k, n in _units.items()}
    | {
        "plus": ("i", lambda r: TI["+"](r.t, r.u), "t + u"), "minus": ("i", lambda r: TI["-"](r.t, r.u), "t - u"), "compare": ("i", lambda r: TI["compare"](r.t, r.u), compare_sql("t", "u")), "fromReal": ("i", lambda r: TI["fromReal"](lit(1.5)), "1500000000"), "toReal": ("d", lambda r: TI["toReal"](r.u), "u / 1e9"), "fromString": ("i", lambda r: TI["fromString"](r.s), "replace(s, '~', '-')::DOUBLE * 1e9"),
        "scan": ("s", lambda r: TI["scan"](F.concat(r.s, lit(" z")))["_2"], "' z'"), "now": ("b", lambda r: TI["now"]() > r.u, "true"), "zeroTime": ("i", lambda r: TI["zeroTime"](), "0"), "fmt": ("s", lambda r: TI["fmt"](1, r.u * 100), "format('{:.1f}', (u // 10000000) / 1.0)".replace("(u // 10000000) / 1.0", "u / 1e7")), "toString": ("s", lambda r: TI["toString"](r.u), "format('{:.3f}', u / 1e9)"),
    },
)

_p = lambda tag, x: f"""'{{"tag":"{tag}","value":' || {x} || '}}'"""
wide(
    "lib_variant", "part", "p_partkey", [("x", "CAST(p_size AS INT)"), ("s", "p_brand"), ("c", "p_size % 2 = 0")],
    {k: ("s", (lambda k: lambda r: VA["print"](VA[k](r.x)))(k), _p(k, "x")) for k in ("INT", "CONSTANT", "VARIANT_SOME")}
    | {k: ("s", (lambda k: lambda r: VA["print"](VA[k](r.s)))(k), _p(k, "'\"' || s || '\"'")) for k in ("STRING", "CHAR")}
    | {k: ("s", (lambda k: lambda r: VA["print"](VA[k](F.array(r.x, r.x + 1))))(k), _p(k, "'[' || x || ',' || (x + 1) || ']'")) for k in ("LIST", "BAG", "VECTOR")}
    | {
        "BOOL": ("s", lambda r: VA["print"](VA["BOOL"](r.c)), _p("BOOL", "CASE WHEN c THEN 'true' ELSE 'false' END")), "REAL": ("s", lambda r: VA["print"](VA["REAL"](r.x.cast("double") + lit(0.5))), _p("REAL", "x || '.5'")), "RECORD": ("s", lambda r: VA["print"](VA["RECORD"](F.struct(r.x.alias("a")))), _p("RECORD", "'{\"a\":' || x || '}'")),
        "CONSTRUCT": ("s", lambda r: VA["print"](VA["CONSTRUCT"](r.s, r.x)), "'{\"name\":\"' || s || '\",\"tag\":\"CONSTRUCT\",\"value\":' || x || '}'"), "UNIT": ("s", lambda r: VA["print"](VA["UNIT"]()), "'{\"tag\":\"UNIT\"}'"), "VARIANT_NONE": ("s", lambda r: VA["print"](VA["VARIANT_NONE"]()), "'{\"tag\":\"VARIANT_NONE\"}'"), "parse": ("i", lambda r: F.variant_get(VA["parse"](F.concat(lit('{"k":'), r.x, lit("}"))), "$.k", "int"), "x"),
    },
)
