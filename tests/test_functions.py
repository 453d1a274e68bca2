"""The function library, a row a function: (structure.function, arguments, expected)."""

import math

import pytest
from pyspark.sql import functions as F

from lumenrel.functions import library, lookup

i = s = r = lambda x: F.lit(x)  # noqa: E731  columns need a session, so they are made inside the tests


def arr(*xs, kind="int"):
    return F.array(*map(F.lit, xs)).cast(f"array<{kind}>")


def dec(x):
    return F.lit(x).cast("decimal(20,4)")


def cases():
    return [
        ("Int.div", (i(-7), i(2)), -4), ("Int.mod", (i(-7), i(2)), 1), ("Int.mod", (i(7), i(-2)), -1), ("Int.quot", (i(-7), i(2)), -3), ("Int.rem", (i(-7), i(2)), -1), ("Int.div", (i(7), i(-2)), -4),
        ("Int.toString", (i(-5),), "~5"), ("Int.fmt", ("HEX", i(-255)), "~FF"), ("Int.fromString", (s(" ~12x"),), -12), ("Int.fromString", (s("x"),), None), ("Int.sameSign", (i(-1), i(-9)), True), ("Int.compare", (i(1), i(2)), -1),
        ("Int.min", (i(1), i(2)), 1), ("Int.max", (i(1), i(2)), 2), ("Int.sign", (i(-4),), -1), ("Int.abs", (i(-4),), 4), ("Int.maxInt", (), 2147483647),
        ("String.size", (s("abc"),), 3), ("String.substring", (s("hello"), i(1), i(3)), "ell"), ("String.extract", (s("hello"), i(2)), "llo"), ("String.sub", (s("abc"), i(1)), "b"), ("String.isPrefix", (s("he"), s("hello")), True),
        ("String.isSuffix", (s("lo"), s("hello")), True), ("String.isSubstring", (s("ell"), s("hello")), True), ("String.concatWith", (s(","), arr("a", "b", kind="string")), "a,b"), ("String.explode", (s("abc"),), ["a", "b", "c"]),
        ("String.fields", (lambda c: c == ",", s("a,,b")), ["a", "", "b"]), ("String.tokens", (lambda c: c == ",", s("a,,b,")), ["a", "b"]), ("String.map", (F.upper, s("ab")), "AB"), ("String.translate", (lambda c: F.concat(c, c), s("ab")), "aabb"),
        ("String.compare", (s("a"), s("b")), -1), ("String.toString", (s('a"\n'),), 'a\\"\\n'), ("String.fromString", (s("a\\n"),), "a\n"), ("String.implode", (arr("a", "b", kind="string"),), "ab"), ("String.^", (s("a"), s("b")), "ab"),
        ("StringCvt.padLeft", (s("*"), 5, s("abc")), "**abc"), ("StringCvt.padRight", (s("*"), 2, s("abc")), "abc"), ("StringCvt.takel", (lambda c: c.rlike("[0-9]"), s("12a3")), "12"), ("StringCvt.dropl", (lambda c: c.rlike("[0-9]"), s("12a3")), "a3"),
        ("Char.isAlpha", (s("x"),), True), ("Char.isDigit", (s("x"),), False), ("Char.ord", (s("A"),), 65), ("Char.chr", (i(66),), "B"), ("Char.succ", (s("a"),), "b"), ("Char.pred", (s("b"),), "a"), ("Char.isPunct", (s("!"),), True), ("Char.toUpper", (s("q"),), "Q"),
        ("Char.contains", (s("abc"), s("b")), True), ("Char.notContains", (s("abc"), s("b")), False), ("Char.fromInt", (i(300),), None), ("Char.compare", (s("a"), s("b")), -1),
        ("Real.ceil", (r(1.2),), 2), ("Real.floor", (r(-1.2),), -2), ("Real.round", (r(2.5),), 2), ("Real.trunc", (r(-1.7),), -1), ("Real./", (r(1.0), r(0.0)), math.inf), ("Real.<", (r(math.nan), r(1.0)), False), ("Real.max", (r(math.nan), r(1.0)), 1.0),
        ("Real.toString", (r(-2.0),), "~2"), ("Real.fromString", (s("~1.5e2z"),), -150.0), ("Real.sign", (r(-3.0),), -1), ("Real.isNan", (r(math.nan),), True), ("Real.signBit", (r(-0.0),), True), ("Real.unordered", (r(math.nan), r(0.0)), True), ("Real.realMod", (r(1.5),), 0.5),
        ("Math.ln", (r(0.0),), -math.inf), ("Math.sqrt", (r(9.0),), 3.0), ("Math.pow", (r(2.0), r(10.0)), 1024.0), ("Math.atan2", (r(0.0), r(1.0)), 0.0), ("Math.pi", (), math.pi),
        ("Word.+", (F.lit("18446744073709551615").cast("decimal(20,0)"), i(2)), 1), ("Word.notb", (i(0),), 2**64 - 1), ("Word.<<", (i(1), i(64)), 0), ("Word.<<", (i(1), i(63)), 2**63), ("Word.andb", (i(12), i(10)), 8), ("Word.*", (F.lit("4294967296").cast("decimal(20,0)"), F.lit("4294967297").cast("decimal(20,0)")), 2**32),
        ("Word.toString", (i(255),), "FF"), ("Word.fromString", (s("0wxff"),), 255), ("Word.-", (i(0), i(1)), 2**64 - 1), (("Word.>>"), (i(8), i(2)), 2), ("Word.~", (i(1),), 2**64 - 1),
        ("Word.toIntX", (F.lit(str(2**64 - 1)).cast("decimal(20,0)"),), -1), ("Word.toIntX", (F.lit("2167466784").cast("decimal(20,0)"),), 2167466784), ("Word.toIntX", (F.lit(str(2**64 - 2**40)).cast("decimal(20,0)"),), -(2**40)),
        ("Decimal.floor", (dec("-1.5"),), -2), ("Decimal.round", (dec("2.5"),), 2), ("Decimal.toString", (dec("-1.50"),), "~1.5"), ("Decimal.sign", (dec("-2"),), -1), ("Decimal.trunc", (dec("-1.9"),), -1),
        ("List.hd", (arr(4, 5),), 4), ("List.tl", (arr(4, 5),), [5]), ("List.last", (arr(4, 5),), 5), ("List.nth", (arr(4, 5), i(1)), 5), ("List.take", (arr(4, 5, 6), i(2)), [4, 5]), ("List.drop", (arr(4, 5, 6), i(2)), [6]), ("List.rev", (arr(1, 2),), [2, 1]),
        ("List.map", (lambda x: x + 1, arr(1, 2)), [2, 3]), ("List.filter", (lambda x: x > 1, arr(1, 2)), [2]), ("List.foldl", (lambda x, a: x - a, F.lit(0), arr(1, 2, 3)), 2), ("List.foldr", (lambda x, a: x - a, F.lit(0), arr(1, 2, 3)), 2), ("List.exists", (lambda x: x > 1, arr(1, 2)), True), ("List.all", (lambda x: x > 1, arr(1, 2)), False),
        ("List.concat", (F.array(arr(1), arr(2, 3)),), [1, 2, 3]), ("List.tabulate", (i(3), lambda x: x * x), [0, 1, 4]), ("List.tabulate", (i(0), lambda x: x * x), []), ("List.find", (lambda x: x > 1, arr(1, 2, 3)), 2), ("List.mapi", (lambda k, x: k + x, arr(5, 5)), [5, 6]), ("List.revAppend", (arr(1, 2), arr(3)), [2, 1, 3]),
        ("List.except", (F.array(arr(1, 2, 2, 3), arr(2)),), [1, 2, 3]), ("List.intersect", (F.array(arr(3, 2, 1, 3, 2), arr(2, 3, 2, 4)),), [3, 2, 2]), ("List.collate", (lambda a, b: F.when(a < b, -1).when(a == b, 0).otherwise(1), arr(1, 2), arr(1, 3)), -1), ("List.null", (arr(),), True), ("List.elem", (i(1), arr(1)), True), ("List.only", (arr(7),), 7),
        ("Vector.sub", (arr(1, 2), i(0)), 1), ("Vector.update", (arr(1, 2), i(1), i(9)), [1, 9]), ("Vector.foldli", (lambda k, x, a: a + k * x, F.lit(0), arr(5, 6)), 6), ("Vector.length", (arr(1, 2),), 2),
        ("ListPair.map", (lambda a, b: a + b, arr(1, 2, 3), arr(10, 20)), [11, 22]), ("ListPair.allEq", (lambda a, b: a == b, arr(1), arr(1, 2)), False), ("ListPair.foldl", (lambda a, b, c: a * b + c, F.lit(0), arr(1, 2), arr(3, 4)), 11), ("ListPair.exists", (lambda a, b: a == b, arr(1, 2), arr(2, 2)), True),
        ("Relational.sum", (arr(1, 2),), 3), ("Relational.max", (arr(1, 5, 2),), 5), ("Relational.minBy", (lambda x: x % 2, arr(3, 2, 4)), 2), ("Relational.maxBy", (lambda x: x % 2, arr(2, 3, 5)), 3), ("Relational.count", (arr(1, 2),), 2), ("Relational.nonEmpty", (arr(),), False),
        ("Option.getOpt", (F.lit(None).cast("int"), i(3)), 3), ("Option.isSome", (i(3),), True), ("Option.map", (lambda x: x + 1, F.lit(None).cast("int")), None), ("Option.filter", (lambda x: x > 5, i(3)), None), ("Option.valOf", (i(3),), 3),
        ("Bool.implies", (F.lit(True), F.lit(False)), False), ("Bool.not", (F.lit(True),), False), ("Bool.fromString", (s(" TRUEx"),), True), ("Bool.toString", (F.lit(False),), "false"),
        ("Time.fromSeconds", (i(2),), 2_000_000_000), ("Time.toMilliseconds", (F.lit(1_500_000_000),), 1500), ("Time.toString", (F.lit(1_500_000_000),), "1.500"), ("Time.toSeconds", (F.lit(-1),), -1),
    ]


def test_library(spark):
    rows = cases()
    columns = [lookup(n)(*args).alias(f"c{k}") for k, (n, args, _) in enumerate(rows)]
    got = spark.range(1).select(*columns).first()
    wrong = [(n, g, want) for (n, _, want), g in zip(rows, got, strict=True) if not (g == want or (isinstance(want, float) and g is not None and abs(float(g) - want) < 1e-9) or (g is not None and want is not None and not isinstance(want, (str, list, bool)) and not isinstance(g, (str, list)) and float(g) == float(want)))]
    assert not wrong, wrong


def test_errors(spark):
    for name, args, error in [
        ("List.hd", (arr(),), "Empty"), ("List.nth", (arr(1), i(3)), "Subscript"), ("Int.div", (i(1), i(0)), "Div"), ("String.substring", (s("a"), i(1), i(4)), "Subscript"), ("Option.valOf", (F.lit(None).cast("int"),), "Option"),
        ("ListPair.zipEq", (arr(1), arr(1, 2)), "UnequalLengths"), ("Real.compare", (r(math.nan), r(1.0)), "Unordered"), ("Char.chr", (i(256),), "Chr"), ("List.tabulate", (i(-1), lambda x: x), "Size"), ("Real.sign", (r(math.nan),), "Domain"),
    ]:
        with pytest.raises(Exception, match=error):
            spark.range(1).select(lookup(name)(*args).alias("x")).collect()


def test_ranges_and_either(spark):
    R, E = library["Range"], library["Either"]
    row = spark.range(1).select(
        R["contains"](R["CLOSED_OPEN"](i(1), i(4)), i(4)).alias("a"), R["contains"](R["AT_LEAST"](i(3)), i(3)).alias("b"), R["flatten"](F.array(R["OPEN"](i(1), i(4)), R["POINT"](i(9)))).alias("c"),
        E["isLeft"](E["INL"](i(1))).alias("d"), E["proj"](E["INR"](i(5))).alias("e"), E["asLeft"](E["INR"](i(5))).alias("f"), E["map"](lambda x: x + 1, lambda y: y * 2)(E["INR"](i(5)))["right"].alias("g"),
    ).first()
    assert tuple(row) == (False, True, [2, 3, 9], True, 5, None, 10)


def test_dates(spark):
    D = library["Date"]
    d = D["date"](i(2024), i(2), i(29), i(13), i(5), i(7))
    row = spark.range(1).select(D["year"](d), D["month"](d), D["weekDay"](d), D["yearDay"](d), D["fmt"]("%Y-%m-%d at %H:%M", d), D["toString"](d), D["toTime"](D["fromTimeUniv"](F.lit(5_000_000_000)))).first()
    assert tuple(row) == (2024, "Feb", "Thu", 59, "2024-02-29 at 13:05", "Thu Feb 29 13:05:07 2024", 5_000_000_000)
