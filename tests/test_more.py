from pyspark.sql import functions as F

from lumenrel.functions import library
from lumenrel.plans import pretty as P

R = library["Range"]


def texts(s):
    return [P.text(x) for x in s.split()]


def test_pretty_printer():
    assert P.render(80, P.hsep(texts("a b c"))) == "a b c" and P.render(80, P.vsep(texts("a b"))) == "a\nb"
    assert P.render(80, P.sep(texts("a b c"))) == "a b c" and P.render(3, P.sep(texts("aa bb"))) == "aa\nbb"
    assert P.render(5, P.fill_sep(texts("a b c d"))) == "a b c\nd"
    assert P.render(80, P.hcat(P.punctuate(P.text(", "), texts("a b c")))) == "a, b, c"
    assert P.render(80, P.enclose_sep(P.text("["), P.text("]"), P.text(","), texts("a b c"))) == "[a, b, c]"
    assert P.render(4, P.align(P.pack(P.empty, texts("1, 2, 3, 4, 5")))) == "1,2,\n3,4,\n5"
    record = lambda s: P.group(P.brackets(P.fill_sep(texts(s))))
    records = [P.beside(record("a b"), P.text(",")), P.beside(record("c d"), P.text(",")), record("e f")]
    assert P.render(9, P.align(P.pack(P.empty, records))) == "[a b],\n[c d],\n[e f]"
    assert P.render(9, P.align(P.fill_cat(records))) == "[a b],[c\nd],[e f]"
    assert P.render(80, P.nest(2, P.vsep(texts("a b")))) == "a\n  b" and P.render(80, P.beside(P.text("xx"), P.hang(1, P.vsep(texts("a b"))))) == "xxa\n   b"
    assert P.render(80, P.indent(2, P.vsep(texts("a b")))) == "  a\n  b" and P.render(80, P.group(P.beside(P.text("a"), P.beside(P.hard_line, P.text("b"))))) == "a\nb"


def test_range_sets(spark):
    lit = F.lit
    c = F.array(R["CLOSED"](lit(5), lit(10)), R["CLOSED"](lit(1), lit(3)), R["CLOSED"](lit(3), lit(6)))
    apart = F.array(R["CLOSED"](lit(1), lit(3)), R["OPEN"](lit(3), lit(4)), R["OPEN"](lit(7), lit(9)), R["OPEN"](lit(9), lit(12)))
    row = spark.range(1).select(
        R["continuousSetOf"](c), R["discreteSetOf"](F.array(R["OPEN"](lit(0), lit(4)), R["CLOSED"](lit(4), lit(6)))), R["continuousSetOf"](apart), R["complement"](R["continuousSetOf"](apart)), R["toList"](R["discreteSetOf"](c)),
    ).first()
    short = lambda rs: [(r.kind, r.lo, r.hi) for r in rs]
    assert short(row[0]) == [("CLOSED", 1, 10)] and short(row[1]) == [("CLOSED", 1, 6)]
    assert short(row[2]) == [("CLOSED_OPEN", 1, 4), ("OPEN", 7, 9), ("OPEN", 9, 12)]
    assert short(row[3]) == [("LESS_THAN", None, 1), ("CLOSED", 4, 7), ("POINT", 9, 9), ("AT_LEAST", 12, None)]
    assert row[4] == list(range(1, 11))


def test_scanners_and_formats(spark):
    lit = F.lit
    row = spark.range(1).select(
        library["Int"]["scan"](lit(" ~12x")), library["Real"]["scan"](lit("1.5e2 rest")), library["Bool"]["scan"](lit("x")), library["Word"]["scan"](lit("0wxFF,")),
        library["Real"]["fmt"](("FIX", 2), lit(-1.239)), library["Real"]["fmt"](("SCI", 2), lit(12345.0)), library["Top-level"]["op elem"](lit(1), F.array(lit(1))),
    ).first()
    assert tuple(row[0]) == (-12, "x") and tuple(row[1]) == (150.0, " rest") and row[2] is None and (int(row[3][0]), row[3][1]) == (255, ",")
    assert row[4:] == ("~1.24", "1.23E4", True)


def test_every_structure_is_there():
    sizes = {"Bag": 24, "List": 30, "ListPair": 14, "Vector": 20, "Option": 12, "Either": 13, "Range": 20, "String": 31, "StringCvt": 15, "Char": 37, "Int": 29, "Word": 37, "Real": 49, "Math": 17, "Decimal": 34, "Date": 38, "Time": 23, "Bool": 11, "Order": 3, "Fn": 10, "General": 5, "Variant": 16, "PP": 28, "Datalog": 3}
    assert {k: len(library[k]) >= n for k, n in sizes.items()} == dict.fromkeys(sizes, True)
