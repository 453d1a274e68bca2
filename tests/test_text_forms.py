"""Patterns, declarations, recursion and sub-queries of the text form."""

import pytest

from lumenrel.plans import errors
from lumenrel.plans.errors import Error
from lumenrel.plans.text import Session
from lumenrel.sources.files import Scott


@pytest.fixture
def session(spark):
    s = Scott(spark)
    return Session(spark, emps=s.emps, depts=s.depts)


def result(session, source):
    got = session.run(source)
    return got.collect() if hasattr(got, "collect") else got


PATTERNS = [
    ("from (a, b) in [(1, 40), (2, 50)] yield a + b", [41, 52]),
    ("from (a, 50) in [(1, 40), (2, 50)] yield a", [2]),
    ("from [a, b] in [[1], [2, 3], [4, 5, 6]] yield a * b", [6]),
    ("from h :: t in [[7, 8], []] yield h + List.length t", [8]),
    ("from SOME k in [SOME 4, NONE, SOME 6] yield k", [4, 6]),
    ("from whole as (a, _) in [(3, 1), (9, 2)] where a > 5 yield #2 whole", [2]),
    ("from (a : int, b) in [(1, 2)], 2 in [b, b + 1, b] yield a", [1, 1]),
    ("from i in [4, 5, 6] yield case (i, i mod 2) of (5, _) => \"five\" | (_, 0) => \"even\" | _ => \"odd\"", ["even", "five", "even"]),
    ("from l in [[1, 2, 3], [4], []] yield case l of [] => 0 | [x] => x | x :: y :: _ => x * 10 + y", [12, 4, 0]),
    ("from i in [1, 2] yield (fn 1 => 10 | n => n) i", [10, 2]),
    ("let val (a, {b, c = [d]}) = (1, {b = 2, c = [3]}) in a + b + d end", 6),
    ("op + (3, 4)", 7),
    ("[@note \"ignored\"] 5", 5),
]


@pytest.mark.parametrize(("source", "want"), PATTERNS, ids=[p[0][:40] for p in PATTERNS])
def test_patterns(session, source, want):
    assert result(session, source) == want


def test_record_patterns(session):
    assert sorted(result(session, 'from {ename, deptno = 10, ...} in emps yield ename')) == ["CLARK", "KING", "MILLER"]
    assert sorted(result(session, "from d in depts join {deptno, sal, ename = n, ...} in emps on deptno = d.deptno andalso sal > 2900.0 yield n")) == ["FORD", "JONES", "KING", "SCOTT"]


def test_functions(session):
    run = lambda s: result(session, s)
    assert run("fun power (_, 0) = 1 | power (b, n) = b * power (b, n - 1); power (3, 4)") == 81
    assert run("fun even 0 = true | even n = odd (n - 1) and odd 0 = false | odd n = even (n - 1); even 10") is True
    assert run("val rec total = fn [] => 0 | h :: t => h + total t; total [4, 5, 6]") == 15
    assert run("fun scale k x = k * x; val twice = scale 2; from i in [5, 6] yield twice i") == [10, 12]
    assert run("fun steps (1 : int) : int = 0 | steps n = 1 + steps (if n mod 2 = 0 then n div 2 else 3 * n + 1); from i in [1, 6, 7] yield steps i") == [0, 8, 16]
    with pytest.raises(Error, match="type of its result"):
        run("fun forever n = forever (n + 1); from i in [1] yield forever i")


def test_declarations(session):
    run = lambda s: result(session, s)
    got = run("datatype shape = DISC of real | BOX of real * real | DOT; from s in [DISC 2.0, BOX (2.0, 3.0), DOT] yield case s of DISC r => r * r | BOX (w, h) => w * h | DOT => 0.0")
    assert got == [4.0, 6.0, 0.0]
    assert run("from BOX (w, _) in [DISC 1.0, BOX (7.0, 1.0)] yield w") == [7.0]
    assert run("type small = int check i => i < 10; type digit = small check i => i >= 0; from i in [5, 12, ~3] yield i asOpt digit") == [5, None, None]
    with pytest.raises(Exception, match="Check digit"):
        run("from i in [12] yield i as digit")
    assert run("over show; val inst show = fn (i : int) => i + 1; val inst show = fn (s : string) => String.size s; show 4") == 5
    assert run('from s in ["abc"] yield show s') == [3]
    with pytest.raises(Error, match="no instance"):
        run("show 1.5")
    assert run("signature S = sig val f : int -> int end; 3") == 3
    assert run("val (n : typeof 1) = 3; n") == 3


def test_errors(session):
    for source, kind in (("raise Fail \"no\"", errors.Fail), ("case 3 of 4 => 5", errors.Match), ("val (1, x) = (2, 3)", errors.Bind), ("1 div 0", errors.Div), ("2000000000 + 2000000000", errors.Overflow)):
        with pytest.raises(kind):
            session.run(source)
    with pytest.raises(Exception, match="Empty"):
        result(session, "from i in [1, 2] yield if i = 1 then i else raise Empty")
    assert session.run("type_string [1]") == "int list"
    assert session.run("type_string (1, \"a\")") == "int * string"


def test_sub_queries(session):
    run = lambda s: {tuple(r) for r in result(session, s)}
    head = "from d in depts yield {d.deptno, n = "
    counts = {(10, 3), (20, 5), (30, 6), (40, 0)}
    assert run(head + "count (from e in emps where e.deptno = d.deptno)}") == counts
    assert run(head + "from e in emps where e.deptno = d.deptno compute count over ()}") == counts
    assert run(head + "(from e in emps where e.deptno = d.deptno yield e.empno into count)}") == counts
    assert run(head + "exists (from e in emps where e.deptno = d.deptno andalso e.sal > 2900.0)}") == {(10, True), (20, True), (30, False), (40, False)}
    assert run("from d in depts, e in (from e in emps where e.deptno = d.deptno order DESC e.sal take 1) yield {d.deptno, e.ename}") >= {(10, "KING"), (30, "BLAKE")}
    assert run("from d in depts left join e in (from e in emps where e.deptno = d.deptno andalso e.sal > 2900.0) on e.job <> \"ANALYST\" yield {d.deptno, e.ename}") == {(10, "KING"), (20, "JONES"), (30, None), (40, None)}
    assert sorted(result(session, "from d in depts where d.deptno elem (from e in emps where e.sal < 1000.0 yield e.deptno) orelse d.deptno = 40 yield d.deptno")) == [20, 30, 40]
    assert sorted(result(session, "from d in depts where d.deptno notelem (from e in emps yield e.deptno) yield d.deptno")) == [40]
    assert result(session, "from i in [1, 2] yield (from j in [3, 1, 2] where j > i order DESC j)") == [[3, 2], [3]]
    assert result(session, "count emps") == 14
    assert result(session, "from i in [4, 5] into sum") == 9
    assert sorted(result(session, "from e in emps where e.sal = (from f in emps compute max over f.sal) yield e.ename")) == ["KING"]


def test_scans_without_a_source(session):
    run = lambda s: [tuple(r) if hasattr(r, "asDict") else r for r in result(session, s)]
    assert run("from x where x > 3 andalso x < 7") == [4, 5, 6]
    assert run("from x, y where x >= 0 andalso x <= 2 andalso y = x * 2 + 1 where y > 1") == [(1, 3), (2, 5)]
    assert run("from b : bool") == [False, True]
    assert run('from s : string where String.isPrefix (s, "abc") yield String.size s') == [0, 1, 2, 3]
    assert run("from x where x elem [9, 8] orelse x = 2 order x") == [2, 8, 9]
    assert run("from d where exists n : string where (d, n) elem (from e in depts yield {e.deptno, e.dname}) andalso n <> \"SALES\"") == [10, 20, 40]
    assert run("val next = [(1, 2), (2, 3), (3, 1), (5, 6)]; fun step (a, b) = (a, b) elem next; "
               "fun path (a, b) = step (a, b) orelse (exists c where path (a, c) andalso step (c, b)); from b where path (2, b) order b") == [1, 2, 3]
    assert run("from x where x > 0 andalso x < 9 andalso x mod 4 = 1 andalso Int.abs x <> 1") == [5]
    with pytest.raises(Error, match="enumerate"):
        run("from x where x > 3")
