"""The text front end on the sample database and on literals."""

import pytest

from lumenrel.plans.errors import Error
from lumenrel.plans.text import Session
from lumenrel.sources.files import Scott


@pytest.fixture(scope="module")
def session(spark):
    s = Scott(spark)
    return Session(spark, emps=s.emps, depts=s.depts, salgrades=s.salgrades)


def rows(q):
    df = q.frame()
    return [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]


CASES = [
    ("from i in [1, 2, 5..7] where i mod 2 = 1 yield i * 10", [10, 50, 70]),
    ("from i in [3, 1, 2] order DESC i take 2", [3, 2]),
    ("from i in [3, 1, 2, 3] distinct skip 1", [1, 2]),
    ("from i in [1, 2, 3] union [9]", [1, 2, 3, 9]),
    ("from i in [3, 2, 1, 3, 2] intersect [2, 3, 2, 4]", [3, 2, 2]),
    ("from i in [1, 2, 3, 4, 5, 1, 5, 1, 2] except [2, 4]", [1, 3, 5, 1, 5, 1, 2]),
    ("from i in [1, 2], j in [10, 20] where i + j > 11 yield i * j", [20, 20, 40]),
    ("from i in [1, 2] yield if i = 1 then \"one\" else \"more\"", ["one", "more"]),
    ("from i in [1, 2, 3] yield case i of 1 => \"a\" | 2 => \"b\" | _ => \"c\"", ["a", "b", "c"]),
    ("let val k = 3 fun twice x = x * 2 in from i in [1, k] yield twice i end", [2, 6]),
    ("from i in [~1, 5] yield (fn x => x div 2) i", [-1, 2]),
    ("from s in [\"ab\", \"b\"] where String.isPrefix (\"a\", s) yield String.size s", [2]),
    ("from i in [1, 2, 3] where i elem [1, 3]", [1, 3]),
    ("from i in [5, 6, 7] where ordinal < 2 yield i", [5, 6]),
    ("from i in [1, 2, 3] into (fn q => q)", [1, 2, 3]),
    ("from x in [1, 2] yieldAll [x, x * 10]", [1, 10, 2, 20]),
    ("from i in [1, 2] through j in (fn q => q) yield j + 1", [2, 3]),
    ("from i in [1, 2] join j in [2, 3] on i = j yield i", [2]),
    ("from i in [1, 2] left join j in [2, 3] on i = j yield {i, there = case j of SOME k => k | NONE => 0}", None),
]


@pytest.mark.parametrize(("source", "want"), CASES, ids=[c[0][:40] for c in CASES])
def test_literals(session, source, want):
    got = session.run(source)
    if want is not None:
        assert got.collect() == want
    else:
        assert sorted(rows(got)) == [(1, 0), (2, 2)]


def test_joins_and_groups(session):
    q = session.run("""
        from e in emps, d in depts where e.deptno = d.deptno andalso e.sal > 1000.0
          group d.dname compute {n = count over (), pay = sum over e.sal, 1 + max over e.sal * 2}
          order dname""".replace("1 + max over e.sal * 2", "top = 1 + max over e.sal * 2"))
    got = {r.dname: (r.n, float(r.pay), float(r.top)) for r in q.frame().collect()}
    assert got == {"ACCOUNTING": (3, 8750, 10001), "RESEARCH": (4, 10075, 6001), "SALES": (5, 8450, 5701)}
    q = session.run("from e in emps group {e.deptno, e.job} compute count over () order (deptno, job)")
    assert rows(q)[:2] == [(1, 10, "CLERK"), (1, 10, "MANAGER")]
    assert session.run("from e in emps compute {n = count over (), s = sum over e.empno}").frame().collect()[0].n == 14


def test_quantifiers(session):
    names = lambda s: sorted(session.run(s).collect())
    assert names("from d in depts where exists (from e in emps where e.deptno = d.deptno) yield d.dname") == ["ACCOUNTING", "RESEARCH", "SALES"]
    assert names("from d in depts where not (exists e in emps where e.deptno = d.deptno) yield d.dname") == ["OPERATIONS"]
    assert names("from d in depts where forall e in emps where e.deptno = d.deptno require e.sal > 900.0 yield d.dname") == ["ACCOUNTING", "OPERATIONS", "SALES"]
    assert session.run("exists e in emps where e.job = \"PRESIDENT\"") is True
    assert session.run("forall e in emps require e.sal > 1000.0") is False


def test_records_and_declarations(session):
    assert session.run("val rich = from e in emps where e.sal > 2900.0 yield {e.ename, e.sal}; from r in rich order r.ename yield r.ename").collect() == ["FORD", "JONES", "KING", "SCOTT"]
    q = session.run("from e in emps where e.empno = 7839 yield {a = e.empno, b = e.ename} yield {{a = a, b = b} extend c = a + 1 remove a}")
    assert q.frame().collect()[0].asDict() == {"b": "KING", "c": 7840}
    assert session.run("from e in emps order {e.deptno, pay = DESC e.sal} take 1 yield e.ename").collect() == ["KING"]


def test_errors(session):
    for source in ("from e in", "from e in emps where nothing = 1", "from e in emps yield {e.sal + 1}", "1 ? 2"):
        with pytest.raises(Error):
            session.run(source)
