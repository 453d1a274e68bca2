import pytest

from lumenrel.operators import datalog
from lumenrel.plans.errors import Error

EDGES = ".decl edge(x: int, y: int)\n.decl path(x: int, y: int)\nedge(1,2). edge(2,3). edge(3,4).\n"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_closure(spark):
    out = datalog.execute(spark, EDGES + "path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), edge(Y, Z). .output path")
    assert rows(out["path"]) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_negation_constants_and_wildcards(spark):
    text = '.decl student(n: string)\n.decl graduate(n: string)\n.decl current(n: string)\nstudent("ann"). student("bob"). graduate("bob").\ncurrent(X) :- student(X), !graduate(X).\n.output current'
    assert rows(datalog.execute(spark, text)["current"]) == [("ann",)]
    text = EDGES + ".decl out(x: int)\nout(X) :- edge(X, _), X >= 2.\nout(9).\n.output out"
    assert rows(datalog.execute(spark, text)["out"]) == [(2,), (3,), (9,)]


def test_arithmetic_in_heads(spark):
    text = ".decl fact(n: int, v: int)\nfact(0, 1).\nfact(N + 1, V * (N + 1)) :- fact(N, V), N < 5.\n.output fact"
    assert rows(datalog.execute(spark, text)["fact"])[-1] == (5, 120)


def test_mutual_recursion_and_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("0,1\n1,2\n2,3\n")
    text = ".decl s(a: int, b: int)\n.decl even(a: int)\n.decl odd(a: int)\n.input s \"n.csv\"\neven(0).\nodd(B) :- even(A), s(A, B).\neven(B) :- odd(A), s(A, B).\n.output even\n.output odd"
    out = datalog.execute(spark, text, folder=str(tmp_path))
    assert rows(out["even"]) == [(0,), (2,)] and rows(out["odd"]) == [(1,), (3,)]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        (".decl p(x: int)\np(X) :- q(X).", "not declared"), (".decl p(x: int)\np(1, 2).", "takes 1"), (".decl p(x: int)\n.decl q(x: int)\np(X) :- !q(X).", "unsafe"),
        (".decl p(x: int)\n.decl q(x: int)\nq(1).\np(X) :- q(X), !p(X).", "negation"), (".decl p(x: wrong)", "unknown type"), ("p(", "expected"),
    ],
)
def test_errors(text, error):
    assert error in datalog.validate(text)


def test_execute_refuses_wrong_programs(spark):
    with pytest.raises(Error):
        datalog.execute(spark, ".decl p(x: int)\np(X) :- q(X).")
