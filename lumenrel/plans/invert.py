"""Scans without a source: values of variables derived from the conditions on them.

Conditions are written over `var(name, type)` with Python operators (&, |, ~, comparisons, + - *), `elem`, `prefix_of`, `in_range` and
`exists`. `solve` finds a generator for each variable - a collection, a point, an integer range, prefixes of a string, a finite type, or the
union of the arms of a disjunction - joins them, and applies the whole condition as a filter. Bounds of linear conditions are tightened
for at most ROUNDS rounds first. Values come distinct and in natural order. A variable that nothing grounds is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from fractions import Fraction
from math import ceil, floor
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrel.plans.errors import Error, Size
from lumenrel.plans.query import Query

ROUNDS = 8
LONGEST = 2**24 - 1


class Node:
    def __and__(self, o): return And((self, o))
    def __or__(self, o): return Or((self, o))
    def __invert__(self): return Not(self)
    def __lt__(self, o): return Cmp("<", self, node(o))
    def __le__(self, o): return Cmp("<=", self, node(o))
    def __gt__(self, o): return Cmp(">", self, node(o))
    def __ge__(self, o): return Cmp(">=", self, node(o))
    def eq(self, o): return Cmp("=", self, node(o))
    def ne(self, o): return Cmp("<>", self, node(o))
    def __add__(self, o): return Arith("+", self, node(o))
    def __radd__(self, o): return Arith("+", node(o), self)
    def __sub__(self, o): return Arith("-", self, node(o))
    def __rsub__(self, o): return Arith("-", node(o), self)
    def __mul__(self, o): return Arith("*", self, node(o))
    def __rmul__(self, o): return Arith("*", node(o), self)
    def elem(self, of: Query): return Elem((self,), of)
    def prefix_of(self, s): return Prefix(self, node(s))


@dataclass(frozen=True, eq=False)
class Variable(Node):
    name: str
    kind: str = "int"


@dataclass(frozen=True, eq=False)
class Value(Node):
    value: Any


@dataclass(frozen=True, eq=False)
class Arith(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True, eq=False)
class Applied(Node):
    """A function of columns; it filters and gives points, but yields no bounds."""

    f: Callable[..., Column]
    terms: tuple


@dataclass(frozen=True, eq=False)
class Cmp(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True, eq=False)
class And(Node):
    parts: tuple


@dataclass(frozen=True, eq=False)
class Or(Node):
    parts: tuple


@dataclass(frozen=True, eq=False)
class Not(Node):
    of: Node


@dataclass(frozen=True, eq=False)
class Elem(Node):
    """(a, b, ..) is a row of `of`, whose columns are matched in order."""

    terms: tuple
    of: Query


@dataclass(frozen=True, eq=False)
class Prefix(Node):
    left: Node
    of: Node


@dataclass(frozen=True, eq=False)
class Exists(Node):
    variables: tuple
    condition: Node


def var(name: str, kind: str = "int") -> Variable:
    return Variable(name, kind)


def node(x: Any) -> Node:
    return x if isinstance(x, Node) else Value(x)


def member(terms: Sequence[Any], of: Query) -> Elem:
    return Elem(tuple(map(node, terms)), of)


def exists(*variables: Variable, where: Node) -> Exists:
    return Exists(variables, where)


def conjuncts(n: Node) -> list[Node]:
    return [y for x in n.parts for y in conjuncts(x)] if isinstance(n, And) else [n]


def names(n: Node) -> set[str]:
    if isinstance(n, Variable):
        return {n.name}
    if isinstance(n, Applied):
        return set().union(*map(names, n.terms))
    if isinstance(n, (Arith, Cmp)):
        return names(n.left) | names(n.right)
    if isinstance(n, (And, Or)):
        return set().union(*map(names, n.parts))
    if isinstance(n, Not):
        return names(n.of)
    if isinstance(n, Elem):
        return set().union(*map(names, n.terms))
    if isinstance(n, Prefix):
        return names(n.left) | names(n.of)
    if isinstance(n, Exists):
        return names(n.condition) - {v.name for v in n.variables}
    return set()


def expression(n: Node) -> Column:
    """A condition or term as a Column over columns named as the variables; membership and exists are joined instead."""
    if isinstance(n, Variable):
        return F.col(f"`{n.name}`")
    if isinstance(n, Value):
        return F.lit(n.value)
    if isinstance(n, Applied):
        return n.f(*map(expression, n.terms))
    if isinstance(n, Arith):
        a, b = expression(n.left), expression(n.right)
        return a + b if n.op == "+" else a - b if n.op == "-" else a * b
    if isinstance(n, Cmp):
        a, b = expression(n.left), expression(n.right)
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[n.op]
    if isinstance(n, (And, Or)):
        parts = [expression(p) for p in n.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(n, And) else out | p
        return out
    if isinstance(n, Not):
        return ~expression(n.of)
    if isinstance(n, Prefix):
        return F.startswith(expression(n.of), expression(n.left))
    raise Error("membership must stand alone among the conjuncts or arms")


def linear(n: Node) -> dict[str | None, Fraction] | None:
    """Coefficients by variable, the constant under None; none if n isn't linear."""
    if isinstance(n, Value) and isinstance(n.value, int) and not isinstance(n.value, bool):
        return {None: Fraction(n.value)}
    if isinstance(n, Variable) and n.kind == "int":
        return {n.name: Fraction(1)}
    if isinstance(n, Arith):
        a, b = linear(n.left), linear(n.right)
        if a is None or b is None:
            return None
        if n.op == "*":
            k, other = (a, b) if set(a) <= {None} else (b, a)
            return {x: v * k.get(None, Fraction(0)) for x, v in other.items()} if set(k) <= {None} else None
        sign = 1 if n.op == "+" else -1
        return {x: a.get(x, Fraction(0)) + sign * b.get(x, Fraction(0)) for x in {*a, *b}}
    return None


def bounds(conditions: list[Node], ints: set[str]) -> dict[str, tuple[Fraction | None, Fraction | None]]:
    """Lower and upper bounds of the int variables, from linear comparisons."""
    rows = []  # sum(k * x) + constant <= 0
    for n in conditions:
        if isinstance(n, Cmp) and n.op != "<>":
            a, b = linear(n.left), linear(n.right)
            if a is None or b is None:
                continue
            diff = {x: a.get(x, Fraction(0)) - b.get(x, Fraction(0)) for x in {*a, *b}}
            if n.op in ("<", "<=", "="):
                rows.append(diff | {None: diff.get(None, Fraction(0)) + (n.op == "<")})
            if n.op in (">", ">=", "="):
                rows.append({x: -v for x, v in diff.items()} | {None: -diff.get(None, Fraction(0)) + (n.op == ">")})
    out: dict[str, tuple[Fraction | None, Fraction | None]] = {x: (None, None) for x in ints}
    for _ in range(ROUNDS):
        before = dict(out)
        for row in rows:
            for x, k in row.items():
                if x is None or not k or x not in out:
                    continue
                rest = row.get(None, Fraction(0))
                for y, m in row.items():
                    if y in (None, x) or not m:
                        continue
                    edge = out.get(y, (None, None))[0 if m > 0 else 1]
                    if edge is None:
                        rest = None
                        break
                    rest += m * edge
                if rest is None:
                    continue
                limit, (low, high) = -rest / k, out[x]
                if k > 0:
                    limit = Fraction(floor(limit))
                    out[x] = (low, limit if high is None else min(high, limit))
                else:
                    limit = Fraction(ceil(limit))
                    out[x] = (limit if low is None else max(low, limit), high)
        if out == before:
            break
    return out


def _source(spark: SparkSession, of: Elem) -> DataFrame:
    """Distinct rows of the collection that fit its constant terms and repeated variables, by variable name."""
    q = of.of.elements()
    df = q.unorder().df.toDF(*(f"__{i}" for i in range(len(q.names))))
    if len(of.terms) != len(q.names):
        raise Error("a row of the collection has another number of fields")
    chosen: dict[str, Column] = {}
    for i, t in enumerate(of.terms):
        c = F.col(f"__{i}")
        if isinstance(t, Variable) and t.name not in chosen:
            chosen[t.name] = c
        elif isinstance(t, Variable):
            df = df.where(c == chosen[t.name])
        elif isinstance(t, Value):
            df = df.where(c == F.lit(t.value))
        else:
            raise Error("a term of a membership must be a variable or a constant")
    return df.select(*(c.alias(n) for n, c in chosen.items())).distinct()


def _join(a: DataFrame | None, b: DataFrame) -> DataFrame:
    if a is None:
        return b
    shared = [c for c in b.columns if c in a.columns]
    return a.join(b, shared) if shared else a.crossJoin(b)


FINITE = {"bool": [False, True], "unit": [None]}


def rows(spark: SparkSession, variables: Sequence[Variable], condition: Node) -> DataFrame:
    """The distinct assignments of the variables that meet the condition."""
    own = {v.name: v for v in variables}
    parts = conjuncts(condition)
    df: DataFrame | None = None
    filters: list[Node] = []
    for n in parts:
        if isinstance(n, Elem):
            df = _join(df, _source(spark, n))
        elif isinstance(n, Exists):
            inner = rows(spark, [*n.variables, *(own[x] for x in sorted(names(n) & set(own)))], n.condition)
            df = _join(df, inner.select(*sorted(names(n) & set(own))).distinct())
        elif isinstance(n, Or):
            used = sorted(names(n) & set(own))
            arms = []
            for arm in n.parts:
                others = [p for p in parts if p is not n and not isinstance(p, (Elem, Exists, Or)) and names(p) & set(own) <= set(used)]
                try:
                    arms.append(rows(spark, [own[x] for x in used], And((arm, *others)) if others else arm).select(*used))
                except Error:
                    arms = []
                    break
            if arms:
                made = arms[0]
                for a in arms[1:]:
                    made = made.unionByName(a)
                df = _join(df, made.distinct())
            else:
                filters.append(n)
        else:
            filters.append(n)
    have = set(df.columns) if df is not None else set()
    limit = bounds(filters, {v.name for v in variables if v.kind == "int"})
    todo = [v for v in variables if v.name not in have]
    moved = True
    while todo and moved:
        moved = False
        for v in list(todo):
            point = next((b for n in filters if isinstance(n, Cmp) and n.op == "=" for a, b in ((n.left, n.right), (n.right, n.left)) if isinstance(a, Variable) and a.name == v.name and names(b) <= have), None)
            prefix = next((n for n in filters if isinstance(n, Prefix) and isinstance(n.left, Variable) and n.left.name == v.name and names(n.of) <= have), None)
            low, high = limit.get(v.name, (None, None))
            base = df if df is not None else spark.range(1).select()
            if point is not None:
                df = base.withColumn(v.name, expression(point).cast(v.kind if v.kind != "bool" else "boolean"))
            elif prefix is not None:
                s = expression(prefix.of)
                df = base.withColumn(v.name, F.explode(F.transform(F.sequence(F.lit(0), F.length(s)), lambda k: F.substring(s, F.lit(1), k))))
            elif low is not None and high is not None:
                if high - low >= LONGEST:
                    raise Size
                df = _join(df, spark.range(int(low), int(high) + 1).select(F.col("id").cast("int").alias(v.name)))
            elif v.kind in FINITE:
                df = _join(df, spark.createDataFrame([(x,) for x in FINITE[v.kind]], f"`{v.name}` boolean"))
            else:
                continue
            have.add(v.name)
            todo.remove(v)
            moved = True
            break
    if todo:
        raise Error(f"cannot enumerate all values of type {todo[0].kind} (variable {todo[0].name})")
    for n in filters:
        df = df.where(expression(n))
    return df.select(*own).distinct()


def solve(spark: SparkSession, *variables: Variable, where: Node) -> Query:
    """from x, y where <condition>: a list of distinct values in natural order."""
    df = rows(spark, variables, where)
    q = Query(df, tuple(v.name for v in variables), len(variables) == 1)
    return q.order(*((lambda n: lambda **_: F.col(f"`{n}`"))(v.name) for v in variables))


def reachable(edges: Query) -> Query:
    """The least relation path with path(x, y) if edge(x, y) or path(x, z) and edge(z, y): a recursive predicate as a fix-point."""
    from lumenrel.operators.fixpoint import iterate

    base = edges.elements().unorder()
    a, b = base.names
    seed = replace(base, df=base.df.distinct())

    def step(_: Query, new: Query) -> Query:
        left, right = new.df.select(F.col(a), F.col(b).alias("__z")), seed.df.select(F.col(a).alias("__z"), F.col(b))
        return replace(seed, df=left.join(right, "__z").select(a, b))

    return iterate(seed, step)
