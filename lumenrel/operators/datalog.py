"""Datalog programs: parsed, checked, stratified, and run as joins inside fix-points.

    .decl edge(x: int, y: int)
    .input edge "edges.csv"          facts from a file (or from a DataFrame given by name)
    edge(1, 2).                      a fact
    path(X, Y) :- edge(X, Y).        rules; !atom negates, comparisons and = bind or test, heads may compute with + - *
    path(X, Z) :- path(X, Y), edge(Y, Z).
    .output path

Variables start with an upper-case letter, or any letter if not quoted and not a number; _ matches anything.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrel.operators.fixpoint import _missing
from lumenrel.plans.errors import Error
from lumenrel.plans.storage import materialised

TYPES = {"int": "int", "number": "int", "string": "string", "symbol": "string", "bool": "boolean", "real": "double", "float": "double"}
_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|(?P<word>\.?[A-Za-z_][\w\']*)|(?P<number>-?\d+(\.\d+)?)|(?P<text>"(?:[^"\\]|\\.)*")|(?P<mark>:-|<=|>=|!=|<>|[().,!=<>+\-*:])', re.S)


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Math:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Atom:
    name: str
    terms: tuple
    negated: bool = False


@dataclass(frozen=True)
class Test:
    op: str
    left: object
    right: object


@dataclass
class Rule:
    head: Atom
    body: list = field(default_factory=list)


@dataclass
class Program:
    declared: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    inputs: dict[str, str | None] = field(default_factory=dict)
    outputs: list[str] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Error(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup:
            out.append((m.lastgroup if m.lastgroup in ("word", "number", "text", "mark") else "number", m.group()))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.t, self.i = _tokens(text), 0

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k][1] if self.i + k < len(self.t) else ""

    def next(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or (want and got != want):
            raise Error(f"expected {want or 'more'}, got {got or 'the end'}")
        self.i += 1
        return got

    def term(self):
        left = self.factor()
        while self.peek() in ("+", "-") or (self.i < len(self.t) and self.t[self.i][0] == "number" and self.peek().startswith("-")):
            if self.peek() in ("+", "-"):
                left = Math(self.next(), left, self.factor())
            else:
                left = Math("+", left, self.primary())
        return left

    def factor(self):
        left = self.primary()
        while self.peek() == "*":
            left = Math(self.next(), left, self.primary())
        return left

    def primary(self):
        if self.peek() == "(":
            self.next()
            out = self.term()
            self.next(")")
            return out
        kind = self.t[self.i][0] if self.i < len(self.t) else ""
        got = self.next()
        if kind == "number":
            return Const(float(got) if "." in got else int(got))
        if kind == "text":
            return Const(re.sub(r"\\(.)", r"\1", got[1:-1]))
        if kind == "word":
            return Const(got == "true") if got in ("true", "false") else Var(got)
        raise Error(f"unexpected {got}")

    def atom(self, negated: bool = False) -> Atom:
        name = self.next()
        self.next("(")
        terms = []
        while self.peek() != ")":
            terms.append(self.term())
            if self.peek() == ",":
                self.next()
        self.next(")")
        return Atom(name, tuple(terms), negated)

    def literal(self):
        if self.peek() == "!":
            self.next()
            return self.atom(True)
        if self.i < len(self.t) and self.t[self.i][0] == "word" and self.peek(1) == "(":
            return self.atom()
        left = self.term()
        op = self.next()
        if op not in ("=", "!=", "<>", "<", "<=", ">", ">="):
            raise Error(f"expected a comparison, got {op}")
        return Test("!=" if op == "<>" else op, left, self.term())

    def program(self) -> Program:
        p = Program()
        while self.i < len(self.t):
            word = self.peek()
            if word == ".decl":
                self.next()
                name = self.next()
                self.next("(")
                columns = []
                while self.peek() != ")":
                    column = self.next()
                    self.next(":")
                    kind = self.next()
                    if kind not in TYPES:
                        raise Error(f"unknown type {kind}")
                    columns.append((column, TYPES[kind]))
                    if self.peek() == ",":
                        self.next()
                self.next(")")
                if name in p.declared:
                    raise Error(f"{name} is declared twice")
                p.declared[name] = columns
            elif word == ".input":
                self.next()
                name = self.next()
                p.inputs[name] = self.next()[1:-1] if self.i < len(self.t) and self.t[self.i][0] == "text" else None
            elif word == ".output":
                self.next()
                p.outputs.append(self.next())
            else:
                rule = Rule(self.atom())
                if self.peek() == ":-":
                    self.next()
                    rule.body.append(self.literal())
                    while self.peek() == ",":
                        self.next()
                        rule.body.append(self.literal())
                self.next(".")
                p.rules.append(rule)
        return p


def _vars(x) -> set[str]:
    if isinstance(x, Var):
        return {x.name} - {"_"}
    if isinstance(x, (Math, Test)):
        return _vars(x.left) | _vars(x.right)
    if isinstance(x, Atom):
        return set().union(*map(_vars, x.terms)) if x.terms else set()
    return set()


def check(p: Program) -> None:
    """Declarations, arities, and safety: head, negated and compared variables must be bound by positive atoms or equations."""
    for name in [*p.inputs, *p.outputs]:
        if name not in p.declared:
            raise Error(f"{name} is not declared")
    for r in p.rules:
        for a in [r.head, *(x for x in r.body if isinstance(x, Atom))]:
            if a.name not in p.declared:
                raise Error(f"{a.name} is not declared")
            if len(a.terms) != len(p.declared[a.name]):
                raise Error(f"{a.name} takes {len(p.declared[a.name])} terms, not {len(a.terms)}")
        bound = set().union(set(), *(_vars(t) for x in r.body if isinstance(x, Atom) and not x.negated for t in x.terms if isinstance(t, Var)))
        grew = True
        while grew:
            grew = False
            for x in r.body:
                if isinstance(x, Test) and x.op == "=":
                    for a, b in ((x.left, x.right), (x.right, x.left)):
                        if isinstance(a, Var) and a.name not in bound and _vars(b) <= bound:
                            bound.add(a.name)
                            grew = True
        for x in [r.head, *r.body]:
            if isinstance(x, (Test,)) or x is r.head or (isinstance(x, Atom) and x.negated):
                if free := _vars(x) - bound:
                    raise Error(f"unsafe variable {sorted(free)[0]} in a rule for {r.head.name}")
    strata(p)


def strata(p: Program) -> list[list[str]]:
    """Relations in groups that may depend on each other, in an order in which negated ones come first."""
    level = dict.fromkeys(p.declared, 0)
    for _ in range(len(level) + 1):
        changed = False
        for r in p.rules:
            for x in r.body:
                if isinstance(x, Atom):
                    need = level[x.name] + x.negated
                    if level[r.head.name] < need:
                        level[r.head.name], changed = need, True
        if not changed:
            break
    else:
        raise Error("negation inside a recursion")
    return [[n for n in level if level[n] == k] for k in sorted(set(level.values()))]


class _Run:
    def __init__(self, spark: SparkSession, p: Program) -> None:
        self.spark, self.p, self.known = spark, p, {}

    def columns(self, name: str) -> list[str]:
        return [c for c, _ in self.p.declared[name]]

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in self.p.declared[name]))

    def term(self, t, row: Mapping[str, Column]) -> Column:
        if isinstance(t, Const):
            return F.lit(t.value)
        if isinstance(t, Var):
            return row[t.name]
        a, b = self.term(t.left, row), self.term(t.right, row)
        return a + b if t.op == "+" else a - b if t.op == "-" else a * b

    def rule(self, r: Rule, delta: tuple[int, DataFrame] | None = None) -> DataFrame:
        """The rows that a rule derives; delta: a body place to be read from other rows than all known."""
        df, row = None, {}
        atoms = [(i, x) for i, x in enumerate(r.body) if isinstance(x, Atom) and not x.negated]
        for i, x in sorted(atoms, key=lambda a: delta is None or a[0] != delta[0]):
            src = delta[1] if delta and delta[0] == i else self.known[x.name]
            names = [f"__{i}_{k}" for k in range(len(x.terms))]
            right = src.toDF(*names)
            on, here = [], {}
            for n, t in zip(names, x.terms, strict=True):
                if isinstance(t, Var) and t.name == "_":
                    continue
                if isinstance(t, Var) and t.name not in row and t.name not in here:
                    here[t.name] = F.col(n)
                elif isinstance(t, Const):
                    right = right.where(F.col(n) == F.lit(t.value))
                elif isinstance(t, Var) and t.name in here:
                    right = right.where(F.col(n) == here[t.name])
                else:
                    on.append(F.col(n) == self.term(t, row))
            if df is None:
                df = right
            else:
                condition = on[0] if on else None
                for c in on[1:]:
                    condition &= c
                df = df.join(right, condition) if on else df.crossJoin(right)
            row |= here
        if df is None:
            df = self.spark.range(1).select()
        tests = [x for x in r.body if isinstance(x, Test)]
        while tests:
            for x in tests:
                binds = next(((a, b) for a, b in ((x.left, x.right), (x.right, x.left)) if x.op == "=" and isinstance(a, Var) and a.name not in row and _vars(b) <= set(row)), None)
                if binds:
                    name = f"__v_{binds[0].name}"
                    df = df.withColumn(name, self.term(binds[1], row))
                    row[binds[0].name] = F.col(name)
                elif _vars(x) <= set(row):
                    a, b = self.term(x.left, row), self.term(x.right, row)
                    df = df.where({"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[x.op])
                else:
                    continue
                tests.remove(x)
                break
        for i, x in enumerate(r.body):
            if isinstance(x, Atom) and x.negated:
                names = [f"__n{i}_{k}" for k in range(len(x.terms))]
                condition = F.lit(True)
                for n, t in zip(names, x.terms, strict=True):
                    if not (isinstance(t, Var) and t.name == "_"):
                        condition &= F.col(n) == self.term(t, row)
                df = df.join(self.known[x.name].toDF(*names), condition, "left_anti")
        head = self.p.declared[r.head.name]
        return df.select(*(self.term(t, row).cast(kind).alias(c) for t, (c, kind) in zip(r.head.terms, head, strict=True)))

    def run(self) -> None:
        facts: dict[str, list[tuple]] = {}
        for r in self.p.rules:
            if not r.body and all(isinstance(t, Const) for t in r.head.terms):
                facts.setdefault(r.head.name, []).append(tuple(t.value for t in r.head.terms))
        for name, columns in self.p.declared.items():
            df = self.known.get(name, self.empty(name))
            if name in facts:
                df = df.unionByName(self.spark.createDataFrame(facts[name], ", ".join(f"`{c}` {t}" for c, t in columns)))
            self.known[name] = df.distinct() if name in facts or name in self.p.inputs else df
        for group in strata(self.p):
            rules = [r for r in self.p.rules if r.head.name in group and r.body]
            first = [(r, self.rule(r)) for r in rules if not any(isinstance(x, Atom) and x.name in group and any(q.head.name == x.name for q in rules) for x in r.body)]
            new: dict[str, DataFrame] = {}
            for r, df in first:
                new[r.head.name] = new[r.head.name].unionByName(df) if r.head.name in new else df
            own = {r.head.name for r in rules}
            recursive = [r for r in rules if any(isinstance(x, Atom) and not x.negated and x.name in own for x in r.body)]
            for name in own:
                start = self.known[name].unionByName(new[name]) if name in new else self.known[name]
                self.known[name] = materialised(start.distinct(), "datalog") if recursive else start.distinct()
            fresh = {n: self.known[n] for n in own}
            while recursive:
                made: dict[str, DataFrame] = {}
                for r in recursive:
                    for i, x in enumerate(r.body):
                        if isinstance(x, Atom) and not x.negated and x.name in fresh:
                            df = self.rule(r, (i, fresh[x.name]))
                            made[r.head.name] = made[r.head.name].unionByName(df) if r.head.name in made else df
                fresh = {}
                for name, df in made.items():
                    df = materialised(_missing(df.distinct(), self.known[name]), "datalog")
                    if not df.isEmpty():
                        fresh[name] = df
                for name, df in fresh.items():
                    self.known[name] = self.known[name].unionByName(df)
                if not fresh:
                    break


def parse(text: str) -> Program:
    return _Parser(text).program()


def validate(text: str) -> str:
    """'' if the program is right, else what is wrong with it."""
    try:
        check(parse(text))
    except Error as e:
        return str(e)
    return ""


def execute(spark: SparkSession, text: str, relations: Mapping[str, DataFrame] | None = None, folder: str = ".") -> dict[str, DataFrame]:
    """The output relations of a program. `relations` gives inputs by name; others are read from CSV files under `folder`."""
    p = parse(text)
    check(p)
    run = _Run(spark, p)
    for name, file in p.inputs.items():
        columns = p.declared[name]
        if relations and name in relations:
            src = relations[name]
        else:
            src = spark.read.csv(f"{folder}/{file or name + '.csv'}", schema=", ".join(f"`{c}` {t}" for c, t in columns))
        run.known[name] = src.select(*(F.col(f"`{a}`").cast(t).alias(c) for a, (c, t) in zip(src.columns, columns, strict=True)))
    run.run()
    return {name: run.known[name] for name in p.outputs}
