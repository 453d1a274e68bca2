"""The text front end: query expressions of the language, parsed and planned as steps of `Query`.

    from e in emps, d in depts where e.deptno = d.deptno andalso e.sal > 1000.0
      group d.dname compute {n = count over (), pay = sum over e.sal}
      order DESC n take 3

Supported: scans (`in`, `=`, several, lateral over a collection of a row, patterns that leave out rows which don't match), `join … on`,
`left/right/full join`, `where`, `yield`, `yieldAll`, `group … compute`, `compute`, `distinct`, `order` with DESC, `skip`, `take`, `union`, `intersect`,
`except` (each with `distinct`), `unorder`, `into`, `through`, `exists`, `forall … require`; expressions with the usual operators and precedence,
`if`, `case` and `fn` over patterns, `let … in … end`, records (with `extend`, `replace`, `remove`, `rename`), tuples, lists and ranges, field
access, `elem`, `notelem`, `implies`, `as`, `asOpt`, `raise`, `type_string`, `op +`, and the functions of the library by `Structure.name`.
Declarations: `val`, `val rec`, `fun` with clauses and `and`, `type` (an alias, or checked), `datatype`, `over` and `val inst`; signatures and
attributes are read and have no effect.

Scans without a source take their values from the conditions after them (`plans/invert.py`); a recursive predicate there is a fix-point.

A query inside an expression becomes a sub-query of Spark's, correlated where it names bindings of the row: a scalar one under an aggregate or
as a collection, EXISTS under `exists`, `forall` and `elem`, a lateral join as a scan. A recursive function unfolds while the plan is made;
over columns, whose depth is known only row by row, it needs types of its arguments and result and runs in Arrow batches.
"""

from __future__ import annotations

import inspect
import operator
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrel.functions import library
from lumenrel.operators.fixpoint import iterate
from lumenrel.plans import aggregates as A
from lumenrel.plans import errors, invert
from lumenrel.plans.errors import Error, fail
from lumenrel.plans.patterns import Constructor, Pattern, PatternParser, Type, choose, matched, type_text
from lumenrel.plans.query import Desc, Query, bag, column, values
from lumenrel.plans.types import Checked, Datatype, Overload

_TOKEN = re.compile(
    r"""\s+|\(\*.*?\*\)|\[@[^\]]*\]|(?P<real>~?\d+\.\d+(?:[eE]~?\d+)?|~?\d+[eE]~?\d+)|(?P<int>~?\d+)|(?P<char>\#"(?:[^"\\]|\\.)*")|(?P<string>"(?:[^"\\]|\\.)*")|(?P<label>\#(?:[A-Za-z_]\w*|\d+))"""
    r"""|(?P<tyvar>'[A-Za-z]\w*)|(?P<word>[A-Za-z_][\w']*)|(?P<quoted>`[^`]+`)|(?P<mark>\.\.\.|\.\.\^?|\^\.\.\^?|=>|->|<>|<=|>=|::|\?\.|[-+*/^@=<>(){}\[\],.|;~:!])""",
    re.S,
)
KEYWORDS = set(
    "from in where yield yieldAll group compute distinct order skip take union intersect except unorder into through exists forall require join left right full on "
    "andalso orelse not if then else case of let val fun end fn elem notelem implies div mod over and extend replace remove rename rec DESC "
    "as asOpt raise op datatype type typeof type_string signature inst".split()
)
_UNESCAPE = {"n": "\n", "t": "\t", "\\": "\\", '"': '"', "r": "\r"}


@dataclass(frozen=True)
class Tok:
    kind: str
    text: str


def tokens(source: str) -> list[Tok]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise Error(f"unexpected {source[at]!r} at {at}")
        if m.lastgroup:
            text = m.group().strip("`")
            out.append(Tok("key" if m.lastgroup == "word" and text in KEYWORDS else "word" if m.lastgroup == "quoted" else m.lastgroup, text))
        at = m.end()
    return out


def _text(raw: str) -> str:
    return re.sub(r"\\(.)", lambda m: _UNESCAPE.get(m[1], m[1]), raw)


# Parsed expressions are functions from an environment (names to values) to a value: a Column, a Query, a record (dict), a list, or a function.
Env = Mapping[str, Any]
Made = Callable[[Env], Any]


@dataclass(frozen=True)
class Over:
    """An aggregate whose argument is made per row."""

    make: Callable[[Callable], A.Aggregate]


#: Binary operators by level, loosest first.
LEVELS = [["implies"], ["orelse"], ["andalso"], ["=", "<>", "<", "<=", ">", ">=", "elem", "notelem"], ["::", "@"], ["+", "-", "^"], ["*", "/", "div", "mod"]]
AGGREGATES = {"count": A.count, "sum": A.sum_, "min": A.min_, "max": A.max_, "only": A.only, "elements": A.elements}


class Parser(PatternParser):
    def __init__(self, source: str) -> None:
        self.t, self.i = tokens(source), 0

    # -- tokens

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k].text if self.i + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k].kind if self.i + k < len(self.t) else "end"

    def next(self, want: str | None = None) -> str:
        if self.i >= len(self.t) or (want is not None and self.peek() != want):
            raise Error(f"expected {want or 'more'}, got {self.peek() or 'the end'}")
        self.i += 1
        return self.t[self.i - 1].text

    def eat(self, want: str) -> bool:
        if self.peek() == want and self.kind() != "string":
            self.i += 1
            return True
        return False

    def name(self) -> str:
        if self.kind() != "word":
            raise Error(f"expected a name, got {self.peek() or 'the end'}")
        return self.next()

    # -- expressions

    def expression(self) -> Made:
        if self.peek() == "if":
            return self.conditional()
        if self.peek() == "case":
            return self.case()
        if self.kind() == "key" and self.peek() == "fn":
            self.next()
            return self.function("fn", "=>", clauses=True, single=True)
        if self.kind() == "key" and self.peek() == "raise":
            return self.raised()
        e = self.binary(0)
        while self.kind() == "key" and self.peek() in ("as", "asOpt") or self.kind() == "mark" and self.peek() == ":":
            e = self.ascribed(e, self.next(), self.type_())
        return e

    @staticmethod
    def ascribed(of: Made, how: str, kind: Callable[[Env], Type]) -> Made:
        """e : t is e; e as t fails where a condition of t doesn't hold, e asOpt t is none there."""
        def run(env):
            checked = None if how == ":" else kind(env).checked
            if checked is None:
                return of(env)
            return (checked.as_ if how == "as" else checked.as_opt)(column(of(env)))
        return run

    def raised(self) -> Made:
        self.next("raise")
        name = self.name()
        said = self.atom() if self.kind() == "string" or self.peek() == "(" else None
        if name not in errors.NAMES:
            raise Error(f"unknown exception {name}")

        def run(env):
            message = said(env) if said else ""
            c = fail(f"{name}: {message}" if message else name)
            c.__dict__["raises"] = (name, message)
            return c
        return run

    def conditional(self) -> Made:
        self.next("if")
        test = self.expression()
        self.next("then")
        yes = self.expression()
        self.next("else")
        no = self.expression()

        def run(env):
            t = test(env)
            return (yes(env) if t else no(env)) if isinstance(t, bool) else F.when(column(t), column(yes(env))).otherwise(column(no(env)))
        return run

    def case(self) -> Made:
        self.next("case")
        subject = self.expression()
        self.next("of")
        arms: list[tuple[list[Pattern], Made]] = []
        while True:
            p = self.pattern()
            self.next("=>")
            arms.append(([p], self.expression()))
            if not self.eat("|"):
                break
        return lambda env: choose(arms, [subject(env)], env)

    def function(self, name: str, stop: str, *, clauses: bool, single: bool = False) -> Made:
        """fn p => e | …, or the clauses of fun: f p1 p2 … = e | f …"""
        arms: list[tuple[list[Pattern], Made]] = []
        start, result = self.i, None
        while True:
            if not single and arms:
                self.next(name)
            ps = [self.pattern()] if single else [self.atomic_pattern()]
            while not single and self.starts_pattern():
                ps.append(self.atomic_pattern())
            if not single and self.eat(":"):
                result = self.type_()
            self.next(stop)
            arms.append((ps, self.expression()))
            if not clauses or not self.eat("|"):
                break
        if len({len(ps) for ps, _ in arms}) > 1:
            raise Error(f"clauses of {name} differ in their number of arguments")
        words = [t.text for t in self.t[start : self.i] if t.kind == "word"]
        used = frozenset(words) - ({name} if words.count(name) < len(arms) else set())
        return lambda env: Function(name, tuple(arms), env, used, result)

    def binary(self, level: int) -> Made:
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in LEVELS[level] and self.kind() in ("key", "mark"):
            op = self.next()
            right = self.binary(level + 1) if op not in ("::", "implies") else self.binary(level)
            left = self.apply_binary(op, left, right)
        return left

    @staticmethod
    def apply_binary(op: str, left: Made, right: Made) -> Made:
        def run(env):
            a, b = left(env), right(env)
            if isinstance(a, A.Aggregate) or isinstance(b, A.Aggregate):
                whole = a if isinstance(a, A.Aggregate) else A.Aggregate(lambda _, q, a=a: column(a))
                return whole.combine(b, lambda x, y: _operate(op, x, y))
            return _operate(op, a, b)
        return run

    def unary(self) -> Made:
        if self.eat("not"):
            of = self.unary()
            return lambda env: _negated(of(env))
        if self.eat("~"):
            of = self.unary()
            return lambda env: (lambda v: -v if isinstance(v, (int, float)) else -column(v))(of(env))
        return self.application()

    def starts_atom(self) -> bool:
        return self.kind() in ("int", "real", "string", "char", "word", "label") or self.peek() in ("(", "[", "{", "let", "op") and self.kind() in ("mark", "key")

    def application(self) -> Made:
        f = self.postfix()
        if self.eat("over"):
            argument = self.binary(4)
            return self.over(f, argument)
        while self.starts_atom():
            x = self.postfix()
            f = (lambda f, x: lambda env: _apply(f(env), x(env), env))(f, x)
        return f

    @staticmethod
    def over(f: Made, argument: Made) -> Made:
        def run(env):
            fn = f(env)
            per_row = _PerRow(argument, env)
            if isinstance(fn, Over):
                return fn.make(per_row)
            return A.user(per_row, lambda c: column(_apply(fn, c)))
        return run

    def postfix(self) -> Made:
        e = self.atom()
        while self.peek() in (".", "?.") and self.kind() == "mark":
            self.next()
            field = self.next()
            e = (lambda e, field: lambda env: _field(e(env), field))(e, field)
        return e

    def atom(self) -> Made:
        kind, text = self.kind(), self.peek()
        if kind == "int":
            self.next()
            return lambda env: int(text.replace("~", "-"))
        if kind == "real":
            self.next()
            return lambda env: float(text.replace("~", "-"))
        if kind == "string":
            self.next()
            return lambda env: _text(text[1:-1])
        if kind == "char":
            self.next()
            return lambda env: _text(text[2:-1])
        if kind == "label":
            self.next()
            return lambda env: lambda x: _field(x, text[1:])
        if text in ("from", "exists", "forall") and kind == "key":
            return self.query()
        if text == "op" and kind == "key":
            self.next()
            sign = self.next()
            return lambda env: Section(sign)
        if text == "type_string" and kind == "key":
            self.next()
            e = self.postfix()
            return lambda env: type_text(self.kind_of(e(env), env))
        if text == "let":
            return self.let()
        if text in ("if", "case", "fn", "raise"):
            return self.expression()
        if text == "(":
            return self.parenthesis()
        if text == "[":
            return self.list_literal()
        if text == "{":
            return self.record()
        if kind == "word":
            self.next()
            return lambda env: _lookup(env, text)
        raise Error(f"unexpected {text or 'end'}")

    def parenthesis(self) -> Made:
        self.next("(")
        if self.eat(")"):
            return lambda env: {}
        parts = [self.expression()]
        while self.eat(","):
            parts.append(self.expression())
        self.next(")")
        return parts[0] if len(parts) == 1 else lambda env: tuple(p(env) for p in parts)

    def list_literal(self) -> Made:
        self.next("[")
        items: list[tuple] = []
        while not self.eat("]"):
            first = self.expression()
            if self.peek() in ("..", "..^", "^..", "^..^"):
                items.append((first, self.next(), self.expression()))
            else:
                items.append((first,))
            self.eat(",")

        def run(env):
            out = []
            for x in items:
                if len(x) == 1:
                    out.append(x[0](env))
                else:
                    low, high = x[0](env), x[2](env)
                    out += range(low + x[1].startswith("^"), high + (not x[1].endswith("^")))
            return out
        return run

    def record(self) -> Made:
        self.next("{")
        if self.eat("}"):
            return lambda env: {}
        start = self.i
        if self.kind() == "word" and self.peek(1) == "=":
            return self.fields({})
        base = self.postfix()
        if self.kind() == "key" and self.peek() in ("extend", "replace", "remove", "rename"):
            return self.modified(base)
        self.i = start
        return self.fields({})

    def fields(self, made: dict[str, Made]) -> Made:
        while not self.eat("}"):
            if self.kind() == "word" and self.peek(1) == "=":
                name = self.next()
                self.next("=")
                made[name] = self.expression()
            else:
                at = self.i
                e = self.expression()
                name = self.label_of(at, self.i)
                made[name] = e
            self.eat(",")
        return lambda env: {k: v(env) for k, v in made.items()}

    def label_of(self, start: int, stop: int) -> str:
        """The implicit label of an expression: its last field or name, or the aggregate's name."""
        words = [t.text for t in self.t[start:stop]]
        if "over" in words:
            return words[0]
        if self.t[stop - 1].kind == "word":
            return words[-1]
        raise Error("a field needs a label")

    def modified(self, base: Made) -> Made:
        steps: list[tuple[str, Any]] = []
        while not self.eat("}"):
            what = self.next()
            if what == "remove":
                names = [self.name()]
                while self.eat(","):
                    names.append(self.name())
                steps.append((what, names))
                continue
            if what not in ("extend", "replace", "rename"):
                raise Error(f"unexpected {what}")
            pairs: dict[str, Any] = {}
            while True:
                name = self.name()
                self.next("=")
                pairs[name] = self.name() if what == "rename" else self.expression()
                if not self.eat(","):
                    break
            steps.append((what, pairs))

        def run(env):
            row = _as_record(base(env))
            for what, given in steps:
                if what == "remove":
                    row = {k: v for k, v in row.items() if k not in given}
                elif what == "rename":
                    old = {v: k for k, v in given.items()}
                    row = {old.get(k, k): v for k, v in row.items()}
                else:
                    clash = [k for k in given if (k in row) == (what == "extend")]
                    if clash:
                        raise Error(f"{what}: {clash[0]}")
                    row = row | {k: v({**env, **row}) for k, v in given.items()}
            return row
        return run

    def let(self) -> Made:
        self.next("let")
        steps = []
        while not self.eat("in"):
            steps.append(self.declaration())
            self.eat(";")
        body = self.expression()
        self.next("end")

        def run(env):
            env = dict(env)
            for step in steps:
                env |= step(env)
            return body(env)
        return run

    def declaration(self) -> Callable[[Env], dict[str, Any]]:
        word = self.next()
        if word == "fun":
            made = []
            while True:
                name = self.name()
                made.append((name, self.function(name, "=", clauses=True)))
                if not self.eat("and"):
                    break
            return lambda env: _together(made, env)
        if word == "type":
            return self.type_declaration()
        if word == "datatype":
            return self.datatype()
        if word == "over":
            name = self.name()
            return lambda env: {name: Overload(name)}
        if word == "signature":
            while self.next() != "end":
                pass
            return lambda env: {}
        if self.eat("inst"):
            name = self.name()
            self.next("=")
            e = self.expression()

            def add(env):
                f = e(env)
                env[name].instances[f.first_type(env)] = f
                return {}
            return add
        recursive = self.eat("rec")
        parts: list[tuple[Pattern, Made]] = []
        names: list[str] = []
        while True:
            names.append(self.peek())
            p = self.pattern()
            self.next("=")
            parts.append((p, self.expression()))
            if not self.eat("and"):
                break
        if recursive:
            return lambda env: _together([(n, e) for n, (_, e) in zip(names, parts, strict=True)], env)

        def bind(env):
            out: dict[str, Any] = {}
            for p, e in parts:
                test, bound = matched([p], [e(env)], env)
                if test is False:
                    raise errors.Bind
                out |= bound if test is True else {k: F.when(test, column(v)).otherwise(fail("Bind")) for k, v in bound.items()}
            return out
        return bind

    def type_declaration(self) -> Callable[[Env], dict[str, Any]]:
        """type t = u, or type t = u check p => e, …; a checked type keeps the conditions of the one it is made from."""
        name = self.name()
        self.next("=")
        base = self.type_()
        checks: list[tuple[Pattern, Made]] = []
        if self.kind() == "word" and self.peek() == "check":
            self.next()
            while True:
                p = self.pattern()
                self.next("=>")
                checks.append((p, self.expression()))
                if not self.eat(","):
                    break

        def bind(env):
            of = base(env)
            if not checks:
                return {f"type {name}": of}
            tests = tuple((lambda p, e: lambda v: column(choose([([p], e)], [v], env)))(p, e) for p, e in checks)
            checked = of.checked.refined(name, *tests) if of.checked else Checked(name, of.ddl, tests)
            return {f"type {name}": Type(of.ddl, checked)}
        return bind

    def datatype(self) -> Callable[[Env], dict[str, Any]]:
        made = []
        while True:
            if self.kind() == "tyvar":
                raise Error("a datatype's payloads need types of columns, not variables")
            name = self.name()
            self.next("=")
            constructors = []
            while True:
                constructor = self.name()
                constructors.append((constructor, self.type_() if self.eat("of") else None))
                if not self.eat("|"):
                    break
            made.append((name, constructors))
            if not self.eat("and"):
                break

        def bind(env):
            out: dict[str, Any] = {}
            for name, constructors in made:
                of = Datatype(name, {c: t({**env, **out}).ddl if t else None for c, t in constructors})
                out |= {f"type {name}": Type(of.ddl)} | {c: Constructor(of, c) for c, _ in constructors}
            return out
        return bind

    @staticmethod
    def kind_of(v: Any, env: Env) -> T.DataType:
        """The type of a value, told while the plan is made."""
        if isinstance(v, Query):
            return T.ArrayType(v.df.select(v.current.alias("v")).schema["v"].dataType)
        over = env["$row"].df if isinstance(env.get("$row"), Query) else _session(env).range(1)
        return over.select(column(v).alias("v")).schema["v"].dataType

    # -- queries

    def query(self) -> Made:
        start = self.i
        how = self.next()
        steps: list[Callable[[Any, Env], Any]] = []
        if how == "exists" and self.peek() == "(" and self.peek(1) == "from":
            self.next()
            inner = self.query()
            self.next(")")
            return inner.as_(how)
        if self.starts_pattern():
            steps.append(self.scan("inner", False))
            while self.eat(","):
                steps.append(self.scan("inner", False))
        while self.kind() == "key":
            step = self.step()
            if step is None:
                break
            steps.append(step)
        require = None
        if how == "forall":
            self.next("require")
            require = self.expression()
        return SubQuery(how, steps, require, frozenset(t.text for t in self.t[start : self.i] if t.kind == "word"))

    def scan(self, how: str, on_allowed: bool) -> Callable:
        simple = self.peek() if self.kind() == "word" and self.peek() != "_" and self.peek(1) in ("in", "=") else None
        first = self.peek()
        pattern = self.pattern()
        if self.peek() not in ("in", "=") and first.isidentifier():
            return self.extent(first, getattr(pattern, "type", None))
        single = self.eat("=")
        if not single:
            self.next("in")
        source = self.expression()
        on = self.expression() if on_allowed and self.eat("on") else None

        def run(q, env):
            if simple and not isinstance(env.get(simple), Constructor):
                return scanned(q, env, simple, on)
            whole = f"__whole{len(q.names) if q is not None else 0}"
            test, bound = matched([pattern], [F.col(whole)], env)
            if test is False:
                raise errors.Bind
            condition = on and (lambda row: on({**row, **matched([pattern], [row[whole]], env)[1]}))
            if how != "inner" and test is not True:
                plain = condition
                condition = lambda row: column(matched([pattern], [row[whole]], env)[0]) & (column(plain(row)) if plain else F.lit(True))
            out = scanned(q, env, whole, condition)
            if test is not True and how == "inner":
                out = out.where(lambda **_: test)
            kept = [n for n in out.names if n != whole and n not in bound]
            df = out.df.select(*(f"`{n}`" for n in kept), *(column(v).alias(n) for n, v in bound.items()), *out._hidden())
            names = (*kept, *bound)
            return Query(df, names, q is None and len(names) == 1, out.order_by)

        def scanned(q, env, name, on):
            here = {**env, **_row_of(q)} if q is not None else env
            given = source(here)
            if single:
                if q is None:
                    return Query(_session(env).range(1).select(_value(given).alias(name)), (name,), True, ())
                return q.let(name, lambda: _value(given))
            if isinstance(given, Column) or (isinstance(given, list) and q is not None and _has_columns(given)):
                f = lambda: column(given)
                if q is None:
                    return Query(_session(env).range(1).select(F.lit(0).alias("__unit")), (), False, ()).yield_all(f, name=name)
                return q.join(how, on=_PerRow(on, env).signed(q, name) if on else None, **{name: f})
            correlated = isinstance(given, Query) and given.__dict__.get("correlated", False)
            given = _query(given, env)
            if q is None:
                return given.bind(name)
            condition = _PerRow(on, env).signed(q, name) if on else None
            return _beside(q, given, name, how, condition) if correlated else q.join(how, on=condition, **{name: given})
        if simple:
            run.kind = "scan"
        return run

    @staticmethod
    def extent(name: str, kind: Callable[[Env], Type] | None) -> Callable:
        """A scan without a source: its values are those that the conditions after it allow."""
        def run(q, env):
            raise Error(f"{name} has no source; only scans without one may stand beside it, with where right after them")

        def variable(env):
            return invert.var(name, {"boolean": "bool"}.get(ddl := kind(env).ddl, ddl) if kind else "int")
        run.kind, run.variable = "extent", variable
        return run

    def step(self) -> Callable | None:
        word = self.peek()
        if word in ("join", "left", "right", "full"):
            how = "inner"
            if word != "join":
                how = self.next()
            self.next("join")
            scans = [self.scan(how, True)]
            while self.eat(","):
                scans.append(self.scan(how, True))

            def joined(q, env):
                for s in scans:
                    q = s(q, env)
                return q
            return joined
        if word not in ("where", "yield", "yieldAll", "group", "compute", "distinct", "order", "skip", "take", "union", "intersect", "except", "unorder", "into", "through"):
            return None
        self.next()
        if word == "where":
            return self.where()
        if word == "yield":
            e = self.expression()
            return lambda q, env: _yield(q, _PerRow(e, env))
        if word == "yieldAll":
            name = "it"
            if self.kind() == "word" and self.peek(1) == "in":
                name = self.name()
                self.next("in")
            e = self.expression()
            return lambda q, env: q.yield_all(_PerRow(e, env).signed(q), name=name)
        if word == "group":
            return self.group()
        if word == "compute":
            made = self.aggregates()

            def computed(q, env):
                return q.group(compute={k: v({**env, **_row_of(q)}) for k, v in made.items()})
            computed.kind = "compute"
            return computed
        if word == "distinct":
            return lambda q, env: q.distinct()
        if word == "unorder":
            return lambda q, env: q.unorder()
        if word == "order":
            keys = [self.order_key()]
            return lambda q, env: q.order(*(x for k in keys for x in k(q, env)))
        if word in ("skip", "take"):
            n = self.expression()
            return lambda q, env: getattr(q, word)(n(env))
        if word in ("union", "intersect", "except"):
            distinct = self.eat("distinct")
            others = [self.expression()]
            while self.eat(","):
                others.append(self.expression())
            method = {"union": "union", "intersect": "intersect", "except": "except_"}[word]
            return lambda q, env: getattr(q, method)(*(_query(o(env), env) for o in others), distinct=distinct)
        if word == "into":
            f = self.expression()
            return lambda q, env: _apply(f(env), q, env)
        name = self.name()
        self.next("in")
        f = self.expression()
        return lambda q, env: _query(_apply(f(env), q, env), env).bind(name)

    def where(self) -> Callable:
        """A quantifier alone, plain or negated, in parentheses or not, is a semi or anti join; anything else a filter."""
        start = self.i
        negated = self.eat("not")
        opened = 0
        while self.peek() == "(" and self.kind() == "mark":
            self.next()
            opened += 1
        if self.kind() == "key" and self.peek() in ("exists", "forall"):
            how = self.peek()
            inner = 0
            if how == "exists" and self.peek(1) == "(":
                self.next()
                self.next("(")
                inner = 1
                if self.peek() != "from":
                    raise Error("expected from")
            sub = self.query()
            for _ in range(opened + inner):
                self.next(")")
            if self.kind() == "end" or self.kind() == "key" and self.peek() not in ("andalso", "orelse", "implies") or self.peek() in (")", ",", "]", "}", ";"):
                _, steps, require = sub.subquery

                def quantified(q, env):
                    if [getattr(x, "kind", "") for x in steps] == ["scan", *["filter"] * (len(steps) - 1)]:
                        return _quantified(q, (how, steps, require), negated, env)
                    met = sub({**env, **_row_of(q)})
                    return q.where(lambda **_: ~met if negated else met)
                quantified.condition = lambda env: _negated(sub(env)) if negated else sub(env)
                return quantified
        self.i = start
        e = self.expression()

        def run(q, env):
            value = _PerRow(e, env)
            return q.where(value.signed(q, "ordinal") if q.ordered and value.uses(q, "ordinal") else value.signed(q))
        if not any(t.text in ("from", "exists", "forall") for t in self.t[start : self.i]):
            run.kind = "filter"
        run.condition = e
        return run

    def group(self) -> Callable:
        start = self.i
        binder = None
        if self.kind() == "word" and self.peek(1) == "=":
            binder = self.next()
            self.next("=")
        key = self.expression()
        label = None
        if not binder and self.t[start].text != "{":
            label = self.label_of(start, self.i)
        made = self.aggregates() if self.eat("compute") else {}

        def run(q, env):
            here = {**env, **_row_of(q)}
            value = key(here)
            if isinstance(value, Mapping) and not binder:
                keys = {k: (lambda c: lambda: column(c))(v) for k, v in value.items()}
            else:
                keys = {binder or label: lambda: column(value)}
            compute, later = {}, {}
            for k, v in made.items():
                a = v({**here, **{n: F.col(n) for n in keys}})
                (compute if isinstance(a, A.Aggregate) else later)[k] = a
            out = q.group(compute=compute, **keys)
            for k, v in later.items():
                out = out.let(k, lambda v=v: column(v))
            return out
        return run

    def aggregates(self) -> dict[str, Made]:
        if self.peek() == "{":
            self.next()
            made: dict[str, Made] = {}
            while not self.eat("}"):
                if self.kind() == "word" and self.peek(1) == "=":
                    name = self.next()
                    self.next("=")
                    made[name] = self.expression()
                else:
                    at = self.i
                    e = self.expression()
                    made[self.label_of(at, self.i)] = e
                self.eat(",")
            return made
        if self.kind() == "word" and self.peek(1) == "=":
            name = self.next()
            self.next("=")
            return {name: self.expression()}
        at = self.i
        e = self.expression()
        return {self.label_of(at, self.i): e}

    def order_key(self) -> Callable:
        parenthesised = False
        if self.peek() == "(":
            depth, k = 0, self.i
            while k < len(self.t):
                depth += {"(": 1, ")": -1}.get(self.t[k].text, 0)
                if depth == 0:
                    break
                k += 1
            parenthesised = any(t.text in (",", "DESC") for t in self.t[self.i : k])
        record = self.peek() == "{"
        if parenthesised or record:
            self.next()
        parts: list[tuple[str, bool, Made]] = []
        stop = ")" if parenthesised else "}" if record else None
        while True:
            name = ""
            at = self.i
            if record and self.kind() == "word" and self.peek(1) == "=":
                name = self.next()
                self.next("=")
            down = self.eat("DESC")
            e = self.expression()
            if record and not name:
                name = self.label_of(at, self.i)
            parts.append((name, down, e))
            if not (stop and self.eat(",")):
                break
        if stop:
            self.next(stop)
        if record:
            parts.sort(key=lambda p: p[0])

        def run(q, env):
            return [Desc(_PerRow(e, env).signed(q)) if down else _PerRow(e, env).signed(q) for _, down, e in parts]
        return run


class _PerRow:
    """An expression of the row; called without arguments it reads the columns by name."""

    def __init__(self, e: Made, env: Env) -> None:
        self.e, self.env = e, env

    def uses(self, q: Query, name: str) -> bool:
        try:
            self.e({**self.env, **_row_of(q)})
        except Error as x:
            return name in str(x)
        return False

    def signed(self, q: Query, *more: str) -> Callable:
        """A function with the row's bindings as parameters."""
        def f(**row):
            return self.e({**self.env, **row, "$row": q})
        f.__signature__ = inspect.Signature([inspect.Parameter(n, inspect.Parameter.KEYWORD_ONLY) for n in (*q.names, *more)])
        return f

    def __call__(self):
        return self.e(self.env)


def _row_of(q: Query) -> dict[str, Any]:
    return {n: F.col(f"`{n}`") for n in q.names} | {"current": q.current, "$row": q}


def _session(env: Env) -> SparkSession:
    return env["$spark"]


def _yield(q: Query, e: _PerRow) -> Query:
    if q.ordered and e.uses(q, "ordinal"):
        q = q.with_ordinal("ordinal")
    made = e.e({**e.env, **_row_of(q)})
    if isinstance(made, Mapping) and made:
        return q.yield_({k: (lambda v: lambda: column(v))(v) for k, v in made.items()})
    return q.yield_(lambda: column(made))


def _query(x: Any, env: Env) -> Query:
    if isinstance(x, Query):
        return x
    if isinstance(x, DataFrame):
        return bag(x)
    if isinstance(x, list):
        if _has_columns(x):
            return Query(_session(env).range(1).select(F.lit(0).alias("__unit")), (), False, ()).yield_all(lambda: column(x))
        return values(_session(env), x)
    if isinstance(x, Column):
        return Query(_session(env).range(1).select(F.lit(0).alias("__unit")), (), False, ()).yield_all(lambda: x)
    raise Error("not a collection")


def _quantified(q: Query, sub: tuple, negated: bool, env: Env) -> Query:
    """where [not] exists / forall over another source, as a semi or anti join."""
    how, steps, require = sub
    outer = _row_of(q)
    inner, name = None, None
    conditions: list[Callable] = []
    scan, *rest = steps
    inner = scan(None, env)
    (name,) = inner.names
    for step in rest:
        probe = _Probe(inner)
        step(probe, {**env, **outer})
        if probe.condition is None:
            raise Error("only where steps may follow the scan of a correlated quantifier")
        conditions.append(probe.condition)
    def on(**row):
        out = None
        for c in conditions:
            v = column(c(row))
            out = v if out is None else out & v
        if how == "forall":
            bad = ~column(require({**env, **row}))
            out = bad if out is None else out & bad
        return F.lit(True) if out is None else out
    on.__signature__ = inspect.Signature([inspect.Parameter(n, inspect.Parameter.KEYWORD_ONLY) for n in (*q.names, name)])
    anti = (how == "forall") != negated
    source = replace_binding(inner, name)
    return q.where_not_exists(source, name, on) if anti else q.where_exists(source, name, on)


def replace_binding(inner: Query, name: str) -> Query:
    """The scanned source itself, before it was bound to a name."""
    return Query(inner.df, inner.names, True, inner.order_by)


class _Probe:
    """Stands for a query while a where step is read, to get at its condition."""

    def __init__(self, q: Query) -> None:
        self.names, self.ordered, self.condition, self.current = q.names, False, None, q.current

    def where(self, f: Callable) -> _Probe:
        self.condition = lambda row: f(**{n: row[n] for n in self.names})
        return self


def _as_record(x: Any) -> dict[str, Any]:
    if isinstance(x, Mapping):
        return dict(x)
    raise Error("a record modifier needs a record of known fields; bind them by yield first")


def _field(x: Any, name: str) -> Any:
    if isinstance(x, Mapping):
        if name not in x:
            raise Error(f"no field {name}")
        return x[name]
    if isinstance(x, tuple):
        return x[int(name) - 1]
    if isinstance(x, Column):
        return x.getField(name)
    return getattr(x, name)


def _lookup(env: Env, name: str) -> Any:
    if name in env:
        found = env[name]
        return found.of.make(name) if isinstance(found, Constructor) and found.payload is None else found
    if name in ("true", "false"):
        return name == "true"
    if name == "NONE":
        return F.lit(None)
    if name == "SOME":
        return _some
    if name in AGGREGATES:
        return Over(AGGREGATES[name])
    if name in library:
        return library[name]
    raise Error(f"unknown name {name}")


def _apply(f: Any, x: Any, env: Env) -> Any:
    inside = "$row" in env or "$nested" in env
    if isinstance(f, Over):
        if isinstance(x, Query):
            whole = x.df.select(f.make(lambda: column(x.current)).over(x).alias("it"))
            return whole.scalar() if inside else whole.collect()[0][0]
        return _apply(library["Relational"][{A.sum_: "sum"}.get(f.make, f.make.__name__.strip("_"))], x, env)
    if isinstance(f, Overload):
        kind = Parser.kind_of(x, env).simpleString()
        if kind not in f.instances:
            raise Error(f"no instance of {f.name} for {kind}")
        f = f.instances[kind]
    if not callable(f):
        raise Error("not a function")
    if _mentions(x) and f is library["String"]["isPrefix"]:
        return invert.node(x[0]).prefix_of(x[1])
    if _mentions(x) and not isinstance(f, (Function, Constructor, Section)) and callable(f) and f is not _some:
        return invert.Applied(f, tuple(map(invert.node, x if isinstance(x, tuple) else (x,))))
    if isinstance(f, Section) and isinstance(x, tuple):
        return f(*x)
    if isinstance(f, (Function, Constructor)) or f is _some:
        return f(x)
    if isinstance(x, Query) and inside:
        return f(column(x))
    if isinstance(x, tuple):
        try:
            return f(*(_host(v) for v in x))
        except TypeError:
            pass
    return f(_host(x))


def _some(x: Any) -> Any:
    return x


@dataclass(frozen=True)
class Section:
    """op +: an operator as a function of a pair."""

    sign: str

    def __call__(self, a: Any, b: Any) -> Any:
        return _operate(self.sign, a, b)


class Function:
    """fn or fun: clauses over patterns, one argument after the other."""

    def __init__(self, name: str, arms: tuple, env: Env, used: frozenset[str], result: Callable[[Env], Type] | None = None, given: tuple = ()) -> None:
        self.name, self.arms, self.env, self.used, self.result, self.given = name, arms, env, used, result, given
        self.recursive = False
        self.known: Any = None
        self.relation: Query | None = None
        self.__name__ = name
        self.__signature__ = inspect.Signature([inspect.Parameter("x", inspect.Parameter.POSITIONAL_OR_KEYWORD)])  # as lambdas of columns ask

    def __getstate__(self) -> dict[str, Any]:
        """What a worker needs: the names that the body reads, without the session and relations."""
        kept = {k: v for k, v in self.env.items() if k in self.used and isinstance(v, (Function, int, float, str, list, tuple))}
        return {**self.__dict__, "env": kept, "result": None, "relation": None}

    def first_type(self, env: Env) -> str:
        kind = getattr(self.arms[0][0][0], "type", None)
        if kind is None:
            raise Error("an instance needs the type of its argument")
        return T._parse_datatype_string(kind(env).ddl).simpleString()

    def __call__(self, *xs: Any) -> Any:
        arity = len(self.arms[0][0])
        given = (*self.given, *((xs,) if len(xs) > 1 and arity == 1 else xs))
        if len(given) < arity:
            more = Function(self.name, self.arms, self.env, self.used, self.result, given)
            more.recursive = self.recursive
            return more
        terms = given[0] if len(given) == 1 and isinstance(given[0], tuple) else given
        if self.recursive and _mentions(given) and all(isinstance(x, (invert.Node, int, float, str)) for x in terms):
            return self.as_relation(terms)
        over_rows = _has_columns(given)
        if over_rows and self.recursive and self.result:
            ddl = self.result(self.env).ddl
            return F.udf(self.by_row, ddl, useArrow=True)(*(column(x) for x in given))
        env = {**self.env, "$row": True} if over_rows and "$row" not in self.env else self.env
        try:
            return choose(self.arms, list(given), env)
        except RecursionError:
            raise Error(f"{self.name} doesn't end while the plan is made; over columns a recursive function needs the type of its result") from None

    def as_relation(self, terms: tuple) -> Any:
        """A recursive predicate over variables without a source: the least relation that its body allows, from nothing up."""
        if self.known is False:
            return False
        if self.known is None:
            variables = [invert.var(f"a{k + 1}", x.kind if isinstance(x, invert.Variable) else T._infer_type(x).simpleString()) for k, x in enumerate(terms)]
            given = [tuple(variables)] if len(self.arms[0][0]) == 1 and len(terms) > 1 else variables

            def found(known: Any) -> Query:
                self.known = known
                try:
                    body = choose(self.arms, given, self.env)
                finally:
                    self.known = None
                return Query(invert.rows(_session(self.env), variables, invert.node(body)), tuple(v.name for v in variables), len(variables) == 1)
            self.relation = self.relation or iterate(found(False), lambda every, _: found(every))
            return invert.member(terms, self.relation)
        return invert.member(terms, self.known)

    def by_row(self, *xs: Any) -> Any:
        """The function on one row's values; null for null."""
        return None if any(x is None for x in xs) else choose(self.arms, list(xs), self.env)


class SubQuery:
    """from, exists or forall: a query of its own, or inside an expression of a row a sub-query of Spark's."""

    def __init__(self, how: str, steps: list[Callable], require: Made | None, used: frozenset[str]) -> None:
        self.how, self.steps, self.require, self.used = how, steps, require, used

    @property
    def subquery(self) -> tuple:
        return self.how, self.steps, self.require

    def as_(self, how: str) -> SubQuery:
        return SubQuery(how, self.steps, self.require, self.used)

    def __call__(self, env: Env) -> Any:
        if self.steps and getattr(self.steps[0], "kind", "") == "extent":
            return self.solved(env)
        nested = "$row" in env
        correlated = nested and any(_has_columns(env.get(w)) for w in self.used)
        inner = {k: _outer(v) if correlated and k in self.used else v for k, v in env.items() if k != "$row"}
        if nested:
            inner["$nested"] = True
        q: Any = None if self.steps else Query(_session(env).range(1).select(), ())
        for step in self.steps:
            q = step(q, inner)
        if self.how == "exists":
            return q.df.exists() if nested else q.exists()
        if self.how == "forall":
            broken = q.where(lambda **_: ~F.coalesce(column(self.require({**inner, **_row_of(q)})), F.lit(False)))
            return ~broken.df.exists() if nested else not broken.exists()
        if not isinstance(q, Query):
            return q
        if nested and self.steps and getattr(self.steps[-1], "kind", "") == "compute":
            return q.df.select((F.col(f"`{q.names[0]}`") if len(q.names) == 1 else q.current).alias("it")).scalar()
        q.__dict__["correlated"] = correlated
        return q


    def solved(self, env: Env) -> Any:
        """Scans without a source, with the conditions right after them; under a condition of another such query, a part of that."""
        among = [x for x in self.steps if getattr(x, "kind", "") == "extent"]
        rest = self.steps[len(among) :]
        conditions: list[Callable] = []
        while rest and hasattr(rest[0], "condition"):
            conditions.append(rest.pop(0).condition)
        variables = [x.variable(env) for x in among]
        here = {k: v for k, v in env.items() if k != "$row"} | {v.name: v for v in variables}
        whole: Any = True
        for c in conditions:
            whole = _operate("andalso", whole, c(here))
        if self.how == "exists" and any(isinstance(env.get(w), invert.Node) for w in self.used):
            return invert.exists(*variables, where=whole) if isinstance(whole, invert.Node) else whole
        q = invert.solve(_session(env), *variables, where=invert.node(whole))
        return SubQuery(self.how, [lambda _, env: q, *rest], self.require, self.used)(env)


def _negated(v: Any) -> Any:
    return not v if isinstance(v, bool) else ~(v if isinstance(v, invert.Node) else column(v))


def _mentions(x: Any) -> bool:
    """Whether a value names a variable without a source."""
    return any(map(_mentions, x)) if isinstance(x, (list, tuple)) else isinstance(x, invert.Node)


def _condition(op: str, a: Any, b: Any) -> Any:
    """An operator over variables without a source."""
    if op in ("andalso", "orelse"):
        for x, y in ((a, b), (b, a)):
            if isinstance(x, bool):
                return y if x == (op == "andalso") else x
        return (a & b) if op == "andalso" else (a | b)
    if op == "implies":
        return _condition("orelse", _negated(a), b)
    if op in ("elem", "notelem"):
        terms = a if isinstance(a, tuple) else (a,)
        if isinstance(b, Query):
            found = invert.member(terms, b)
        else:
            pairs = [x if isinstance(x, tuple) else (x,) for x in b]
            found = invert.Or(tuple(invert.And(tuple(invert.node(t).eq(v) for t, v in zip(terms, p, strict=True))) for p in pairs))
        return found if op == "elem" else ~found
    a, b = invert.node(a), invert.node(b)
    if op == "=":
        return a.eq(b)
    if op == "<>":
        return a.ne(b)
    return _SIMPLE[op](a, b) if op in ("<", "<=", ">", ">=", "+", "-", "*") else invert.Applied(lambda x, y: _operate(op, x, y), (a, b))


def _has_columns(x: Any) -> bool:
    if isinstance(x, Mapping):
        return any(map(_has_columns, x.values()))
    return any(map(_has_columns, x)) if isinstance(x, (list, tuple)) else isinstance(x, Column)


def _outer(x: Any) -> Any:
    """Columns of the enclosing row, as a sub-query names them."""
    if isinstance(x, Mapping):
        return {k: _outer(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return type(x)(map(_outer, x))
    return x.outer() if isinstance(x, Column) else x


def _beside(q: Query, sub: Query, name: str, how: str, on: Callable | None) -> Query:
    """A scan of a sub-query that names bindings of the row: a lateral join, which Spark turns into a plain one where it can."""
    if how not in ("inner", "left"):
        raise Error(f"{how} join needs an independent source")
    right = sub.bind(name)
    condition = column(on(**{n: F.col(f"`{n}`") for n in (*q.names, name)})) if on else None
    ordered = q.ordered and right.ordered
    if not ordered:
        q, right = q.unorder(), Query(right.df.select(f"`{name}`"), (name,), True, None)
    df = q.df.lateralJoin(right.df, condition, how)
    return Query(df, (*q.names, name), False, (*q.order_by, *right.order_by) if ordered else None)


def _value(x: Any) -> Column:
    return column(x)


def _together(made: list[tuple[str, Made]], env: Env) -> dict[str, Any]:
    """Functions that may call themselves and each other."""
    shared, out = dict(env), {}
    group = {name for name, _ in made}
    for name, make in made:
        f = make(shared)
        if isinstance(f, Function):
            f.name, f.recursive = name, bool(group & f.used)
        out[name] = shared[name] = f
    return out


def _host(x: Any) -> Any:
    return F.lit(x) if isinstance(x, (int, float, str, bool)) else column(x) if isinstance(x, list) else x


_SIMPLE: dict[str, Callable[[Any, Any], Any]] = {
    "=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": operator.add, "-": operator.sub, "*": operator.mul, "div": operator.floordiv, "mod": operator.mod, "/": operator.truediv,
    "^": operator.add, "andalso": lambda a, b: a and b, "orelse": lambda a, b: a or b, "implies": lambda a, b: not a or b,
}


def _known(op: str, a: Any, b: Any) -> Any:
    """An operator on values that are known while the plan is made."""
    if op in ("div", "mod") and b == 0:
        raise errors.Div
    if op == "/" and b == 0:
        return float("nan") if a == 0 or a != a else float("inf") if a > 0 else float("-inf")
    out = _SIMPLE[op](a, b)
    if type(out) is int and not -(1 << 31) <= out < 1 << 31:
        raise errors.Overflow
    return out


def _operate(op: str, a: Any, b: Any) -> Any:
    if _mentions(a) or _mentions(b):
        return _condition(op, a, b)
    known = (bool, int, float, str)
    if op in _SIMPLE and isinstance(a, known) and isinstance(b, known):
        return _known(op, a, b)
    if op in ("elem", "notelem"):
        if isinstance(b, Query):
            sought = column(_outer(a))
            among = b.unorder().bind("__m").df.where(F.col("__m").eqNullSafe(sought))
            found = among.exists() if _has_columns(a) else not among.isEmpty()
            return (not found if isinstance(found, bool) else ~found) if op == "notelem" else found
        found = column(a).isin(*b) if isinstance(b, list) and not any(isinstance(x, Column) for x in b) else F.array_contains(column(b), column(a))
        return found if op == "elem" else ~found
    if op == "andalso":
        return column(a) & column(b)
    if op == "orelse":
        return column(a) | column(b)
    if op == "implies":
        return ~column(a) | column(b)
    if isinstance(a, list) and op == "@" and isinstance(b, list):
        return a + b
    if isinstance(b, list) and op == "::":
        return [a, *b]
    a, b = column(a), column(b)
    if op in ("div", "mod"):
        return library["Int"][op](a, b)
    if op == "/":
        return library["Real"]["/"](a, b)
    if op == "^":
        return F.concat(a, b)
    if op == "::":
        return F.concat(F.array(a), b)
    if op == "@":
        return F.concat(a, b)
    return {"=": a.eqNullSafe(b), "<>": ~a.eqNullSafe(b), "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "+": a + b, "-": a - b, "*": a * b}[op]


class Session:
    """Names bound to relations, values and functions; `run` evaluates declarations and expressions."""

    def __init__(self, spark: SparkSession, **names: Any) -> None:
        self.env: dict[str, Any] = {"$spark": spark} | {k: bag(v) if isinstance(v, DataFrame) else v for k, v in names.items()}

    def run(self, source: str) -> Any:
        p = Parser(source)
        result: Any = None
        while p.i < len(p.t):
            if p.peek() in ("val", "fun", "type", "datatype", "over", "signature") and p.kind() == "key":
                self.env |= p.declaration()(self.env)
            else:
                result = p.expression()(self.env)
                if isinstance(result, Column) and "raises" in result.__dict__:
                    name, message = result.__dict__["raises"]
                    raise getattr(errors, name)(message)
                self.env["it"] = result
            if p.i < len(p.t):
                p.next(";")
        return result
