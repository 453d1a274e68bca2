"""Checked types, tagged unions and overloads, all resolved while a plan is made."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrel.plans.errors import Error, fail, guarded
from lumenrel.plans.query import Query


@dataclass(frozen=True)
class Checked:
    """A type with conditions that its values meet: `type nat = int check i => i >= 0`."""

    name: str
    base: str
    checks: tuple[Callable[[Column], Column], ...]
    parent: Checked | None = None

    def holds(self, v: Column) -> Column:
        out = self.parent.holds(v) if self.parent else F.lit(True)
        for check in self.checks:
            out = out & F.coalesce(check(v), F.lit(False))
        return out

    def as_(self, v: Column) -> Column:
        """e as t: the value, or a failure where the check does not hold."""
        return guarded(self.holds(v), v, f"Check {self.name}")

    def as_opt(self, v: Column) -> Column:
        """e asOpt t: the value or none."""
        return F.when(self.holds(v), v)

    def refined(self, name: str, *checks: Callable[[Column], Column]) -> Checked:
        return Checked(name, self.base, checks, self)

    def scan(self, q: Query, binding: str) -> Query:
        """A scan over the type: only elements that meet its conditions."""
        return q.where(_of(binding, self.holds))


def _of(name: str, f: Callable[[Column], Column]) -> Callable[..., Column]:
    import inspect

    def run(**row: Column) -> Column:
        return f(row[name])
    run.__signature__ = inspect.Signature([inspect.Parameter(name, inspect.Parameter.KEYWORD_ONLY)])
    return run


@dataclass(frozen=True)
class Datatype:
    """A tagged union: `datatype shape = CIRCLE of real | SQUARE of real | POINT`. Values order by declaration, then payload."""

    name: str
    constructors: Mapping[str, str | None]

    @property
    def ddl(self) -> str:
        fields = ["tag: int", "name: string", *(f"`{k}`: {t}" for k, t in self.constructors.items() if t)]
        return f"struct<{', '.join(fields)}>"

    def make(self, constructor: str, payload: Column | None = None) -> Column:
        names = list(self.constructors)
        if constructor not in names:
            raise Error(f"{self.name} has no constructor {constructor}")
        parts = [F.lit(names.index(constructor)).alias("tag"), F.lit(constructor).alias("name")]
        for k, kind in self.constructors.items():
            if kind:
                parts.append((payload.cast(kind) if k == constructor and payload is not None else F.lit(None).cast(kind)).alias(k))
        return F.struct(*parts)

    def case(self, v: Column, default: Callable[[], Column] | None = None, **arms: Callable[..., Column]) -> Column:
        """case v of …: constructors with a payload get it; Match where no arm fits."""
        chain = None
        for k, f in arms.items():
            if k not in self.constructors:
                raise Error(f"{self.name} has no constructor {k}")
            value = f(v[k]) if self.constructors[k] else f()
            test = v["name"] == k
            chain = F.when(test, value) if chain is None else chain.when(test, value)
        if chain is None:
            raise Error("no arms")
        return chain.otherwise(default() if default else fail("Match"))

    def missing(self, *arms: str) -> list[str]:
        """Constructors that a list of arms doesn't cover."""
        return [k for k in self.constructors if k not in arms]


@dataclass
class Overload:
    """over foo; val inst foo = …: instances chosen by the argument's type."""

    name: str
    instances: dict[str, Callable[..., Any]] = field(default_factory=dict)

    def inst(self, kind: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
        def add(f: Callable[..., Any]) -> Callable[..., Any]:
            self.instances[kind] = f
            return f
        return add

    def resolve(self, df: DataFrame, *arguments: Column) -> Any:
        kind = df.select(arguments[0].alias("x")).schema["x"].dataType.simpleString()
        if kind not in self.instances:
            raise Error(f"no instance of {self.name} for {kind}")
        return self.instances[kind](*arguments)
