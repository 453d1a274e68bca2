"""Queries: ordered lists and unordered bags of records, as steps over DataFrames.

A query is a DataFrame whose columns are its bindings (a scanned record is a struct column, so the optimizer sees
through it to the scan), plus an order. A bag has none. A list's order is a sequence of hidden sort columns, not a number: steps
extend or drop it, `take` becomes a top-k, and only `ordinal` numbers rows. Expressions are functions whose parameters are named
after bindings, e.g. `lambda e, d: e.deptno == d.deptno`.

Options are nullable columns; outer joins pack each side into a struct before joining, so an absent side (null) is told apart from a
present side with null fields.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrel.plans import errors
from lumenrel.plans.aggregates import Aggregate
from lumenrel.plans.storage import materialised

Expr = Callable[..., Any]
HIDDEN = "__o"
_fresh = itertools.count()


@dataclass(frozen=True)
class Desc:
    """A sort component in descending order."""

    of: Any


def column(x: Any) -> Column:
    """A value as an expression: a tuple has fields 1, 2, …, a query is the collection of its elements."""
    if isinstance(x, Column):
        return x
    if isinstance(x, Query):
        return x.array()
    if isinstance(x, tuple):
        return F.struct(*(column(v).alias(str(k + 1)) for k, v in enumerate(x)))
    if isinstance(x, list):
        return F.array(*map(column, x))
    return F.struct(*(column(v).alias(k) for k, v in sorted(x.items()))) if isinstance(x, Mapping) else F.lit(x)


@dataclass(frozen=True)
class Query:
    """Bindings of `df`, whether the element is the bare single binding (`atom`), and the sort columns of a list (None: a bag)."""

    df: DataFrame
    names: tuple[str, ...]
    atom: bool = False
    order_by: tuple[tuple[str, bool], ...] | None = None

    # -- expressions

    def _row(self, name: str) -> Column:
        if name == "current":
            return self.current
        if name not in self.names:
            raise errors.Error(f"unknown binding {name}; there are {', '.join(self.names)}")
        return F.col(f"`{name}`")

    @property
    def current(self) -> Column:
        """The current element: the bare value, or a record of the bindings in label order."""
        return F.col(f"`{self.names[0]}`") if self.atom else F.struct(*(F.col(f"`{n}`") for n in sorted(self.names)))

    def _call(self, f: Expr | Any) -> Any:
        return f(**{n: self._row(n) for n, p in inspect.signature(f).parameters.items() if p.kind is not p.VAR_KEYWORD}) if callable(f) else f

    def _value(self, f: Expr | Any) -> Column:
        return column(self._call(f))

    @property
    def ordered(self) -> bool:
        return self.order_by is not None

    def _hidden(self) -> list[str]:
        return [n for n, _ in self.order_by or ()]

    def _sorting(self) -> list[Column]:
        return [F.col(n).asc_nulls_first() if up else F.col(n).desc_nulls_last() for n, up in self.order_by or ()]

    def _with(self, df: DataFrame, names: Sequence[str], atom: bool = False) -> Query:
        return replace(self, df=df, names=tuple(names), atom=atom)

    # -- filter and projection

    def where(self, f: Expr) -> Query:
        if "ordinal" in inspect.signature(f).parameters:
            q = self.with_ordinal("ordinal")
            return replace(q, df=q.df.where(q._value(f)).drop("ordinal"), names=self.names, atom=self.atom)
        return replace(self, df=self.df.where(self._value(f)))

    def yield_(self, f: Expr | Mapping[str, Expr]) -> Query:
        """A record (dict) makes its fields the bindings; anything else is the element itself."""
        if callable(f) and "ordinal" in inspect.signature(f).parameters:
            return self.with_ordinal("ordinal")._yield(f)
        return self._yield(f)

    def _yield(self, f: Expr | Mapping[str, Expr]) -> Query:
        made = {k: self._value(v) for k, v in f.items()} if isinstance(f, Mapping) else self._call(f)
        keep = self._hidden()
        if isinstance(made, Mapping):
            return self._with(self.df.select(*(column(v).alias(k) for k, v in made.items()), *keep), list(made))
        return self._with(self.df.select(column(made).alias("it"), *keep), ["it"], atom=True)

    def bind(self, name: str, f: Expr | None = None) -> Query:
        """yield name = e: the whole element (or e) under one name."""
        value = self._value(f) if f else self.current
        return self._with(self.df.select(value.alias(name), *self._hidden()), [name], atom=True)

    def let(self, name: str, f: Expr) -> Query:
        """A scan of one value (p = e): a new binding beside the others."""
        return self._with(self.df.withColumn(name, self._value(f)), [*(n for n in self.names if n != name), name])

    def yield_all(self, f: Expr, name: str = "it") -> Query:
        """The elements of a collection computed from each row; rows with an empty one vanish."""
        place = f"{HIDDEN}{next(_fresh)}"
        if not self.ordered:
            return self._with(self.df.select(F.explode(self._value(f)).alias(name)), [name], atom=True)
        df = self.df.select(F.posexplode(self._value(f)).alias(place, name), *self._hidden())
        return Query(df, (name,), True, (*self.order_by, (place, True)))

    def extend(self, _lenient: bool = False, _skip: bool = False, **fields: Expr) -> Query:
        """Add fields, all computed from the row as it was; an existing one is an error unless skipped or replaced (`_lenient`)."""
        clash = [k for k in fields if k in self.names]
        if clash and not (_lenient or _skip):
            raise errors.Error(f"extend: already there: {clash}")
        made = {k: self._value(v) for k, v in fields.items() if not (_skip and k in self.names)}
        return self._with(self.df.withColumns(made), [*self.names, *(k for k in made if k not in self.names)])

    def replace_(self, _lenient: bool = False, **fields: Expr) -> Query:
        missing = [k for k in fields if k not in self.names]
        if missing and not _lenient:
            raise errors.Error(f"replace: not there: {missing}")
        return self._with(self.df.withColumns({k: self._value(v) for k, v in fields.items() if k in self.names}), self.names)

    def remove(self, *names: str, lenient: bool = False) -> Query:
        missing = [k for k in names if k not in self.names]
        if missing and not lenient:
            raise errors.Error(f"remove: not there: {missing}")
        return self._with(self.df.drop(*(n for n in names if n in self.names)), [n for n in self.names if n not in names])

    def rename(self, lenient: bool = False, **new: str) -> Query:
        """rename(new=old): all at once."""
        old = {v: k for k, v in new.items()}
        if [k for k in old if k not in self.names] and not lenient:
            raise errors.Error(f"rename: not there: {sorted(set(old) - set(self.names))}")
        return self._with(self.df.select(*(F.col(f"`{n}`").alias(old.get(n, n)) for n in self.names), *self._hidden()), [old.get(n, n) for n in self.names])

    # -- order

    def order(self, *keys: Expr | Desc) -> Query:
        """Stable sort; the result is a list. A record key sorts by its labels in alphabetical order, several keys as written."""
        made, columns = [], {}
        for k in keys:
            down = isinstance(k, Desc)
            value = self._call(k.of if down else k)
            if isinstance(value, Desc):
                down, value = True, value.of
            parts = [v for _, v in sorted(value.items())] if isinstance(value, Mapping) else [value]
            for v in parts:
                name = f"{HIDDEN}{next(_fresh)}"
                made.append((name, not (down or isinstance(v, Desc))))
                columns[name] = column(v.of if isinstance(v, Desc) else v)
        return replace(self, df=self.df.withColumns(columns), order_by=(*made, *(self.order_by or ())))

    def unorder(self) -> Query:
        return replace(self, df=self.df.drop(*self._hidden()), order_by=None)

    def sorted_df(self) -> DataFrame:
        return self.df.orderBy(*self._sorting()) if self.order_by else self.df

    def skip(self, n: int) -> Query:
        return replace(self, df=self.sorted_df().offset(n)) if n > 0 else self

    def take(self, n: int) -> Query:
        return replace(self, df=self.sorted_df().limit(max(0, n)))

    def numbered(self) -> Query:
        """A list ordered by one hidden number that ascends with the old order."""
        name = f"{HIDDEN}{next(_fresh)}"
        df = self.sorted_df().withColumn(name, F.monotonically_increasing_id()).drop(*self._hidden())
        return replace(self, df=df, order_by=((name, True),))

    def with_ordinal(self, name: str = "ordinal") -> Query:
        """A binding for the 0-based position of each row of a list, without bringing rows into one partition.

        The list is sorted and numbered by partition once, and written: a second run of the sort could cut its partitions elsewhere.
        """
        if not self.ordered:
            raise errors.Error("ordinal needs a list")
        q = self.numbered()
        at = q.order_by[0][0]
        sorted_once = materialised(q.df, "ordinal")
        part, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
        counts = sorted_once.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))  # a row a partition
        before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
        df = sorted_once.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(name, (F.col("__before") + place).cast("int")).drop("__p", "__before")
        return Query(df, (*self.names, name), False, q.order_by)

    def take_per(self, n: int, *keys: Expr, order: Sequence[Expr | Desc] = ()) -> Query:
        """The first n of each group, as a correlated `order … take n` gives them."""
        q = self.order(*order) if order else self
        w = Window.partitionBy(*(q._value(k) for k in keys)).orderBy(*q._sorting())
        return replace(q, df=q.df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank"))

    # -- joins

    def join(self, how: str = "inner", on: Expr | None = None, **source: Query | Expr) -> Query:
        """Scan another source (name=query), or a collection of each row (name=function), beside the bindings.

        how: inner, left, right or full. The absent side of an outer join is null.
        """
        ((name, of),) = source.items()
        if on is not None and "ordinal" in inspect.signature(on).parameters:
            return self._join_by_ordinal(name, of, how, on)
        if not isinstance(of, Query):
            return self._lateral(name, of, how, on)
        right = of.bind(name)
        if self.ordered and right.ordered and how in ("inner", "left"):
            order = (*self.order_by, *right.order_by)
        else:
            order = None if not (self.ordered and right.ordered) else (*self.order_by, *right.order_by)
        left = self
        if how in ("right", "full"):  # keep presence of the whole left row
            left = self._with(self.df.select(F.struct(*(F.col(f"`{n}`") for n in self.names)).alias("__l"), *self._hidden()), ["__l"])
        names = (*self.names, name)
        joined_row = {n: (F.col("__l").getField(n) if left is not self else F.col(f"`{n}`")) for n in self.names} | {name: F.col(f"`{name}`")}
        condition = None
        if on is not None:
            condition = column(on(**{p: joined_row[p] for p in inspect.signature(on).parameters}))
        rdf = right.df
        if order is None:
            left, rdf = replace(left, df=left.df.drop(*self._hidden())), rdf.drop(*right._hidden())
        if condition is None:
            df = left.df.crossJoin(rdf) if how == "inner" else left.df.join(rdf, F.lit(True), how)
        else:
            df = left.df.join(rdf, condition, how)
        if left.names == ("__l",):
            df = df.select(*(F.col("__l").getField(n).alias(n) for n in self.names), *(x for x in df.columns if x != "__l"))
        if order is not None and how in ("right", "full"):  # unmatched rows of the source come last
            last = f"{HIDDEN}{next(_fresh)}"
            df = df.withColumn(last, F.coalesce(*(F.col(n).isNotNull() for n in self._hidden()), F.lit(False)) == F.lit(False)) if self._hidden() else df
            order = ((last, True), *order) if self._hidden() else order
        return Query(df, names, False, order)

    def _join_by_ordinal(self, name: str, of: Query | Expr, how: str, on: Expr) -> Query:
        """A join whose condition reads the number of the candidate pair, counted over the whole join."""
        if how not in ("inner", "left"):
            raise errors.Error(f"ordinal can't be read in the condition of a {how} join")
        if how == "inner":
            return self.join("inner", **{name: of}).where(on)
        mine = self.numbered()
        at = mine.order_by[0][0]
        pairs = mine.let("__left", lambda **_: F.col(at)).join("inner", **{name: of}).where(on)
        met = pairs.df.select("__left", f"`{name}`", *pairs._hidden())
        df = mine.df.join(met, F.col(at) == F.col("__left"), "left").drop("__left")
        return Query(df, (*self.names, name), False, ((at, True), *pairs.order_by))

    def _lateral(self, name: str, f: Expr, how: str, on: Expr | None) -> Query:
        if how not in ("inner", "left"):
            raise errors.Error(f"{how} join needs an independent source")
        items = self._value(f)
        if on is not None:
            params = list(inspect.signature(on).parameters)
            items = F.filter(items, lambda x: column(on(**{p: x if p == name else self._row(p) for p in params})))
        place = f"{HIDDEN}{next(_fresh)}"
        made = (F.posexplode if how == "inner" else F.posexplode_outer)(items).alias(place, name)
        df = self.df.select("*", made)
        if not self.ordered:
            return Query(df.drop(place), (*self.names, name), False, None)
        return Query(df, (*self.names, name), False, (*self.order_by, (place, True)))

    def _semi(self, kind: str, of: Query, name: str, on: Expr | None) -> Query:
        right = of.bind(name).unorder()
        if on is None:
            return replace(self, df=self.df.join(right.df, F.lit(True), kind))
        row = {n: self._row(n) for n in self.names} | {name: F.col(f"`{name}`"), "current": self.current}
        return replace(self, df=self.df.join(right.df, column(on(**{p: row[p] for p in inspect.signature(on).parameters})), kind))

    def where_exists(self, of: Query, name: str = "x", on: Expr | None = None) -> Query:
        return self._semi("left_semi", of, name, on)

    def where_not_exists(self, of: Query, name: str = "x", on: Expr | None = None) -> Query:
        return self._semi("left_anti", of, name, on)

    def where_forall(self, of: Query, name: str, require: Expr, on: Expr | None = None) -> Query:
        """Rows for which all elements of `of` (that meet `on`) meet `require`."""
        def broken(**row):
            bad = ~column(require(**{p: row[p] for p in inspect.signature(require).parameters}))
            return bad if on is None else column(on(**{p: row[p] for p in inspect.signature(on).parameters})) & bad
        params = {p for f in (require, on) if f is not None for p in inspect.signature(f).parameters}
        broken.__signature__ = inspect.Signature([inspect.Parameter(p, inspect.Parameter.KEYWORD_ONLY) for p in sorted(params)])
        return self._semi("left_anti", of, name, broken)

    def where_elem(self, f: Expr, of: Query) -> Query:
        return self._member("left_semi", f, of)

    def where_notelem(self, f: Expr, of: Query) -> Query:
        return self._member("left_anti", f, of)

    def _member(self, kind: str, f: Expr, of: Query) -> Query:
        right = of.unorder().bind("__m").df
        return replace(self, df=self.df.join(right, self._value(f).eqNullSafe(F.col("__m")), kind))

    # -- groups

    def group(self, *keys: str | Expr, compute: Mapping[str, Aggregate] | None = None, **named: Expr) -> Query:
        """One row a distinct key (one in all without keys, even of an empty input); `compute` adds aggregates over each group's rows.

        A list's groups come in the order in which their keys first appear.
        """
        by = {(k if isinstance(k, str) else f"key{i}"): (F.col(f"`{k}`") if isinstance(k, str) else self._value(k)) for i, k in enumerate(keys)} | {k: self._value(v) for k, v in named.items()}
        made = {k: a.over(self) for k, a in (compute or {}).items()}
        aggregates = [v.alias(k) for k, v in made.items()]
        order = None
        if self.ordered and by:
            q = self.numbered() if len(self.order_by) != 1 or not self.order_by[0][1] else self
            first = q.order_by[0][0]
            made = {k: a.over(q) for k, a in (compute or {}).items()}
            df = q.df.groupBy(*(v.alias(k) for k, v in by.items())).agg(F.min(first).alias(first), *(v.alias(k) for k, v in made.items()))
            order = ((first, True),)
        elif by:
            keyed = self.df.groupBy(*(v.alias(k) for k, v in by.items()))
            df = keyed.agg(*aggregates) if aggregates else keyed.agg(F.count(F.lit(1)).alias("__n")).drop("__n")
        else:
            df = self.df.select(*aggregates) if aggregates else self.df.groupBy().agg(F.lit(0).alias("__unit")).select()
        return Query(df, (*by, *made), False, order)

    def compute(self, **aggregates: Aggregate) -> Query:
        """The whole input's aggregates, as one row."""
        return self.group(compute=aggregates)

    def distinct(self) -> Query:
        """One of each element; a list keeps the first."""
        if not self.ordered:
            return replace(self, df=self.df.select(*(f"`{n}`" for n in self.names)).distinct())
        q = self.numbered() if len(self.order_by) != 1 or not self.order_by[0][1] else self
        at = q.order_by[0][0]
        df = q.df.groupBy(*(f"`{n}`" for n in q.names)).agg(F.min(at).alias(at))
        return replace(q, df=df)

    # -- set operations

    def elements(self) -> Query:
        """The query with one column a field of its elements, in label order."""
        if self.atom and isinstance(self.df.schema[self.names[0]].dataType, T.StructType):
            n = self.names[0]
            fields = sorted(self.df.schema[n].dataType.fieldNames())
            return self._with(self.df.select(*(F.col(f"`{n}`").getField(f).alias(f) for f in fields), *self._hidden()), fields)
        return self._with(self.df.select(*(f"`{n}`" for n in sorted(self.names)), *self._hidden()), sorted(self.names), self.atom)

    def _aligned(self, other: Query) -> Query:
        o = other.elements()
        mine = self.names
        if o.atom and len(mine) == 1:
            o = o.rename(**{mine[0]: o.names[0]}) if o.names[0] != mine[0] else o
        if set(o.names) != set(mine):
            raise errors.Error(f"records differ: {sorted(mine)} and {sorted(o.names)}")
        return o

    def union(self, *others: Query, distinct: bool = False) -> Query:
        """All rows of this and then of each other; a list only if all are."""
        me = self.elements()
        all_ = [me, *(me._aligned(o) for o in others)]
        names = list(me.names)
        if all(q.ordered for q in all_):
            branch, place = (f"{HIDDEN}{next(_fresh)}" for _ in range(2))
            parts = []
            for k, q in enumerate(all_):
                q = q.numbered()
                parts.append(q.df.select(*(f"`{n}`" for n in names), F.lit(k).alias(branch), F.col(q.order_by[0][0]).alias(place)))
            out = Query(parts[0], me.names, me.atom, ((branch, True), (place, True)))
        else:
            parts = [q.df.select(*(f"`{n}`" for n in names)) for q in all_]
            out = Query(parts[0], me.names, me.atom, None)
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        out = replace(out, df=df)
        return out.distinct() if distinct else out

    def _occurrence(self, q: Query) -> DataFrame:
        """Rows numbered among their equals, in list order where there is one."""
        w = Window.partitionBy(*(f"`{n}`" for n in q.names)).orderBy(*(q._sorting() or [F.lit(1)]))
        return q.df.withColumn("__k", F.row_number().over(w))

    def _by_count(self, others: Sequence[Query], distinct: bool, keep_matched: bool) -> Query:
        me = self.elements()
        me = me.distinct() if distinct else me
        for o in others:
            o = me._aligned(o)
            counts = o.df.groupBy(*(F.col(f"`{n}`").alias(f"__r_{n}") for n in me.names)).agg(F.count(F.lit(1)).alias("__n"))
            on = [F.col(f"`{n}`").eqNullSafe(F.col(f"`__r_{n}`")) for n in me.names]
            condition = on[0]
            for x in on[1:]:
                condition &= x
            df = self._occurrence(me).join(counts, condition, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
            df = df.where(F.col("__k") <= F.col("__n")) if keep_matched else df.where(F.col("__k") > F.col("__n"))
            me = replace(me, df=df.select(*(f"`{n}`" for n in me.names), *me._hidden()))
            me = me if all(q.ordered for q in (me, o)) else me.unorder()
        return me

    def intersect(self, *others: Query, distinct: bool = False) -> Query:
        """Common rows with the least multiplicity; a list keeps the first ones, in its order."""
        if self.ordered and all(o.ordered for o in others):
            return self._by_count(others, distinct, True)
        me = self.elements().unorder()
        df = me.df.select(*(f"`{n}`" for n in me.names))
        for o in others:
            right = me._aligned(o).unorder().df.select(*(f"`{n}`" for n in me.names))
            df = df.intersect(right) if distinct else df.intersectAll(right)
        return replace(me, df=df)

    def except_(self, *others: Query, distinct: bool = False) -> Query:
        """Rows left after taking away each other's, one for one; from a list the first occurrences go."""
        if self.ordered and all(o.ordered for o in others):
            return self._by_count(others, distinct, False)
        me = self.elements().unorder()
        df = me.df.select(*(f"`{n}`" for n in me.names))
        for o in others:
            right = me._aligned(o).unorder().df.select(*(f"`{n}`" for n in me.names))
            df = df.subtract(right) if distinct else df.exceptAll(right)
        return replace(me, df=df)

    # -- composition and results

    def through(self, f: Callable[[Query], Query], name: str | None = None) -> Query:
        """from p in f(<so far>)."""
        out = f(self)
        return out.bind(name) if name else out

    def into(self, f: Callable[[Query], Any]) -> Any:
        return f(self)

    def exists(self, f: Expr | None = None) -> bool:
        q = self.where(f) if f else self
        return not q.df.limit(1).isEmpty()

    def forall(self, require: Expr) -> bool:
        return self.df.where(~self._value(require)).limit(1).isEmpty()

    def frame(self) -> DataFrame:
        """The elements as a DataFrame, one column a field; a list is sorted."""
        q = self.elements()
        return q.sorted_df().select(*(f"`{n}`" for n in q.names))

    def collect(self) -> list[Any]:
        rows = self.frame().collect()
        return [r[0] for r in rows] if self.atom and not isinstance(self.df.schema[self.names[0]].dataType, T.StructType) else rows

    def array(self) -> Column:
        """The elements as one collection, a scalar sub-query in an expression of another query; a list's are in its order."""
        held = F.collect_list(F.struct(*self._hidden(), self.current.alias("__it")))

        def before(a: Column, b: Column) -> Column:
            out = F.lit(0)
            for n, up in reversed(self.order_by or ()):
                x, y = (a, b) if up else (b, a)
                less = (x[n].isNull() & y[n].isNotNull()) | (x[n] < y[n])
                more = (y[n].isNull() & x[n].isNotNull()) | (y[n] < x[n])
                out = F.when(less, -1).when(more, 1).otherwise(out)
            return out
        return self.df.select(F.transform(F.array_sort(held, before) if self.order_by else held, lambda x: x["__it"]).alias("it")).scalar()

    def only(self) -> Any:
        rows = self.take(2).collect()
        if not rows:
            raise errors.Empty
        if len(rows) > 1:
            raise errors.Size
        return rows[0]

    def plan(self) -> str:
        return self.frame()._jdf.queryExecution().toString()


def bag(df: DataFrame) -> Query:
    """The rows of df, as a bag of records."""
    return Query(df, tuple(df.columns))


def list_(df: DataFrame, *order: str) -> Query:
    """The rows of df as a list, ordered by columns, or as they lie if none are given."""
    if order:
        return bag(df).order(*((lambda c: lambda **_: F.col(c))(x) for x in order))
    return bag(df.withColumn(at := f"{HIDDEN}{next(_fresh)}", F.monotonically_increasing_id()))._listed(at)


def _listed(self: Query, at: str) -> Query:
    return Query(self.df, tuple(n for n in self.names if n != at), self.atom, ((at, True),))


Query._listed = _listed


def from_(**source: Query) -> Query:
    """Scan sources, each under its name; several make a cross join in left-major order."""
    (name, first), *rest = source.items()
    q = first.bind(name)
    for name, other in rest:
        q = q.join(**{name: other})
    return q


def values(spark: SparkSession, items: Sequence[Any], schema: str | None = None, ordered: bool = True) -> Query:
    """A literal list (or bag) of atoms, or of records given as dicts."""
    at = f"{HIDDEN}{next(_fresh)}"
    if items and isinstance(items[0], Mapping):
        names = sorted(items[0])
        df = spark.createDataFrame([(*(x[n] for n in names), i) for i, x in enumerate(items)], schema and f"{schema}, {at} long" or [*names, at])
        q = Query(df, tuple(n for n in df.columns if n != at), False, ((at, True),))
    else:
        df = spark.createDataFrame([(x, i) for i, x in enumerate(items)], f"it {schema or _kind_of(items)}, {at} long")
        q = Query(df, ("it",), True, ((at, True),))
    return q if ordered else q.unorder()


def _kind_of(items: Sequence[Any]) -> str:
    first = next((x for x in items if x is not None and x != []), None)
    if isinstance(first, list):
        return f"array<{_kind_of([y for x in items for y in x or ()])}>"
    if isinstance(first, tuple):
        return "struct<" + ", ".join(f"`{k + 1}`: {_kind_of([x[k] for x in items if x is not None])}" for k in range(len(first))) + ">"
    if isinstance(first, Mapping):
        return "struct<" + ", ".join(f"`{k}`: {_kind_of([x[k] for x in items if x is not None])}" for k in sorted(first)) + ">"
    return {bool: "boolean", int: "int", float: "double", str: "string"}.get(type(first), "array<int>" if items and items[0] == [] else "int")


def range_(spark: SparkSession, low: int, high: int, ordered: bool = True) -> Query:
    """The ints low..high, both included."""
    at = f"{HIDDEN}{next(_fresh)}"
    df = spark.range(low, high + 1).select(F.col("id").cast("int").alias("it"), F.col("id").alias(at))
    q = Query(df, ("it",), True, ((at, True),))
    return q if ordered else q.unorder()


def unit(spark: SparkSession) -> Query:
    """The empty `from`: one row without bindings."""
    return Query(spark.range(1).select(), ())
