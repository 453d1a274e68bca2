"""Steps, on small literals: order, multiplicity, options and errors."""

import pytest
from pyspark.sql import functions as F

from lumenrel.operators.fixpoint import iterate
from lumenrel.plans import aggregates as A
from lumenrel.plans import errors, invert
from lumenrel.plans.query import Desc, bag, from_, range_, unit, values
from lumenrel.sources.files import Scott


@pytest.fixture(scope="module")
def scott(spark):
    return Scott(spark)


def ints(spark, *xs, ordered=True):
    return values(spark, list(xs), "int", ordered)


def test_list_set_operations_keep_the_left_order(spark):
    assert ints(spark, 3, 2, 1, 3, 2).intersect(ints(spark, 2, 3, 2, 4)).collect() == [3, 2, 2]
    assert ints(spark, 1, 2, 3, 4, 5, 1, 5, 1, 2).except_(ints(spark, 2, 4)).collect() == [1, 3, 5, 1, 5, 1, 2]
    assert ints(spark, 2, 1, 2).except_(ints(spark, 2), distinct=True).collect() == [1]
    assert ints(spark, 3, 1).union(ints(spark, 2, 1), ints(spark, 9)).collect() == [3, 1, 2, 1, 9]
    assert ints(spark, 3, 1).union(ints(spark, 1, 4), distinct=True).collect() == [3, 1, 4]


def test_a_bag_makes_the_result_a_bag(spark):
    q = ints(spark, 3, 1).union(ints(spark, 1, ordered=False))
    assert not q.ordered and sorted(q.collect()) == [1, 1, 3]


def test_bag_multiplicity(spark):
    a, b = ints(spark, 1, 1, 2, ordered=False), ints(spark, 1, 2, 2, ordered=False)
    assert sorted(a.intersect(b).collect()) == [1, 2]
    assert sorted(a.except_(b).collect()) == [1]


def test_outer_joins_tell_absent_from_null(spark):
    a = values(spark, [{"i": 1}, {"i": 2}, {"i": 3}], "i int")
    b = values(spark, [{"j": 1, "v": None}, {"j": 2, "v": 5}], "j int, v int")
    q = from_(a=a).join("left", b=b, on=lambda a, b: a.i == b.j).yield_({"i": lambda a: a.i, "there": lambda b: b.isNotNull(), "v": lambda b: b.v})
    assert [tuple(r) for r in q.frame().select("i", "there", "v").collect()] == [(1, True, None), (2, True, 5), (3, False, None)]
    q = from_(a=a).join("right", b=values(spark, [{"j": 2}, {"j": 9}], "j int"), on=lambda a, b: a.i == b.j)
    assert sorted((r.a is not None, r.b.j) for r in q.frame().collect()) == [(False, 9), (True, 2)]
    q = from_(a=a.unorder()).join("full", b=values(spark, [{"j": 2}, {"j": 9}], "j int", ordered=False), on=lambda a, b: a.i == b.j)
    assert q.df.count() == 4


def test_group_in_first_seen_order_and_empty_group(spark):
    q = values(spark, [{"k": 2, "v": 1}, {"k": 1, "v": 5}, {"k": 2, "v": 3}], "k int, v int")
    g = q.group("k", compute={"n": A.count(), "s": A.sum_(lambda v: v), "vs": A.elements(lambda v: v), "first": A.min_by(lambda k: k, lambda v: v)})
    assert [tuple(r) for r in g.frame().select("k", "n", "s", "vs", "first").collect()] == [(2, 2, 4, [1, 3], 1), (1, 1, 5, [5], 5)]
    none = q.where(lambda k: k > 5)
    assert none.group(compute={"n": A.count(), "s": A.sum_(lambda v: v)}).frame().collect()[0].asDict() == {"n": 0, "s": 0}
    assert none.group().df.count() == 1
    with pytest.raises(Exception, match="Empty"):
        none.compute(m=A.max_(lambda v: v)).frame().collect()


def test_order_is_stable_and_record_keys_sort_by_label(spark):
    q = values(spark, [{"a": 1, "b": "x"}, {"a": 2, "b": "a"}, {"a": 1, "b": "c"}, {"a": 2, "b": "b"}], "a int, b string")
    assert [r.b for r in q.order(Desc(lambda a: a)).frame().collect()] == ["a", "b", "x", "c"]
    by_record = lambda a, b: {"z": a, "b": Desc(b)}
    assert [r.b for r in q.order(by_record).frame().collect()] == ["x", "c", "b", "a"]
    assert [r.b for r in q.order(lambda b: b).skip(1).take(2).frame().collect()] == ["b", "c"]


def test_ordinals(spark):
    q = ints(spark, 5, 6, 7, 8).where(lambda ordinal: ordinal < 3)
    assert q.collect() == [5, 6, 7]
    assert q.yield_(lambda it, ordinal: it * 10 + ordinal).collect() == [50, 61, 72]
    with pytest.raises(errors.Error):
        ints(spark, 1, ordered=False).with_ordinal()


def test_lateral_and_yield_all(spark):
    orders = bag(spark.createDataFrame([(1, [3, 4]), (2, []), (3, [9])], "id int, items array<int>"))
    q = from_(o=orders).join(i=lambda o: o["items"]).yield_({"id": lambda o: o.id, "i": lambda i: i})
    assert sorted((r.id, r.i) for r in q.frame().collect()) == [(1, 3), (1, 4), (3, 9)]
    q = from_(o=orders).join("left", i=lambda o: o["items"], on=lambda i: i > 3).yield_({"id": lambda o: o.id, "i": lambda i: i})
    assert sorted((r.id, r.i or 0) for r in q.frame().collect()) == [(1, 4), (2, 0), (3, 9)]
    assert sorted(from_(o=orders).yield_all(lambda o: o["items"]).collect()) == [3, 4, 9]


def test_record_modifiers(spark):
    q = values(spark, [{"a": 1, "b": 2}], "a int, b int")
    assert q.extend(c=lambda a: a + 1).replace_(a=lambda b: b).remove("b").rename(d="c").frame().collect()[0].asDict() == {"a": 2, "d": 2}
    assert q.rename(a="b", b="a").frame().collect()[0].asDict() == {"a": 2, "b": 1}
    with pytest.raises(errors.Error):
        q.extend(a=lambda b: b)
    assert q.extend(_skip=True, a=lambda b: b).frame().collect()[0].a == 1
    assert q.remove("zz", lenient=True).names == ("a", "b")


def test_sample_database(scott):
    emps, depts = bag(scott.emps), bag(scott.depts)
    q = from_(d=depts).join("left", e=emps, on=lambda d, e: d.deptno == e.deptno).group(d=lambda d: d.deptno, compute={"n": A.sum_(lambda e: F.when(e.isNotNull(), 1).otherwise(0))})
    assert sorted(tuple(r) for r in q.frame().select("d", "n").collect()) == [(10, 3), (20, 5), (30, 6), (40, 0)]
    assert from_(d=depts).where_not_exists(emps, "e", on=lambda d, e: d.deptno == e.deptno).yield_(lambda d: d.dname).collect() == ["OPERATIONS"]
    assert from_(d=depts).where_forall(emps, "e", require=lambda e: e.sal > 900, on=lambda d, e: d.deptno == e.deptno).df.count() == 3
    assert from_(e=emps).exists(lambda e: e.job == "PRESIDENT") and from_(e=emps).forall(lambda e: e.sal > 100)
    top = from_(e=emps).order(Desc(lambda e: e.sal), lambda e: e.ename).take(2).yield_(lambda e: e.ename)
    assert top.collect() == ["KING", "FORD"]


def test_small_things(spark):
    assert unit(spark).df.count() == 1
    assert range_(spark, 3, 5).collect() == [3, 4, 5]
    assert ints(spark, 4).only() == 4
    with pytest.raises(errors.Size):
        ints(spark, 4, 5).only()
    with pytest.raises(errors.Empty):
        ints(spark, 4).where(lambda it: it > 9).only()
    assert ints(spark, 1, 2).through(lambda q: q.where(lambda it: it > 1), "x").yield_(lambda x: x + 1).collect() == [3]


def test_iterate_terminates_on_a_cycle(spark):
    edges = bag(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int"))
    assert invert.reachable(edges).df.count() == 9
    counted = iterate(values(spark, [1, 1], "int", ordered=False), lambda _, new: new.where(lambda it: it < 4).yield_(lambda it: it + 1))
    assert sorted(counted.collect()) == [1, 1, 2, 3, 4]


def test_inverted_scans(spark):
    x, y, s, b = invert.var("x"), invert.var("y"), invert.var("s", "string"), invert.var("b", "bool")
    assert invert.solve(spark, x, where=(x > 0) & (x < 4)).collect() == [1, 2, 3]
    assert [tuple(r) for r in invert.solve(spark, x, y, where=(x >= 1) & (x <= 2) & y.eq(x * 10)).frame().collect()] == [(1, 10), (2, 20)]
    assert invert.solve(spark, s, where=s.prefix_of("abc")).collect() == ["", "a", "ab", "abc"]
    assert invert.solve(spark, x, where=x.eq(3) | ((x > 7) & (x < 10))).collect() == [3, 8, 9]
    assert invert.solve(spark, b, where=b.eq(True) | ~b.eq(True)).collect() == [False, True]
    assert len(invert.solve(spark, x, y, where=(x >= 0) & (y >= 0) & (x + y <= 3)).frame().collect()) == 10
    with pytest.raises(errors.Error, match="cannot enumerate"):
        invert.solve(spark, x, where=x > 3)
