import pytest
from pyspark.sql import functions as F

from lumenrel.plans import errors
from lumenrel.plans.printing import classic, tabular
from lumenrel.plans.query import from_, values
from lumenrel.plans.settings import Sys
from lumenrel.plans.text import Session
from lumenrel.plans.types import Checked, Datatype, Overload

NAT = Checked("nat", "int", (lambda i: i >= 0,))


def test_checked_types(spark):
    small = NAT.refined("small", lambda i: i < 10)
    q = values(spark, [-1, 3, 12], "int")
    assert q.yield_(lambda it: NAT.as_opt(it)).collect() == [None, 3, 12]
    assert small.scan(from_(i=q), "i").collect() == [3]
    with pytest.raises(Exception, match="nat"):
        q.yield_(lambda it: NAT.as_(it)).collect()


def test_datatypes(spark):
    shape = Datatype("shape", {"POINT": None, "CIRCLE": "double", "SQUARE": "double"})
    made = spark.range(3).select(F.when(F.col("id") == 0, shape.make("SQUARE", F.lit(2.0))).when(F.col("id") == 1, shape.make("POINT")).otherwise(shape.make("CIRCLE", F.lit(1.0))).alias("s"))
    area = shape.case(F.col("s"), POINT=lambda: F.lit(0.0), SQUARE=lambda a: a * a, CIRCLE=lambda r: r * 3.0)
    assert [r[0] for r in made.orderBy("s").select(area).collect()] == [0.0, 3.0, 4.0]
    assert shape.missing("POINT", "CIRCLE") == ["SQUARE"]
    with pytest.raises(Exception, match="Match"):
        made.select(shape.case(F.col("s"), POINT=lambda: F.lit(0.0))).collect()
    with pytest.raises(errors.Error):
        shape.make("LINE")


def test_overloads(spark):
    foo = Overload("foo")
    foo.inst("int")(lambda x: x + 1)
    foo.inst("string")(lambda x: F.concat(x, F.lit("!")))
    df = spark.createDataFrame([(1, "a", 1.0)], "i int, s string, d double")
    assert df.select(foo.resolve(df, F.col("i")), foo.resolve(df, F.col("s"))).first()[:] == (2, "a!")
    with pytest.raises(errors.Error):
        foo.resolve(df, F.col("d"))


def test_settings(spark):
    s = Session(spark, xs=spark.range(2))
    sys = Sys(spark, s.env)
    assert sys.show("lineWidth") == "79" and sys.show("showBanner") == "true" and len(sys.show_all()) == 27
    sys.set("lineWidth", 100)
    assert sys.get("lineWidth") == 100
    sys.unset("lineWidth")
    assert sys.get("lineWidth") == 79
    for bad in (lambda: sys.set("nothing", 1), lambda: sys.set("lineWidth", "wide")):
        with pytest.raises(errors.Fail):
            bad()
    assert sys.env() == [("xs", "Query")]
    sys.clear_env()
    assert sys.env() == [] and "Physical Plan" in Sys.plan(from_(i=values(spark, [1], "int")))


def test_printers(spark):
    assert classic([1, -2]) == "[1,~2]" and classic({"b": "x\"", "a": -1.5}) == '{a=~1.5,b="x\\""}' and classic(None) == "NONE" and classic(3, option=True) == "SOME 3" and classic(True) == "true" and classic(2.0) == "2.0"
    table = tabular(values(spark, [{"k": 1, "name": "abc"}, {"k": 20, "name": None}], "k int, name string"))
    assert table == " k name\n-- ----\n 1 abc\n20"
