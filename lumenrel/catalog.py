"""The registered queries of the engine itself, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrel import library_queries
from lumenrel.functions import library
from lumenrel.operators import datalog
from lumenrel.operators.fixpoint import iterate
from lumenrel.plans import aggregates as A
from lumenrel.plans import invert as V
from lumenrel.plans.query import Desc, Query, bag, from_, range_
from lumenrel.plans.text import Session
from lumenrel.plans.types import Checked, Datatype
from lumenrel.sources.files import parquet

Made = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Made] = {}
_sql: dict[str, str] = {}
L = library


def query(sql: str | None = None):
    def add(f: Made) -> Made:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f
    return add


def scan(spark: SparkSession, sf_dir: str, name: str) -> Query:
    return bag(parquet(spark, sf_dir, name))


def list_of(spark: SparkSession, sf_dir: str, name: str, key: str) -> Query:
    return bag(parquet(spark, sf_dir, name)).order(lambda **_: F.col(key))


FLAGSHIP = "SELECT l_returnflag, count(*) AS c, sum(l_quantity) AS q FROM lineitem WHERE l_quantity > 30 GROUP BY 1"


@query(FLAGSHIP)
def scan_filter_group(spark, d):
    q = from_(l=scan(spark, d, "lineitem")).where(lambda l: l.l_quantity > 30.0)
    return q.group(l_returnflag=lambda l: l.l_returnflag, compute={"c": A.count(), "q": A.sum_(lambda l: l.l_quantity)}).order(lambda l_returnflag: l_returnflag).frame()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_filter_group(spark, sf_dir)


@query("SELECT o_orderkey, o_totalprice * 2 AS double_price FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_filter_project(spark, d):
    q = from_(o=scan(spark, d, "orders")).where(lambda o: (o.o_orderstatus == "F") & (o.o_totalprice > 100000))
    return q.yield_({"o_orderkey": lambda o: o.o_orderkey, "double_price": lambda o: o.o_totalprice * 2}).frame()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_take(spark, d):
    q = from_(o=scan(spark, d, "orders")).order(Desc(lambda o: o.o_totalprice), lambda o: o.o_orderkey).take(25)
    return q.yield_({"o_orderkey": lambda o: o.o_orderkey, "o_totalprice": lambda o: o.o_totalprice}).frame()


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 40 OFFSET 10")
def skip_take(spark, d):
    q = from_(c=scan(spark, d, "customer")).order(lambda c: c.c_acctbal, lambda c: c.c_custkey).skip(10).take(40)
    return q.yield_({"c_custkey": lambda c: c.c_custkey}).frame()


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(spark, d):
    q = from_(r=scan(spark, d, "region"), n=scan(spark, d, "nation"))
    return q.yield_({"r_name": lambda r: r.r_name, "n_name": lambda n: n.n_name}).frame()


@query("SELECT n_name, count(*) AS n_orders, sum(round(o_totalprice * 100)::BIGINT)::BIGINT / 100.0::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def inner_join(spark, d):
    q = from_(o=scan(spark, d, "orders")).join(c=scan(spark, d, "customer"), on=lambda o, c: o.o_custkey == c.c_custkey).join(n=scan(spark, d, "nation"), on=lambda c, n: c.c_nationkey == n.n_nationkey)
    return q.group(n_name=lambda n: n.n_name, compute={"n_orders": A.count(), "total": A.sum_(lambda o: F.round(o.o_totalprice * 100).cast("long"))}).extend(t=lambda total: total / 100.0).remove("total").rename(total="t").frame()


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def theta_join(spark, d):
    q = from_(x=scan(spark, d, "nation")).join(y=scan(spark, d, "nation"), on=lambda x, y: (x.n_regionkey < y.n_regionkey) & (x.n_nationkey < y.n_nationkey))
    return q.yield_({"a": lambda x: x.n_name, "b": lambda y: y.n_name}).frame()


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def left_join(spark, d):
    q = from_(c=scan(spark, d, "customer")).join("left", o=scan(spark, d, "orders"), on=lambda c, o: (c.c_custkey == o.o_custkey) & (o.o_orderstatus == "F"))
    return q.group(c_custkey=lambda c: c.c_custkey, compute={"n": A.sum_(lambda o: F.when(o.isNotNull(), 1).otherwise(0))}).frame()


@query("SELECT s_suppkey, c_custkey FROM customer RIGHT JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal > 9000")
def right_join(spark, d):
    q = from_(c=scan(spark, d, "customer")).join("right", s=scan(spark, d, "supplier"), on=lambda c, s: (c.c_nationkey == s.s_nationkey) & (c.c_acctbal > 9000))
    return q.yield_({"s_suppkey": lambda s: s.s_suppkey, "c_custkey": lambda c: c.c_custkey}).frame()


@query("SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 9000) c FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON c_nationkey = s_nationkey AND c_custkey % 7 = s_suppkey % 7")
def full_join(spark, d):
    c = from_(c=scan(spark, d, "customer")).where(lambda c: c.c_acctbal > 9000)
    s = from_(s=scan(spark, d, "supplier")).where(lambda s: s.s_acctbal > 5000)
    q = c.join("full", s=s, on=lambda c, s: (c.c_nationkey == s.s_nationkey) & (c.c_custkey % 7 == s.s_suppkey % 7))
    return q.yield_({"c_custkey": lambda c: c.c_custkey, "s_suppkey": lambda s: s.s_suppkey}).frame()


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semi_elem(spark, d):
    keys = from_(n=scan(spark, d, "nation")).where(lambda n: n.n_regionkey == 1).yield_(lambda n: n.n_nationkey)
    return from_(c=scan(spark, d, "customer")).where_elem(lambda c: c.c_nationkey, keys).yield_({"c_custkey": lambda c: c.c_custkey}).frame()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_notelem(spark, d):
    keys = from_(o=scan(spark, d, "orders")).where(lambda o: o.o_totalprice > 200000).yield_(lambda o: o.o_custkey)
    return from_(c=scan(spark, d, "customer")).where_notelem(lambda c: c.c_custkey, keys).yield_({"c_custkey": lambda c: c.c_custkey}).frame()


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def exists_correlated(spark, d):
    q = from_(o=scan(spark, d, "orders")).where_exists(scan(spark, d, "lineitem"), "l", on=lambda o, l: (o.o_orderkey == l.l_orderkey) & (l.l_quantity > 49))
    return q.yield_({"o_orderkey": lambda o: o.o_orderkey}).frame()


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_quantity > 10))")
def forall_require(spark, d):
    q = from_(o=scan(spark, d, "orders")).where_forall(scan(spark, d, "lineitem"), "l", require=lambda l: l.l_quantity > 10, on=lambda o, l: o.o_orderkey == l.l_orderkey)
    return q.yield_({"o_orderkey": lambda o: o.o_orderkey}).frame()


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
def group_composite(spark, d):
    q = from_(c=scan(spark, d, "customer"))
    return q.group(c_mktsegment=lambda c: c.c_mktsegment, c_nationkey=lambda c: c.c_nationkey, compute={"n": A.count()}).frame()


@query("SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY n")
def group_then_group(spark, d):
    q = from_(o=scan(spark, d, "orders")).group(cust=lambda o: o.o_custkey, compute={"n": A.count()})
    return q.group("n", compute={"customers": A.count()}).frame()


@query("SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 200")
def group_having(spark, d):
    q = from_(l=scan(spark, d, "lineitem")).group(l_orderkey=lambda l: l.l_orderkey, compute={"q": A.sum_(lambda l: l.l_quantity)})
    return q.where(lambda q: q > 200).frame()


@query("SELECT count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, (1 + sum(l_linenumber * 2))::BIGINT AS s FROM lineitem")
def compute_scalar(spark, d):
    q = from_(l=scan(spark, d, "lineitem"))
    return q.compute(n=A.count(), lo=A.min_(lambda l: l.l_quantity), hi=A.max_(lambda l: l.l_quantity), s=A.sum_(lambda l: l.l_linenumber * 2) + 1).frame()


@query("SELECT count(*) AS n, coalesce(sum(l_linenumber), 0)::BIGINT AS s FROM lineitem WHERE l_quantity < 0")
def group_empty_input(spark, d):
    return from_(l=scan(spark, d, "lineitem")).where(lambda l: l.l_quantity < 0).group(compute={"n": A.count(), "s": A.sum_(lambda l: l.l_linenumber)}).frame()


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct(spark, d):
    return from_(p=scan(spark, d, "part")).yield_({"p_brand": lambda p: p.p_brand, "p_size": lambda p: p.p_size}).distinct().frame()


@query("SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS dearest FROM part GROUP BY p_brand")
def min_by_max_by(spark, d):
    q = list_of(spark, d, "part", "p_partkey")
    return q.group("p_brand", compute={"cheapest": A.min_by(lambda p_retailprice: p_retailprice, lambda p_partkey: p_partkey), "dearest": A.max_by(lambda p_retailprice: p_retailprice, lambda p_partkey: p_partkey)}).frame()


@query("SELECT r_regionkey, any_value(r_name) AS name FROM region GROUP BY 1")
def only(spark, d):
    return from_(r=scan(spark, d, "region")).group(r_regionkey=lambda r: r.r_regionkey, compute={"name": A.only(lambda r: r.r_name)}).frame()


def _keys(spark, d, table, column):
    return from_(x=scan(spark, d, table)).yield_({"k": lambda x: x[column].cast("long")})


@query("SELECT c_nationkey::BIGINT AS k FROM customer UNION ALL SELECT s_nationkey::BIGINT FROM supplier UNION ALL SELECT n_nationkey::BIGINT FROM nation")
def union_all(spark, d):
    return _keys(spark, d, "customer", "c_nationkey").union(_keys(spark, d, "supplier", "s_nationkey"), _keys(spark, d, "nation", "n_nationkey")).frame()


@query("SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT o_custkey FROM orders")
def union_distinct(spark, d):
    return _keys(spark, d, "customer", "c_nationkey").union(_keys(spark, d, "orders", "o_custkey"), distinct=True).frame()


@query("SELECT c_nationkey::BIGINT AS k FROM customer INTERSECT ALL SELECT s_nationkey::BIGINT FROM supplier")
def intersect_all(spark, d):
    return _keys(spark, d, "customer", "c_nationkey").intersect(_keys(spark, d, "supplier", "s_nationkey")).frame()


@query("SELECT c_custkey::BIGINT AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_distinct(spark, d):
    return _keys(spark, d, "customer", "c_custkey").intersect(_keys(spark, d, "orders", "o_custkey"), distinct=True).frame()


@query("SELECT c_nationkey::BIGINT AS k FROM customer EXCEPT ALL SELECT s_nationkey::BIGINT FROM supplier")
def except_all(spark, d):
    return _keys(spark, d, "customer", "c_nationkey").except_(_keys(spark, d, "supplier", "s_nationkey")).frame()


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def except_distinct(spark, d):
    large = from_(x=scan(spark, d, "lineitem")).where(lambda x: x.l_quantity > 40).yield_({"k": lambda x: x.l_partkey.cast("long")})
    return _keys(spark, d, "orders", "o_custkey").except_(large, distinct=True).frame()


@query("""SELECT k, o FROM (SELECT k, o, row_number() OVER (PARTITION BY k ORDER BY o) AS rn FROM (SELECT c_nationkey::BIGINT AS k, c_custkey AS o FROM customer)) a
LEFT JOIN (SELECT s_nationkey::BIGINT AS rk, count(*) AS n FROM supplier GROUP BY 1) b ON k = rk WHERE rn > coalesce(n, 0)""")
def except_list(spark, d):
    """Which duplicates of an ordered list survive is defined; the position is carried along to show it."""
    mine = bag(parquet(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k"), F.col("c_custkey").alias("o"))).order(lambda o: o)
    keyed = mine.yield_({"k": lambda k: k})
    order = keyed.order_by[0][0]
    other = bag(parquet(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k"), F.col("s_suppkey").alias("o"))).order(lambda o: o).yield_({"k": lambda k: k})
    return keyed.except_(other).df.select("k", F.col(order).alias("o"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def yield_all(spark, d):
    q = from_(x=scan(spark, d, "documents")).yield_all(lambda x: F.split(x.text, " "), name="word").where(lambda word: word != "")
    return q.group("word", compute={"n": A.count()}).frame()


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS os FROM orders GROUP BY 1")
def elements_collect(spark, d):
    return list_of(spark, d, "orders", "o_orderkey").group("o_custkey", compute={"os": A.elements(lambda o_orderkey: o_orderkey)}).frame()


@query("SELECT l_orderkey, sum(l_linenumber * l_linenumber)::BIGINT AS squares FROM lineitem GROUP BY 1")
def udaf_fold(spark, d):
    q = from_(l=scan(spark, d, "lineitem"))
    return q.group(l_orderkey=lambda l: l.l_orderkey, compute={"squares": A.fold(lambda l: l.l_linenumber, F.lit(0).cast("long"), lambda a, x: a + x * x)}).frame()


@query("SELECT (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1)::INTEGER AS ordinal, o_orderkey FROM orders")
def ordinal(spark, d):
    q = bag(parquet(spark, d, "orders").select("o_orderkey", "o_totalprice")).order(lambda o_totalprice: o_totalprice, lambda o_orderkey: o_orderkey)
    return q.with_ordinal().remove("o_totalprice").frame()


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM orders) WHERE i % 3 = 1")
def where_ordinal(spark, d):
    q = bag(parquet(spark, d, "orders").select("o_orderkey", "o_totalprice")).order(lambda o_totalprice: o_totalprice, lambda o_orderkey: o_orderkey)
    return q.where(lambda ordinal: ordinal % 3 == 1).remove("o_totalprice").frame()


@query("SELECT n, r FROM (SELECT n_nationkey AS n, r_regionkey AS r, row_number() OVER (ORDER BY n_nationkey, r_regionkey) - 1 AS i FROM nation, region) WHERE (i * i) % 7 = 2")
def join_on_ordinal(spark, d):
    q = from_(n=list_of(spark, d, "nation", "n_nationkey")).join(r=list_of(spark, d, "region", "r_regionkey"), on=lambda ordinal: ordinal * ordinal % 7 == 2)
    return q.yield_({"n": lambda n: n.n_nationkey, "r": lambda r: r.r_regionkey}).frame()


@query("SELECT n, r FROM nation_keys LEFT JOIN (SELECT n AS m, r FROM (SELECT n_nationkey AS n, r_regionkey AS r, row_number() OVER (ORDER BY n_nationkey, r_regionkey) - 1 AS i FROM nation, region) WHERE i % 9 = 4) ON n = m".replace("nation_keys", "(SELECT n_nationkey AS n FROM nation)"))
def left_join_on_ordinal(spark, d):
    q = from_(n=list_of(spark, d, "nation", "n_nationkey")).join("left", r=list_of(spark, d, "region", "r_regionkey"), on=lambda ordinal: ordinal % 9 == 4)
    return q.yield_({"n": lambda n: n.n_nationkey, "r": lambda r: r.r_regionkey}).frame()


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def per_group_take(spark, d):
    q = bag(parquet(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"))
    return q.take_per(2, lambda o_custkey: o_custkey, order=[Desc(lambda o_totalprice: o_totalprice), lambda o_orderkey: o_orderkey]).remove("o_totalprice").frame()


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1")
def through_into(spark, d):
    big = lambda q: q.where(lambda n_nationkey: n_nationkey > 3)
    return scan(spark, d, "nation").through(big).into(lambda q: q.group("n_regionkey", compute={"n": A.count()})).frame()


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS a, n_nationkey % 5 AS b FROM nation), p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT a, b FROM p""")
def iterate_closure(spark, d):
    edges = bag(parquet(spark, d, "nation").select(F.col("n_regionkey").alias("a"), (F.col("n_nationkey") % 5).alias("b")).distinct())

    def step(_, new):
        q = from_(p=new).join(e=edges, on=lambda p, e: p.b == e.a)
        return q.yield_({"a": lambda p: p.a, "b": lambda e: e.b})

    return iterate(edges, step).frame()


PROGRAM = """
.decl edge(x: int, y: int)
.decl path(x: int, y: int)
.decl far(x: int, y: int)
.input edge
path(X, Y) :- edge(X, Y).
path(X, Z) :- path(X, Y), edge(Y, Z).
far(X, Y) :- path(X, Y), !edge(X, Y), X != Y.
.output far
"""


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS x, (n_nationkey * 3 + 1) % 25 AS y FROM nation), p AS (SELECT x, y FROM e UNION SELECT p.x, e.y FROM p JOIN e ON p.y = e.x) SELECT x, y FROM p WHERE x <> y AND (x, y) NOT IN (SELECT (x, y) FROM e)""")
def datalog_closure(spark, d):
    edges = parquet(spark, d, "nation").select(F.col("n_nationkey").alias("x"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("y"))
    return datalog.execute(spark, PROGRAM, {"edge": edges})["far"]


@query("SELECT x::INTEGER AS x, y::INTEGER AS y FROM range(1, 40) a(x), range(1, 40) b(y) WHERE x + y < 40 AND x * 2 > y")
def inverted_range(spark, d):
    x, y = V.var("x"), V.var("y")
    return V.solve(spark, x, y, where=(x > 0) & (y > 0) & (x + y < 40) & (2 * x > y)).frame()


@query("SELECT DISTINCT n_nationkey AS k FROM nation WHERE n_nationkey > 5 AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
def inverted_elem(spark, d):
    k = V.var("k")
    nations = from_(n=scan(spark, d, "nation")).yield_(lambda n: n.n_nationkey)
    suppliers = from_(s=scan(spark, d, "supplier")).yield_(lambda s: s.s_nationkey)
    return V.solve(spark, k, where=k.elem(nations) & k.elem(suppliers) & (k > 5)).frame()


@query("SELECT DISTINCT a.n_regionkey AS r FROM nation a WHERE a.n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def inverted_exists(spark, d):
    r, k = V.var("r"), V.var("k")
    pairs = from_(n=scan(spark, d, "nation")).yield_({"k": lambda n: n.n_nationkey, "r": lambda n: n.n_regionkey})
    rich = from_(c=scan(spark, d, "customer")).where(lambda c: c.c_acctbal > 9900).yield_(lambda c: c.c_nationkey)
    return V.solve(spark, r, where=V.exists(k, where=V.member([k, r], pairs) & k.elem(rich))).frame()


@query("SELECT i::INTEGER AS i FROM range(1, 11) t(i)")
def int_range(spark, d):
    return range_(spark, 1, 10).rename(i="it").frame()


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS kind FROM customer")
def case_expr(spark, d):
    q = from_(c=scan(spark, d, "customer"))
    return q.yield_({"c_custkey": lambda c: c.c_custkey, "kind": lambda c: F.when(c.c_acctbal < 0, "debt").when(c.c_acctbal < 5000, "some").otherwise("rich")}).frame()


@query("SELECT n_name AS name, n_regionkey + 1 AS n_regionkey, n_nationkey * 2 AS twice FROM nation")
def record_modifiers(spark, d):
    q = scan(spark, d, "nation").extend(twice=lambda n_nationkey: n_nationkey * 2).replace_(n_regionkey=lambda n_regionkey: n_regionkey + 1)
    return q.remove("n_nationkey").rename(name="n_name").frame()


@query("SELECT c_custkey, coalesce(o_orderkey, -1) AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
def option_getopt(spark, d):
    q = from_(c=scan(spark, d, "customer")).join("left", o=scan(spark, d, "orders"), on=lambda c, o: (c.c_custkey == o.o_custkey) & (o.o_totalprice > 400000))
    return q.yield_({"c_custkey": lambda c: c.c_custkey, "o": lambda o: L["Option"]["getOpt"](o.o_orderkey, F.lit(-1).cast("long"))}).frame()


@query("""SELECT n_nationkey AS k, length(n_name) AS size, substr(n_name, 1, 2) AS pre, starts_with(n_name, 'A') AS a, contains(n_name, 'N') AS has_n, ends_with(n_name, 'A') AS ends_a,
CASE WHEN n_name < 'M' THEN -1 WHEN n_name = 'M' THEN 0 ELSE 1 END AS cmp, n_name || '!' AS cat, upper(n_name) AS up FROM nation""")
def string_functions(spark, d):
    s = L["String"]
    q = from_(n=scan(spark, d, "nation"))
    name = {"size": s["size"], "pre": lambda x: s["substring"](x, F.lit(0), F.lit(2)), "a": lambda x: s["isPrefix"](F.lit("A"), x), "has_n": lambda x: s["isSubstring"](F.lit("N"), x), "ends_a": lambda x: s["isSuffix"](F.lit("A"), x), "cmp": lambda x: s["compare"](x, F.lit("M")), "cat": lambda x: s["^"](x, F.lit("!")), "up": lambda x: s["map"](L["Char"]["toUpper"], x)}
    return q.yield_({"k": lambda n: n.n_nationkey} | {k: (lambda f: lambda n: f(n.n_name))(f) for k, f in name.items()}).frame()


@query("""SELECT k, floor(k / b)::INTEGER AS d, (k - b * floor(k / b))::INTEGER AS m, trunc(k / b)::INTEGER AS q, (k % b)::INTEGER AS r, CASE WHEN k < 0 THEN '~' || (-k)::VARCHAR ELSE k::VARCHAR END AS t
FROM (SELECT (l_orderkey % 41 - 20)::INTEGER AS k, CASE WHEN l_linenumber % 2 = 0 THEN -7 ELSE 5 END AS b FROM lineitem)""")
def int_functions(spark, d):
    i = L["Int"]
    q = bag(parquet(spark, d, "lineitem").select((F.col("l_orderkey") % 41 - 20).cast("int").alias("k"), F.when(F.col("l_linenumber") % 2 == 0, -7).otherwise(5).alias("b")))
    return q.yield_({"k": lambda k: k, "d": lambda k, b: i["div"](k, b), "m": lambda k, b: i["mod"](k, b), "q": lambda k, b: i["quot"](k, b), "r": lambda k, b: i["rem"](k, b), "t": lambda k: i["toString"](k)}).frame()


@query("""SELECT c_custkey AS k, ceil(c_acctbal)::INTEGER AS c, floor(c_acctbal)::INTEGER AS f, trunc(c_acctbal)::INTEGER AS t, sign(c_acctbal)::INTEGER AS s, abs(c_acctbal) AS a, sqrt(abs(c_acctbal)) AS r, atan2(c_acctbal, 3.0) AS at FROM customer""")
def real_functions(spark, d):
    r, m = L["Real"], L["Math"]
    q = from_(c=scan(spark, d, "customer"))
    made = {"c": r["ceil"], "f": r["floor"], "t": r["trunc"], "s": r["sign"], "a": r["abs"], "r": lambda x: m["sqrt"](r["abs"](x)), "at": lambda x: m["atan2"](x, F.lit(3.0))}
    return q.yield_({"k": lambda c: c.c_custkey} | {k: (lambda f: lambda c: f(c.c_acctbal))(f) for k, f in made.items()}).frame()


@query("""SELECT o_orderkey AS k, list_transform(xs, lambda x: x * 2) AS doubled, list_filter(xs, lambda x: x % 2 = 1) AS odd, list_sum(xs)::INTEGER AS total, list_reverse(xs) AS back, list_max(xs) AS top, xs[1] AS first
FROM (SELECT l_orderkey AS o_orderkey, list(l_linenumber ORDER BY l_linenumber) AS xs FROM lineitem GROUP BY 1)""")
def list_functions(spark, d):
    f, r = L["List"], L["Relational"]
    q = from_(l=scan(spark, d, "lineitem")).group(k=lambda l: l.l_orderkey, compute={"xs": A.elements(lambda l: l.l_linenumber)})
    made = {"doubled": lambda xs: f["map"](lambda x: x * 2, xs), "odd": lambda xs: f["filter"](lambda x: x % 2 == 1, xs), "total": lambda xs: r["sum"](xs), "back": lambda xs: f["rev"](xs), "top": lambda xs: r["max"](xs), "first": lambda xs: f["hd"](xs)}
    return q.yield_({"k": lambda k: k} | made).frame()


@query("SELECT o_orderkey AS k, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, (dayofyear(o_orderdate) - 1)::INTEGER AS yd, strftime(o_orderdate, '%Y/%m') AS t FROM orders")
def date_functions(spark, d):
    f = L["Date"]
    q = from_(o=scan(spark, d, "orders")).yield_({"k": lambda o: o.o_orderkey, "dt": lambda o: F.struct(o.o_orderdate.alias("ts"), F.lit(0).alias("offset"))})
    return q.yield_({"k": lambda k: k, "y": lambda dt: f["year"](dt), "m": lambda dt: F.month(dt.ts), "d": lambda dt: f["day"](dt), "yd": lambda dt: f["yearDay"](dt), "t": lambda dt: f["fmt"]("%Y/%m", dt)}).frame()


@query("SELECT p_partkey AS k, (p_retailprice * 100)::BIGINT & 255 AS low, xor((p_retailprice * 100)::BIGINT, 1023) AS x FROM (SELECT p_partkey, round(p_retailprice, 2) AS p_retailprice FROM part)")
def word_functions(spark, d):
    w = L["Word"]
    q = from_(p=scan(spark, d, "part")).yield_({"k": lambda p: p.p_partkey, "w": lambda p: w["fromInt"](F.rint(F.round(p.p_retailprice, 2) * 100).cast("long"))})
    return q.yield_({"k": lambda k: k, "low": lambda w: L["Word"]["toLargeIntX"](L["Word"]["andb"](w, F.lit(255))), "x": lambda w: L["Word"]["toLargeIntX"](L["Word"]["xorb"](w, F.lit(1023)))}).frame()


def text_query(name: str, source: str, sql: str, *tables: str) -> None:
    """A query in the text form, over tables bound by name."""
    def made(spark, d):
        return Session(spark, **{t: parquet(spark, d, t) for t in tables}).run(source).frame()
    _queries[name], _sql[name] = made, sql


text_query(
    "text_group", "from l in lineitem where l.l_quantity > 30.0 group {l.l_returnflag, l.l_linestatus} compute {c = count over (), q = sum over l.l_quantity} order l_returnflag",
    "SELECT l_returnflag, l_linestatus, count(*) AS c, sum(l_quantity) AS q FROM lineitem WHERE l_quantity > 30 GROUP BY ALL", "lineitem",
)
text_query(
    "text_join", "from c in customer, n in nation where c.c_nationkey = n.n_nationkey andalso c.c_acctbal > 9000.0 yield {c.c_custkey, n.n_name}",
    "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000", "customer", "nation",
)
text_query(
    "text_left_join", "from n in nation left join s in supplier on n.n_nationkey = s.s_nationkey yield {n.n_name, key = case s of SOME x => x.s_suppkey | NONE => Int.abs (~1)}",
    "SELECT n_name, coalesce(s_suppkey, 1) AS key FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey", "nation", "supplier",
)
text_query(
    "text_exists", "from o in orders where exists (from l in lineitem where l.l_orderkey = o.o_orderkey andalso l.l_quantity > 49.0) yield {o.o_orderkey}",
    "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)", "orders", "lineitem",
)
text_query(
    "text_forall", "from o in orders where (forall l in lineitem where l.l_orderkey = o.o_orderkey require l.l_quantity > 10.0) yield {o.o_orderkey}",
    "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_quantity > 10))", "orders", "lineitem",
)
text_query(
    "text_order_take", "from c in customer order (DESC c.c_acctbal, c.c_custkey) take 15 yield {c.c_custkey, kind = if c.c_acctbal > 9990.0 then \"top\" else \"high\"}",
    "SELECT c_custkey, CASE WHEN c_acctbal > 9990 THEN 'top' ELSE 'high' END AS kind FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15", "customer",
)
text_query(
    "text_let_fn", "let fun clip x = if x < 0.0 then 0.0 else x in from c in customer group c.c_mktsegment compute {total = sum over clip (Real.realFloor c.c_acctbal), n = count over ()} end",
    "SELECT c_mktsegment, sum(greatest(floor(c_acctbal), 0)) AS total, count(*) AS n FROM customer GROUP BY 1", "customer",
)
text_query(
    "text_set_operations", "from k in (from c in customer yield c.c_nationkey) except distinct (from s in supplier where s.s_acctbal > 5000.0 yield s.s_nationkey) yield {k}",
    "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000", "customer", "supplier",
)
text_query(
    "text_correlated_scalar", "from n in nation yield {n.n_name, suppliers = count (from s in supplier where s.s_nationkey = n.n_nationkey), best = from s in supplier where s.s_nationkey = n.n_nationkey andalso s.s_acctbal > 0.0 compute sum over Real.floor s.s_acctbal}",
    "SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, coalesce((SELECT sum(floor(s_acctbal)::INT) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0), 0)::BIGINT AS best FROM nation", "nation", "supplier",
)
text_query(
    "text_correlated_scan", "from n in nation, c in (from c in customer where c.c_nationkey = n.n_nationkey order (DESC c.c_acctbal, c.c_custkey) take 2) yield {n.n_name, c.c_custkey}",
    "SELECT n_name, c_custkey FROM (SELECT n_name, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM nation JOIN customer ON c_nationkey = n_nationkey) WHERE r <= 2", "nation", "customer",
)
text_query(
    "text_elem_query", "from c in customer where c.c_acctbal > 9500.0 orelse c.c_nationkey elem (from s in supplier where s.s_acctbal > 9000.0 yield s.s_nationkey) yield {c.c_custkey}",
    "SELECT c_custkey FROM customer WHERE c_acctbal > 9500 OR c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)", "customer", "supplier",
)
text_query(
    "text_exists_in_expression", "from c in customer yield {c.c_custkey, large = if exists (from o in orders where o.o_custkey = c.c_custkey andalso o.o_totalprice > 300000.0) then 1 else 0}",
    "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) THEN 1 ELSE 0 END AS large FROM customer", "customer", "orders",
)
text_query(
    "text_scan_pattern", "from {l_returnflag = \"R\", l_linenumber = 1, l_orderkey, l_quantity = q, ...} in lineitem where q > 45.0 yield {l_orderkey, q}",
    "SELECT l_orderkey, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 AND l_quantity > 45", "lineitem",
)
text_query(
    "text_case_patterns", "from p in part yield {p.p_partkey, kind = case (p.p_size mod 3, p.p_size > 25) of (0, true) => 10 | (0, _) => 11 | (r, true) => r * 100 | (1, false) => 1 | _ => 0}",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size > 25 THEN 10 WHEN p_size % 3 = 0 THEN 11 WHEN p_size > 25 THEN p_size % 3 * 100 WHEN p_size % 3 = 1 THEN 1 ELSE 0 END AS kind FROM part", "part",
)
text_query(
    "text_list_patterns", "from p in part yield {p.p_partkey, v = case List.tabulate (p.p_size mod 4, fn i => i + 5) of [] => 0 | [x] => x | x :: y :: rest => x * 10 + y + List.length rest}",
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 56 ELSE 57 END AS v FROM part", "part",
)
text_query(
    "text_datatype", "datatype size = SMALL of int | PRICED of real | PLAIN; from p in part yield {k = p.p_partkey, x = if p.p_size < 10 then SMALL p.p_size else if p.p_size < 30 then PRICED p.p_retailprice else PLAIN} yield {k, v = case x of SMALL 1 => ~1.0 | SMALL n => Real.fromInt n | PRICED r => r | PLAIN => 0.0}",
    "SELECT p_partkey AS k, CASE WHEN p_size = 1 THEN -1.0::DOUBLE WHEN p_size < 10 THEN p_size::DOUBLE WHEN p_size < 30 THEN p_retailprice ELSE 0.0::DOUBLE END AS v FROM part", "part",
)
text_query(
    "text_checked_type", "type positive = real check x => x >= 0.0; type modest = positive check x => x < 5000.0; from c in customer yield {c.c_custkey, v = c.c_acctbal asOpt modest}",
    "SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal < 5000 THEN c_acctbal END AS v FROM customer", "customer",
)
text_query(
    "text_overload", "over weigh; val inst weigh = fn (n : int) => n * 2; val inst weigh = fn (s : string) => String.size s; from c in customer yield {c.c_custkey, a = weigh c.c_mktsegment, b = weigh (String.size c.c_mktsegment)}",
    "SELECT c_custkey, length(c_mktsegment)::INT AS a, (length(c_mktsegment) * 2)::INT AS b FROM customer", "customer",
)
text_query(
    "text_clausal_recursion", "fun power (_, 0) = 1 | power (b, n) = b * power (b, n - 1); from p in part where p.p_size < 20 yield {p.p_partkey, cube = power (p.p_size, 3)}",
    "SELECT p_partkey, p_size * p_size * p_size AS cube FROM part WHERE p_size < 20", "part",
)
text_query(
    "text_recursion_by_row", "fun digits (n : int) : int = if n < 10 then n else n mod 10 + digits (n div 10); from s in supplier yield {s.s_suppkey, d = digits (Real.floor (s.s_suppkey * 1.0))}",
    "SELECT s_suppkey, list_sum(list_transform(string_split(s_suppkey::VARCHAR, ''), lambda x: x::INT))::INT AS d FROM supplier", "supplier",
)
text_query(
    "text_scan_without_source", "from x, y where x >= 1 andalso x < 40 andalso y = x * x where y mod 3 = 1 yield {x, y}",
    "SELECT x::INT AS x, (x * x)::INT AS y FROM range(1, 40) t(x) WHERE x * x % 3 = 1", "region",
)
text_query(
    "text_recursive_predicate", "fun step (a, b) = (a, b) elem (from n in nation yield {n.n_nationkey, n.n_regionkey}); fun path (a, b) = step (a, b) orelse (exists c where path (a, c) andalso step (c, b)); from a, b where path (a, b)",
    "WITH RECURSIVE path(a, b) AS (SELECT n_nationkey, n_regionkey FROM nation UNION SELECT a, n_regionkey FROM path JOIN nation ON n_nationkey = b) SELECT a, b FROM path", "nation",
)


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS positive FROM customer")
def checked_type(spark, d):
    positive = Checked("positive", "double", (lambda x: x >= 0,))
    return from_(c=scan(spark, d, "customer")).yield_({"k": lambda c: c.c_custkey, "positive": lambda c: positive.as_opt(c.c_acctbal)}).frame()


@query("SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN p_size * 1.0::DOUBLE WHEN p_size < 30 THEN p_retailprice ELSE 0.0::DOUBLE END AS v FROM part")
def datatype_case(spark, d):
    kind = Datatype("kind", {"NONE_OF": None, "SMALL": "int", "PRICED": "double"})
    q = from_(p=scan(spark, d, "part")).yield_({"k": lambda p: p.p_partkey, "x": lambda p: F.when(p.p_size < 10, kind.make("SMALL", p.p_size)).when(p.p_size < 30, kind.make("PRICED", p.p_retailprice)).otherwise(kind.make("NONE_OF"))})
    return q.yield_({"k": lambda k: k, "v": lambda x: kind.case(x, NONE_OF=lambda: F.lit(0.0), SMALL=lambda n: n.cast("double"), PRICED=lambda r: r)}).frame()


def queries() -> dict[str, Made]:
    return _queries | library_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return _sql | library_queries.SQL
