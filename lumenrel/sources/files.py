"""Sources: CSV files with typed headers, folders as records of tables, Parquet, and the sample database."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrel.plans.errors import Error

#: Header types; decimal and double columns are both read as real numbers.
TYPES = {"bool": "boolean", "int": "int", "decimal": "double", "double": "double", "string": "string"}


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file (plain or gzip) whose header cells are name[:type]; strings may be in single quotes, and NULL numbers are 0.

    Fields come in label order.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise Error(f"{path} has no header")
    fields = [(c.strip().partition(":")[0], TYPES.get(c.strip().partition(":")[2], "string")) for c in first[0][0].split(",")]
    raw = spark.read.csv(path, header=True, quote="'", schema=", ".join(f"`{n}` string" for n, _ in fields), enforceSchema=True)

    def cell(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind == "string":
            return F.coalesce(c, F.lit("")).alias(name)
        zero = F.lit(False if kind == "boolean" else 0).cast(kind)
        return F.coalesce(F.when(c != "NULL", c).cast(kind), zero).alias(name)

    return raw.select(*(cell(n, k) for n, k in sorted(fields)))


class Folder:
    """A folder as a record: a field is a table or another folder, found when it is asked for."""

    SUFFIXES = (".csv", ".csv.gz", ".parquet")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path, self._found = spark, path.rstrip("/"), {}

    def _children(self) -> dict[str, str]:
        hadoop = self._spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self._path)
        files = path.getFileSystem(self._spark._jsc.hadoopConfiguration()).listStatus(path)
        out = {}
        for f in files:
            name = f.getPath().getName()
            suffix = next((s for s in self.SUFFIXES if name.endswith(s)), "")
            if suffix or f.isDirectory():
                out[name.removesuffix(suffix) if suffix else name] = suffix
        return out

    def __dir__(self) -> list[str]:
        return sorted(self._children())

    def __getattr__(self, name: str) -> DataFrame | Folder:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._found:
            children = self._children()
            if name not in children:
                raise AttributeError(f"{self._path} has no {name}")
            path = f"{self._path}/{name}{children[name]}"
            self._found[name] = self._spark.read.parquet(path) if children[name] == ".parquet" else csv(self._spark, path) if children[name] else Folder(self._spark, path)
        return self._found[name]

    __getitem__ = __getattr__


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The rows of the sample database.
DEPTS = [(10, "ACCOUNTING", "NEW YORK"), (20, "RESEARCH", "DALLAS"), (30, "SALES", "CHICAGO"), (40, "OPERATIONS", "BOSTON")]
EMPS = [
    (7369, "SMITH", "CLERK", 7902, "1980-12-17", 800, None, 20),
    (7499, "ALLEN", "SALESMAN", 7698, "1981-02-20", 1600, 300, 30),
    (7521, "WARD", "SALESMAN", 7698, "1981-02-22", 1250, 500, 30),
    (7566, "JONES", "MANAGER", 7839, "1981-02-04", 2975, None, 20),
    (7654, "MARTIN", "SALESMAN", 7698, "1981-09-28", 1250, 1400, 30),
    (7698, "BLAKE", "MANAGER", 7839, "1981-01-05", 2850, None, 30),
    (7782, "CLARK", "MANAGER", 7839, "1981-06-09", 2450, None, 10),
    (7788, "SCOTT", "ANALYST", 7566, "1987-04-19", 3000, None, 20),
    (7839, "KING", "PRESIDENT", None, "1981-11-17", 5000, None, 10),
    (7844, "TURNER", "SALESMAN", 7698, "1981-09-08", 1500, 0, 30),
    (7876, "ADAMS", "CLERK", 7788, "1987-05-23", 1100, None, 20),
    (7900, "JAMES", "CLERK", 7698, "1981-12-03", 950, None, 30),
    (7902, "FORD", "ANALYST", 7566, "1981-12-03", 3000, None, 20),
    (7934, "MILLER", "CLERK", 7782, "1982-01-23", 1300, None, 10),
]
SALGRADES = [(1, 700, 1200), (2, 1201, 1400), (3, 1401, 2000), (4, 2001, 3000), (5, 3001, 9999)]


class Scott:
    """The sample database: emps, depts, salgrades and bonuses."""

    def __init__(self, spark: SparkSession) -> None:
        money = lambda x: None if x is None else Decimal(x)
        self.depts = spark.createDataFrame(DEPTS, "deptno int, dname string, loc string")
        rows = [(money(comm), d, no, name, hired, job, mgr, money(sal)) for no, name, job, mgr, hired, sal, comm, d in EMPS]
        self.emps = spark.createDataFrame(rows, "comm decimal(10,2), deptno int, empno int, ename string, hiredate string, job string, mgr int, sal decimal(10,2)")
        self.salgrades = spark.createDataFrame([(g, money(hi), money(lo)) for g, lo, hi in SALGRADES], "grade int, hisal decimal(10,2), losal decimal(10,2)")
        self.bonuses = spark.createDataFrame([], "comm decimal(10,2), ename string, job string, sal decimal(10,2)")
