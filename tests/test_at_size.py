"""Steps that number or count rows over many partitions, and the whole library over columns, each against SQL."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenrel import catalog, library_queries
from lumenrel.plans import errors
from lumenrel.plans.query import bag
from lumenrel.plans.storage import forget, materialised


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ordinals_over_many_partitions(spark, adaptive):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        rows = spark.range(0, 150_000, 1, 12).select((F.col("id") * 7919 % 150_000).alias("x"), F.col("id").alias("payload"))
        got = bag(rows).order(lambda x: x).with_ordinal().df.select("ordinal", "x").toPandas()
        assert len(got) == 150_000 and (got["ordinal"] == got["x"]).all()
        kept = bag(rows).order(lambda x: x).where(lambda ordinal: ordinal % 1000 == 17).df.toPandas()
        assert sorted(kept["x"]) == list(range(17, 150_000, 1000))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_written_tables_can_be_forgotten(spark):
    made = materialised(spark.range(5).toDF("x"), "t")
    files = made.inputFiles()
    forget(made)
    assert files and not spark._jvm.java.io.File(files[0].removeprefix("file://")).exists()


def test_a_fix_point_that_does_not_end_is_an_error(spark):
    from lumenrel.operators.fixpoint import iterate

    with pytest.raises(errors.Error, match="no fix-point"):
        iterate(bag(spark.range(1).toDF("x")), lambda _, new: new.yield_({"x": lambda x: x + 1}), rounds=3)


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["where_ordinal", "join_on_ordinal", "left_join_on_ordinal", *library_queries.QUERIES])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    text = lambda df: sorted(map(repr, df[sorted(df.columns)].map(lambda v: "nan" if not hasattr(v, "__len__") and pd.isna(v) else float(v) if isinstance(v, (int, float)) else v).values.tolist()))
    if not any(hasattr(v, "__len__") and not isinstance(v, str) for df in (got, want) for v in df.iloc[0]):
        assert text(got) == text(want)
