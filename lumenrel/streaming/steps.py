"""The steps that keep their meaning on a stream: where, yield and union, all free of order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenrel.plans.query import Query, bag


def stream(spark: SparkSession, path: str, schema) -> Query:
    """A bag of the rows of the Parquet files that arrive in a folder."""
    return bag(spark.readStream.schema(schema).parquet(path))


def unbounded(q: Query) -> DataFrame:
    """The streaming DataFrame of a query made of where, yield and union steps."""
    if q.ordered:
        raise ValueError("a stream has no order")
    return q.elements().df
