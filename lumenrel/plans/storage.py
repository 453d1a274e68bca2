"""Intermediate results on shared storage, which end a plan's lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenrel.plans import errors


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset on one machine (tests) a temporary folder. A cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lumenrel.shared", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise errors.Error("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lumenrel-")
        spark.conf.set("spark.lumenrel.shared", where)
    return where.rstrip("/")


def materialised(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/lumenrel/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that materialised() wrote and no plan reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for parent in {jvm.org.apache.hadoop.fs.Path(f).getParent().toString() for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        if path.getParent().getName() == "lumenrel":
            path.getFileSystem(conf).delete(path, True)
