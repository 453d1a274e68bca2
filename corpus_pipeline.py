"""A training-corpus pipeline over `documents`: five stages, each written as Parquet and read again by the next.

quality rules: documents that fail the base rules or the compression bands go.
near copies:   one document of each group of near copies stays (the least doc_id; SimHash links, compared exactly, and a prefix join for the rest; five-word shingles, similarity 0.8 or more).
repeats:       bytes of strings of 50 that also start in a document with a smaller id are cut out.
mixing:        rows are repeated or left out so that each source comes near its target weight.
pieces:        texts are encoded as pieces, and decoded again to see that nothing is lost.

The stages handle nulls, empty and long texts, ties, repeated rows, empty tables and extra columns as their operators' docstrings say.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrel.llm import _common, bwt_dedup, compression_rules, mixing, simhash, unigram_pieces


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return compression_rules.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = bwt_dedup.deduplicated(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unigram_pieces.with_pieces(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("repeats", repeats),
    ("mixing", mix),
    ("pieces", pieces),
]

#: SQL can't express compression ratios, fingerprints or piece encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.table(spark, sf_dir, "documents")
    where = f"{_common.shared_dir(spark)}/lumenrel/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
        _common.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
