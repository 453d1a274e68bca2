"""The queries of these operators over the whole of their tables, with production parameters, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrel.llm import _common as c
from lumenrel.llm import bwt_dedup, compression_rules, gam_quality, katz, langid, mixing, posting_lists, simhash, unigram_pieces, url_rules


#: Order 3 needs more disk than the check tool allows (figures in the README); the operator takes any order.
KATZ_ORDER = 2


def op1_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules.measure(c.table(spark, sf_dir, "documents"))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(c.table(spark, sf_dir, "documents"), c.remainder("doc_id", 5) != 1, KATZ_ORDER)


def op3_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_pieces.encode(c.table(spark, sf_dir, "documents"))


def op4_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.spans(c.table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(c.table(spark, sf_dir, "pages").select("page_id", "url"), url_rules.default_rules(spark))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(c.table(spark, sf_dir, "documents"), c.remainder("doc_id", 3) == 1)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(c.table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(c.table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).alias("taken"), F.size("shards").cast("long").alias("copies"), F.concat_ws(",", "shards").alias("shards"))


def op9_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.search(c.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = c.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return gam_quality.classify(c.table(spark, sf_dir, "documents"), labels, c.remainder("doc_id", 5) == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_compression_rules": op1_compression_rules,
        "op2_katz": op2_katz,
        "op3_unigram_pieces": op3_unigram_pieces,
        "op4_bwt_dedup": op4_bwt_dedup,
        "op5_url_rules": op5_url_rules,
        "op6_language": op6_language,
        "op7_simhash": op7_simhash,
        "op8_mixing": op8_mixing,
        "op9_posting_lists": op9_posting_lists,
        "op10_quality": op10_quality,
    }


OP5_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM cut)),
rules(h, p, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT parts.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_rules": OP5_SQL}
