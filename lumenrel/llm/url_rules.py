"""URL filters by a sort-merge range join, in DataFrame operations only.

A rule is (host, path, action). It fits a url if the url's host is the rule's or a subdomain of it and the url's
path starts with the rule's; the longest fitting rule decides. A rule's canonical key is its host labels
reversed, a separator, and its path: as strings, all keys that extend it form one interval right after it.
A url probes once for each host level that some rule has: the key of its last d labels with its whole path.

Rules and probes are put in one sorted order; the sweep keeps the last rule passed with its stack, the
rules whose intervals enclose it. Since intervals nest, the rules open at a probe are the members of that
stack that are prefixes of the probe, and the deepest is the longest of that host level. Urls are dealt to the sweep by a hash
of their id and each deal gets all rules, so one host with a third of all urls is spread like any other.

Defined cases: null urls and urls without :// have empty host and path, fit no rule and get the default action;
repeated rows and repeated ids are judged each; equal rules are merged, block before allow; an empty table or rule set
is allowed; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The rules of the query: host, path, action.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Ends the host part of a key; no host contains it, so a prefix of a key with it has the same host.
SEPARATOR = "\x00/"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "host string, path string, action string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key_of(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit(SEPARATOR), path)


def canonical(rules: DataFrame) -> DataFrame:
    """key, rule text, action and stack (enclosing rules and itself, outermost first) of each distinct rule."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    flat = (
        rules.where("host is not null and path is not null and action is not null")
        .select(host.alias("host"), "path", "action")
        .groupBy("host", "path")
        .agg(F.max("action").alias("action"))  # 'block' is after 'allow'
        .select(
            key_of(F.split("host", r"\."), F.col("path")).alias("key"),
            F.concat("host", "path").alias("rule"),
            "action",
            F.size(F.split("host", r"\.")).alias("depth"),
            "path",
            "host",
        )
    )
    inside = flat.select("key", "host", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))).alias("path"))
    entry = F.struct(F.length("outer.key").alias("length"), F.col("outer.key").alias("key"), F.col("outer.rule").alias("rule"), F.col("outer.action").alias("action"))
    stacks = (
        inside.alias("own")
        .join(flat.alias("outer"), (F.col("own.host") == F.col("outer.host")) & (F.col("own.path") == F.col("outer.path")))
        .groupBy(F.col("own.key").alias("key"))
        .agg(F.array_sort(F.collect_list(entry)).alias("stack"))
    )
    return flat.select("key", "depth").join(stacks, "key")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", deals: int | None = None) -> DataFrame:
    """page_id, host, path, rule (null: none fits) and verdict of each row of pages."""
    spark: SparkSession = pages.sparkSession
    deals = deals or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col("url"))
    ruled = canonical(rules)
    depths = sorted(r[0] for r in ruled.select("depth").distinct().collect())  # as many as label counts
    seen = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    labels = F.split("host", r"\.")
    probes = (
        seen.withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(deals)).cast("int"))
        .withColumn("levels", F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda d: d <= F.size(labels)))
        .withColumn("levels", F.when(F.size("levels") == 0, F.array(F.lit(0))).otherwise(F.col("levels")))
        .select("page_id", "host", "path", "row", "deal", F.explode("levels").alias("level"))
        .withColumn("key", F.when(F.col("level") > 0, key_of(F.slice(labels, -F.col("level"), F.col("level")), F.col("path"))).otherwise(F.lit("")))
        .select("deal", "key", F.lit(1).alias("probe"), "page_id", "host", "path", "row", F.lit(None).cast(ruled.schema["stack"].dataType).alias("stack"))
    )
    opened = ruled.select(
        F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), "key", F.lit(0).alias("probe"),
        F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("row"), "stack",
    )
    sweep = Window.partitionBy("deal").orderBy("key", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = probes.unionByName(opened).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("probe = 1")
    fits = F.filter("open", lambda r: F.substring(F.col("key"), F.lit(1), r["length"]) == r["key"])
    best = F.try_element_at(fits, F.lit(-1))
    longest = F.max(F.when(best.isNotNull(), F.struct(F.length(best["rule"]).alias("length"), best["length"].alias("key_length"), best["rule"].alias("rule"), best["action"].alias("action"))))
    return (
        swept.groupBy("deal", "row")
        .agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), longest.alias("best"))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
    )


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), RULE_SCHEMA)
