"""URL filters as a sort-merge range join, in DataFrame operations only.

A rule is (host, path, verdict): it fits its host and all subdomains where the url's path starts with the rule's path;
of several the longest wins (most characters of host + path, then the host, then block before allow). Reversed host
labels, each ended by a dot, turn "host and subdomains" into a key prefix, so a rule is the interval of keys that start
with its own; intervals of prefixes nest or are disjoint. ``sweep`` merges points and intervals in key order and keeps
the stack of active nested rules. It runs twice: over distinct hosts, which finds the nested rule hosts of each, and
over distinct (rule host, path) pairs, which finds the nested path rules. Urls themselves are never sorted by host, so
one host with a third of all rows is one point of the sweep.

The sweep: points, interval starts and interval ends are range-partitioned and sorted by key; an interval that spans
partitions is carried into each of those it covers (known from the partitions of its two ends), so each partition
holds the whole stack for its points. The stack is one running ``last`` for each nesting depth; depth is the running
count of starts less ends. The largest depth is a count taken from the rules, not from the urls.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; a url that no rule fits
gets the default verdict; repeated pages each get their row; repeated rules count once; rules with a null host are
ignored, a null path is empty; of equally long rules the longer host wins, then block; a very long url is one key as any
other; an empty table of urls gives no rows, one of rules the default verdict; extra columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import ascii_lower, table
from loomtext.sources.scratch import shared_folder

#: The production rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"


def url_host(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Hex of the reversed labels, each ended by a dot: a host's subdomains are the keys that start with its own."""
    return F.hex(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")).cast("binary"))


def sweep(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """(key, rules): for each distinct point key the stack of intervals whose key it starts with, outermost first.

    ``points`` has one row for each distinct upper-case hex ``key``, ``intervals`` (key, rule) distinct keys. Points in no interval are
    left out.
    """
    # An interval is [key, key + 'G'): hex digits sort below 'G'. At one key a start comes before a point.
    start = intervals.select("key", F.lit(0).alias("kind"), F.col("key").alias("of"), "rule")
    end = intervals.select(F.concat("key", F.lit("G")).alias("key"), F.lit(2).alias("kind"), F.col("key").alias("of"), F.lit(None).cast(intervals.schema["rule"].dataType).alias("rule"))
    point = points.select("key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("of"), F.lit(None).cast(intervals.schema["rule"].dataType).alias("rule"))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = start.unionByName(end).unionByName(point).repartitionByRange(n, "key", "kind").withColumn("part", F.spark_partition_id())
    shared_folder(points.sparkSession)
    events = events.checkpoint()
    ends = events.where("kind <> 1").groupBy("of").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.max("rule").alias("rule"))
    carried = ends.where("b > a").select("of", "rule", F.explode(F.sequence(F.col("a") + 1, F.col("b"))).alias("part"))
    carried = carried.select(F.lit("").alias("key"), F.lit(0).alias("kind"), "of", "rule", "part")
    order = Window.partitionBy("part").orderBy("key", "kind", F.length("of"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    events = events.unionByName(carried).withColumn("depth", F.sum(F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)).over(running))
    most = int(events.agg(F.max("depth")).first()[0] or 0)
    for k in range(1, most + 1):
        events = events.withColumn(f"_{k}", F.last(F.when((F.col("kind") == 0) & (F.col("depth") == k), F.col("rule")), ignorenulls=True).over(running))
    stack = F.slice(F.array(*(F.col(f"_{k}") for k in range(1, most + 1))), F.lit(1), F.col("depth").cast("int")) if most else F.array(F.col("rule"))
    return events.where("kind = 1 AND depth > 0").select("key", stack.alias("rules"))


def match(urls: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``urls`` (any columns, ``url``) with host, path, rule and verdict; ``rules`` has host, path, verdict.

    The caller's columns travel as one struct, so none of their names can meet one of these; the four results replace
    columns of their names.
    """
    r = rules.where("host IS NOT NULL").select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("host_key", host_key(F.col("host")))
    # A path rule's key: its host's key, a separator below all hex digits, the path's hex.
    r = r.withColumn("key", F.concat("host_key", F.lit("-"), F.hex(F.col("path").cast("binary"))))
    out = urls.select(F.struct("*").alias("own"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    out = out.withColumn("host_key", host_key(F.col("host"))).withColumn("path_key", F.hex(F.col("path").cast("binary")))

    hosts = sweep(out.groupBy(F.col("host_key").alias("key")).agg(F.lit(1).alias("_")), r.groupBy(F.col("host_key").alias("key")).agg(F.first("host_key").alias("rule")))
    pairs = out.groupBy("host_key", "path_key").agg(F.lit(1).alias("_"))
    pairs = pairs.join(hosts, pairs["host_key"] == hosts["key"]).select("host_key", "path_key", F.explode("rules").alias("rule_host"))
    pairs = pairs.withColumn("key", F.concat("rule_host", F.lit("-"), "path_key"))
    paths = sweep(pairs.groupBy("key").agg(F.lit(1).alias("_")), r.select("key", F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.col("verdict"), F.concat("host", "path").alias("rule")).alias("rule")))
    best = pairs.join(paths, "key").select("host_key", "path_key", F.array_max("rules").alias("best"))
    best = best.groupBy("host_key", "path_key").agg(F.max("best").alias("best"))
    out = out.join(best, ["host_key", "path_key"], "left")
    own = [F.col("own").getField(c).alias(c) for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*own, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = match(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark))
    return out.select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, q, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || q) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
QUERIES = {"op8_url_filters": op8_url_filters}
ORACLES = {"op8_url_filters": OP8_SQL}
