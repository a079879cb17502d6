"""URL filtering by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the expressions a rule could have been written as:
each suffix of its host at a label boundary, joined with each prefix of its
path whose length occurs among the rules. Expressions meet the rules in an
equi-join on a four-byte digest prefix; the full SHA-256 digests then decide,
and the longest matching rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Rules up to this many are broadcast; a larger set is joined by shuffle.
BROADCAST_RULES = 20_000

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def url_host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: its id, host, path, the rule that decides (or null) and the verdict.

    A null url, or one without ``://``, has an empty host and path, so no rule
    fits it and ``default`` holds. A rule with a null host or path fits nothing.
    Of rules equally long the blocking one wins; repeated rules count once.
    Repeated pages and null ids give one row each; other columns are ignored;
    an empty table of pages gives no rows, one of rules the default for all.
    """
    rules = (
        rules.where("rule_host is not null and rule_path is not null and rule_verdict is not null")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("rule_short", F.substring("rule_digest", 1, 8))
    )
    # a few small numbers, however many rules there are: the lengths of their paths and label counts of their hosts
    shape = rules.agg(
        F.array_sort(F.collect_set(F.length("rule_path"))).alias("path_lengths"),
        F.array_sort(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("host_labels"),
        F.count("*").alias("n"),
    ).first()
    url = F.col(url_col)
    every = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), F.coalesce(url.contains("://"), F.lit(False)).alias("whole"))
    # broken urls, however many, need no rule and stay where they are
    parsed, broken = every.where("whole").drop("whole"), every.where("not whole")
    # urls repeat (same page fetched again) and many share host and path: judge each once
    distinct = parsed.select("host", "path").distinct()
    lengths, labels = F.array(*map(F.lit, shape.path_lengths)), F.array(*map(F.lit, shape.host_labels))
    if not shape.n:
        lengths, labels = lengths.cast("array<int>"), labels.cast("array<int>")
    expressions = (
        distinct.withColumn("label", F.explode(F.filter(labels, lambda k: k <= F.size(F.split("host", r"\.")))))
        .withColumn("suffix", F.expr("substring_index(host, '.', -label)"))
        .withColumn("cut", F.explode(F.filter(lengths, lambda k: k <= F.length("path"))))
        .withColumn("digest", _digest(F.col("suffix"), F.substring(F.col("path"), F.lit(1), F.col("cut"))))
        .select("host", "path", "digest", F.substring("digest", 1, 8).alias("short"))
    )
    small = F.broadcast(rules) if shape.n <= BROADCAST_RULES else rules
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("long"),
        (F.col("rule_verdict") == "block").alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    decided = (
        expressions.join(small, F.col("short") == F.col("rule_short"))
        .where("digest = rule_digest")
        .groupBy("host", "path")
        .agg(F.max(rank).alias("best"))
    )
    judged = parsed.join(decided, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return judged.unionByName(broken.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path,
  (SELECT arg_max(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT arg_max(rv, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM p
"""
