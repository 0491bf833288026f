"""URL rules looked up by hash prefixes of host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HASH_DIGITS = 8
#: Rules of up to this many rows are broadcast (each is under 1 KB); more are joined by shuffle.
MOST_BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _expression(host: Column, path: Column) -> Column:
    # a line break can't end a host, so no two (host, path) pairs give the same expression
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each page's host, path, deciding rule and verdict.

    A URL is expanded into (host suffix at a dot, path prefix) expressions: as many labels and prefix lengths as
    the rules have, so a long URL gives no more rows than the rules call for. Expressions meet rules by the first
    eight hexadecimal digits of their SHA-256; the full digests then confirm. Among the rules that fit, the one
    with the longest host and path together wins; of equal ones the longer host, then block before allow.

    A null URL or one without `://` has an empty host and path, fits no rule and gets `default`. Repeated pages
    are judged each; null ids and extra columns do no harm. Without rules, or without pages, nothing fails.

    Returns: `id_col`, host, path, rule (host then path of the rule, or null), verdict.
    """
    ruled = rules.select(
        F.col("verdict").alias("rule_verdict"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"),
        _expression(F.col("host"), F.col("path")).alias("rule_digest"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_len"),
    )
    shape = ruled.agg(F.max("labels").alias("labels"), F.collect_set("path_len").alias("lengths"), F.count("*").alias("n")).first()
    parsed = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not shape["n"]:
        return parsed.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    suffixes = F.array(*[F.substring_index("host", ".", -n) for n in range(1, shape["labels"] + 1)])
    lengths = F.array(*[F.lit(n) for n in sorted(shape["lengths"])])
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    digests = F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _expression(s, p)))))
    best = F.struct(F.length("rule").alias("l"), F.col("host_len"), (F.col("rule_verdict") == "block").alias("b"), F.col("rule"), F.col("rule_verdict"))
    keyed = parsed.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.explode_outer(digests))
    keyed = keyed.withColumn("prefix", F.substring("digest", 1, HASH_DIGITS))
    listed = ruled.withColumn("rule_prefix", F.substring("rule_digest", 1, HASH_DIGITS))
    if shape["n"] <= MOST_BROADCAST_RULES:
        listed = F.broadcast(listed)
    met = keyed.join(listed, (F.col("prefix") == F.col("rule_prefix")) & (F.col("digest") == F.col("rule_digest")), "left")
    judged = met.groupBy("row").agg(F.first(id_col).alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(F.col("rule").isNotNull(), best)).alias("best"))
    return judged.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
