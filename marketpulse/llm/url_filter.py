"""URL rules looked up by hash prefixes of host-suffix and path-prefix expressions."""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: (host, path, verdict); a rule fits its host, all subdomains, and paths that start with its path.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Hex digits of a digest that the joins compare first.
PREFIX = 8
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _look_up(asked: DataFrame, expression: str, known: DataFrame, key: str) -> DataFrame:
    """``asked`` with the columns of ``known`` where ``expression`` equals ``key``.

    The join compares the short prefixes alone; a prefix brings all full digests
    that begin with it, and the asked digest, made after the join and so only for
    what met a prefix, picks its own.  No full digest of an asked expression is shuffled."""
    def short(digest: Column) -> Column:
        return F.substring(digest, 1, PREFIX).alias("short")

    digest = F.sha2(expression, 256)
    entries = known.withColumn("full", F.sha2(key, 256)).groupBy(short(F.col("full"))) \
        .agg(F.collect_set(F.struct("full", *known.columns)).alias("entries"))
    met = asked.select("*", short(digest)).join(entries, "short").withColumn("asked", digest)
    fits = F.filter("entries", lambda e: e["full"] == F.col("asked"))
    return met.withColumn("hit", F.explode(fits)).select(*asked.columns, "hit.*").drop("full", key)


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path; distinct) -> (host, path, rule, verdict) of the
    winning rule, for those that any rule fits.

    Hosts are expanded into suffixes of whole labels and looked up first; only
    what is under a rule's host is expanded into path prefixes, at the path
    lengths that this host's rules have.  The longest rule wins (of equally
    long ones the longer host, then block).
    """
    rules = rules.where("host <> ''").select("host", "path", "verdict")
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    rule_hosts = rules.groupBy(F.col("host").alias("rule_host")).agg(F.collect_set(F.length("path")).alias("lengths"))
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - labels + 1), F.size(parts)),
                        lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    suffixes = urls.select("host").distinct().select("host", F.explode(tails).alias("suffix"))
    under = _look_up(suffixes, "suffix", rule_hosts, "rule_host")
    prefixes = urls.join(under, "host").select("host", "path", "suffix", F.explode("lengths").alias("n")) \
        .where(F.length("path") >= F.col("n")) \
        .withColumn("expression", F.concat("suffix", F.expr("substring(path, 1, n)"))).drop("suffix", "n")
    table = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_size"), "verdict")
    best = F.max(F.struct(F.length("expression").alias("size"), "host_size", (F.col("verdict") == "block").alias("blocks"),
                          F.col("expression").alias("rule"), "verdict")).alias("best")
    return _look_up(prefixes, "expression", table, "rule").groupBy("host", "path").agg(best) \
        .select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
          default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages``.

    Without a fitting rule ``rule`` is null and the verdict is ``default``; so
    it is for null urls and urls without ``://``, whose host and path are
    empty.  An empty path does not start with ``/``.  Verdicts are found once
    for each distinct (host, path) and joined back, so repeated rows cost no
    look-ups and are all returned.  A very long url is hashed once a suffix or
    prefix that a rule's length allows.  An empty table gives an empty one, an
    empty rule table the default.  Other columns are not read.
    """
    rows = pages.select(F.col(key), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    won = matches(rows.select("host", "path").distinct(), rules)
    return rows.join(won, ["host", "path"], "left") \
        .select(key, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
