"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression over host and path plus the literal tokens that
every URL it fits must hold. Token counts over all URLs say which token of a
rule is rarest; the rule is indexed under that token alone. A URL's tokens
fetch its candidate rules, and only those run their expressions. Everything
is DataFrame functions.

Defined results: host and path are empty for a null URL or one without
``://``; such URLs, empty ones and those that no rule fits get a null rule and
the default verdict; of several fitting rules the longest wins (ties: the
larger rule text); a very long URL is a row like any other, its tokens with it; repeated rows
each get a row; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule index of at most so many rules (some 20 MB) is broadcast; a larger one is joined with salted tokens.
BROADCAST_RULES = 100_000
SALTS = 16
#: The token of rules that have no literal one; every URL holds it.
ANY = ""

RULE_SCHEMA = "rule string, pattern string, verdict string, tokens array<string>"


def host_path_rule(rule: str, verdict: str) -> tuple[str, str, str, list[str]]:
    """The row of RULE_SCHEMA for ``host/path``: it fits the host and its
    subdomains where the path starts with the rule's."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    literal = lambda s: "".join(c if c.isalnum() or c in "/-_" else re.escape(c) for c in s)
    whole_segments = path.split("/")[:-1]
    tokens = [t for t in [*host.split("."), *whole_segments] if t]
    return rule, rf"^(?:[^/]*\.)?{literal(host)}{literal(path)}" if slash else rf"^(?:[^/]*\.)?{literal(host)}(?:/|$)", verdict, tokens


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([host_path_rule(r, v) for r, v in rules], RULE_SCHEMA)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct host labels and path segments, and the token of all URLs."""
    parts = F.concat(F.split(host, r"\.", -1), F.split(path, "/", -1))
    return F.array_distinct(F.concat(F.filter(parts, lambda t: t != ""), F.array(F.lit(ANY))))


def index_rules(urls: DataFrame, rules: DataFrame, n_rules: int = 0) -> DataFrame:
    """The rules with their rarest token: ``urls`` has a ``tokens`` column.

    The token of all URLs is not counted, as a rule has it alone or not at all. Of the
    others only those that a rule asks for are counted, up to ``BROADCAST_RULES`` rules by
    a broadcast of theirs, and each task adds up its own before the shuffle; with more rules all tokens
    are counted, each task's own first, and then looked up."""
    wanted = rules.select("rule", "pattern", "verdict",
                          F.explode(F.when(F.size("tokens") > 0, F.array_distinct("tokens")).otherwise(F.array(F.lit(ANY)))).alias("token"))
    tokens = urls.select(F.explode(F.filter("tokens", lambda t: t != ANY)).alias("token"))
    if n_rules <= BROADCAST_RULES:
        tokens = tokens.join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    found = wanted.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.groupBy("rule", "pattern", "verdict").agg(F.min(F.struct("n", "token"))["token"].alias("token"))


def filter_urls(pages: DataFrame, rules: DataFrame, n_rules: int, key: str = "page_id", url: str = "url",
                default: str = "allow") -> DataFrame:
    """One row for each row of ``pages``: key, host, path, rule, verdict."""
    host, path = url_parts(F.col(url))
    urls = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    index = index_rules(urls, rules, n_rules)
    asked = urls.withColumn("_row", F.monotonically_increasing_id()).withColumn("token", F.explode("tokens")).drop("tokens")
    index = index.select("token", "rule", "pattern", F.col("verdict").alias("_verdict"))
    if n_rules <= BROADCAST_RULES:
        candidates = asked.join(F.broadcast(index), "token", "left")
    else:
        salted = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        candidates = asked.withColumn("_salt", (F.col("_row") % SALTS).cast("int")).join(salted, ["token", "_salt"], "left")
    fits = F.coalesce(F.regexp_like(F.concat("host", "path"), F.col("pattern")), F.lit(False))
    best = F.max(F.when(fits, F.struct(F.char_length("rule").alias("length"), "rule", "_verdict")))
    judged = candidates.groupBy("_row", key, "host", "path").agg(best.alias("_best"))
    return judged.select(key, "host", "path", F.col("_best.rule").alias("rule"),
                         F.coalesce(F.col("_best._verdict"), F.lit(default)).alias("verdict"))
