"""URL filters by host-suffix and path-prefix expressions.

A rule is (verdict, host, path): it fits a URL whose host is the rule's or a
subdomain of it and whose path starts with the rule's. Every URL is expanded
into its host suffixes x path prefixes; an expression meets the rules on a
4-byte prefix of its SHA-256 (a narrow equi-join key), the full digests are
then compared, and the longest fitting rule wins (then the longer host, then
block before allow). Only path prefixes of lengths that some rule has are
expanded: no other can fit.

Cases: a null URL, or one without ``://``, has empty host and path, fits no
rule and gets the default verdict; ports and user names count as part of the
host; an empty path fits only rules with an empty path; an empty rule table
leaves every URL at the default; repeated rows each get their own result;
columns of the input that clash with a result name are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# A rule table up to this many rows is broadcast; a larger one is joined by
# shuffle (adaptive execution splits the hot prefixes).
BROADCAST_RULES = 200_000
_PREFIX_HEX = 8  # 4 bytes
RESULT = ("host", "path", "rule", "verdict")


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def url_host(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path) as a DataFrame."""
    return spark.createDataFrame(list(rules), "rule_verdict string, rule_host string, rule_path string")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and
    ``verdict``."""
    rules = (
        rules.where(F.col("rule_host").isNotNull() & F.col("rule_verdict").isNotNull())
        .select(
            "rule_verdict",
            F.translate("rule_host", UPPER, UPPER.lower()).alias("rule_host"),
            F.coalesce("rule_path", F.lit("")).alias("rule_path"),
        )
        .distinct()
    )
    # one small row: how many rules, and which path lengths they have
    size = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    keyed = rules.select(
        _digest(F.concat("rule_host", "rule_path")).alias("_full"),
        F.length("rule_host").alias("_host_len"),
        F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("n"),
            F.length("rule_host").alias("h"),
            (F.col("rule_verdict") == "block").alias("b"),
            F.concat("rule_host", "rule_path").alias("rule"),
            F.col("rule_verdict").alias("verdict"),
        ).alias("_rule"),
    ).withColumn("_short", F.substring("_full", 1, _PREFIX_HEX))
    if size["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)

    keep = [c for c in pages.columns if c.lower() not in RESULT]
    one = pages.select(
        *[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(keep)],
        url_host(F.col(f"`{url}`")).alias("host"),
        url_path(F.col(f"`{url}`")).alias("path"),
        F.monotonically_increasing_id().alias("_row"),
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    lengths = F.array(*[F.lit(n) for n in sorted(size["lengths"])]).cast("array<int>")
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    expressions = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(
                prefixes, lambda p: F.struct(_digest(F.concat(s, p)).alias("full"), F.length(s).alias("host_len"))
            ),
        )
    )
    # expressions of a row are made, joined and reduced inside its task when
    # the rules are broadcast: the partial aggregate leaves a row per page
    out = (
        one.withColumn("_e", F.explode_outer(F.when(F.col("host") != "", expressions)))
        .withColumn("_short", F.substring("_e.full", 1, _PREFIX_HEX))
        .join(keyed, "_short", "left")
        .withColumn(
            "_fit",
            F.when((F.col("_e.full") == F.col("_full")) & (F.col("_e.host_len") == F.col("_host_len")), F.col("_rule")),
        )
        .groupBy("_row")
        .agg(
            *[F.first(f"in_{i}").alias(f"in_{i}") for i in range(len(keep))],
            F.first("host").alias("host"),
            F.first("path").alias("path"),
            F.max("_fit").alias("_fit"),
        )
    )
    return out.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)],
        "host",
        "path",
        F.col("_fit.rule").alias("rule"),
        F.coalesce("_fit.verdict", F.lit(default)).alias("verdict"),
    )
