"""URL filter: pattern rules found through their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.llm.common import literal_table, put

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rule tables up to this many rows are sent to all executors; larger ones are joined by shuffle.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class UrlRule:
    """One rule: a regular expression over host + path, or over the whole lower-cased url.

    ``tokens`` are the runs of letters and digits that any url must contain, as whole runs, to match.
    Rules with ``base`` decide by their length, the longest first; the others are asked only where no
    base rule fits, and block if any of them blocks.
    """

    rule: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = field(default_factory=tuple)
    base: bool = False
    whole: bool = False


def host_rule(verdict: str, rule: str) -> UrlRule:
    """``host/path``: fits the host and all its subdomains, where the path starts with the rule's."""
    host, slash, path = rule.partition("/")
    tokens = re.findall("[A-Za-z0-9]+", host)
    tokens += re.findall("(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", slash + path)
    return UrlRule(rule, verdict, r"^(?:[^/]*\.)?\Q" + host + slash + path + r"\E", tuple(tokens), base=True)


def word_rule(verdict: str, words: str) -> UrlRule:
    """Words joined by hyphens that stand as whole words anywhere in the url, in any case."""
    pattern = r"(?:^|[^a-z0-9])\Q" + words + r"\E(?:[^a-z0-9]|$)"
    return UrlRule(words, verdict, pattern, tuple(re.findall("[a-z0-9]+", words)), whole=True)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column, url: Column) -> Column:
    text = F.translate(F.concat_ws(" ", host, path, url), UPPER, LOWER)
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), 1))


def rule_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    """Rules as a table; ``no`` is a rule's place in the list."""
    return literal_table(
        spark,
        [
            F.struct(
                F.lit(i).alias("_r_no"),
                F.lit(r.rule).alias("_r_rule"),
                F.lit(r.verdict).alias("_r_rule_verdict"),
                F.lit(r.pattern).alias("_r_pattern"),
                F.array(*[F.lit(t.lower()) for t in dict.fromkeys(r.tokens)]).cast("array<string>").alias("_r_tokens"),
                F.lit(r.base).alias("_r_base"),
                F.lit(r.whole).alias("_r_whole"),
            )
            for i, r in enumerate(rules)
        ],
    )


def index_rules(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds ``_token``, the rule's token that the fewest urls have (``''`` for a rule without tokens).

    ``tokens`` holds one row (_token) per url and distinct token of it; only tokens of rules are counted.
    """
    wanted = rules.select("_r_no", F.explode("_r_tokens").alias("_token"))
    seen = tokens.join(F.broadcast(wanted.select("_token").distinct()), "_token").groupBy("_token").count()
    rarest = (
        wanted.join(seen, "_token", "left")
        .groupBy("_r_no")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "_token")).alias("_least"))
        .select("_r_no", F.col("_least._token").alias("_token"))
    )
    return rules.join(rarest, "_r_no", "left").withColumn("_token", F.coalesce("_token", F.lit("")))


def judge_urls(pages: DataFrame, rules: list[UrlRule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule, verdict and pattern_rule to each page.

    A url's tokens fetch the rules indexed under them, and only those run their regular expression.  ``rule`` is
    the base rule that decided, else null; ``pattern_rule`` the blocking word rule that did, else null;
    with neither the verdict is ``default``.  All matches of a url are met in the task that reads it, so what
    is shuffled is one row per page, whatever host or token is hot.

    A null url, or one without ``://``, has an empty host and path, and word rules still see its text.
    Repeated rows are judged one by one; an empty table stays empty; input columns with the
    names of the added ones are replaced (names that begin with ``_`` are reserved).
    """
    if not rules:
        raise ValueError("rules must not be empty")
    spark = pages.sparkSession
    added = ("host", "path", "rule", "verdict", "pattern_rule")
    kept = [c for c in pages.columns if c.lower() not in added]
    source = F.col(f"`{url}`")
    pages = put(pages, host=host_of(source), path=path_of(source)).select(*[f"`{c}`" for c in kept], "host", "path")
    tokens = _tokens(F.col("host"), F.col("path"), source)
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda t: t)
    table = rule_table(spark, rules)
    index = small(index_rules(table, pages.select(F.explode(tokens).alias("_token"))))

    asked = pages.withColumn("_row", F.monotonically_increasing_id()).withColumn(
        "_token", F.explode(F.concat(F.array(F.lit("")), tokens))
    )
    text = F.when(F.col("_r_whole"), F.translate(source, UPPER, LOWER)).otherwise(F.concat("host", "path"))
    fits = F.coalesce(F.rlike(text, F.col("_r_pattern")), F.lit(False))
    blocks = ~F.col("_r_base") & (F.col("_r_rule_verdict") == "block")
    # One number per match, so that the longest base rule (the first of equal ones) is a maximum.
    rank = F.length("_r_rule").cast("long") * (1 << 32) + (F.lit(1 << 31) - F.col("_r_no"))
    found = (
        asked.join(index, "_token", "left")
        .withColumn("_fits", fits)
        .groupBy("_row", *[f"`{c}`" for c in kept], "host", "path")
        .agg(
            F.max(F.when(F.col("_fits") & F.col("_r_base"), rank)).alias("_base"),
            F.max(F.when(F.col("_fits") & blocks, rank)).alias("_word"),
        )
    )

    def number(best: str) -> Column:
        return F.lit(1 << 31) - F.col(best).bitwiseAND((1 << 32) - 1)

    by_base = table.select(F.col("_r_no").alias("_no"), F.col("_r_rule").alias("_rule"), F.col("_r_rule_verdict").alias("_said"))
    by_word = table.select(F.col("_r_no").alias("_word_no"), F.col("_r_rule").alias("_word_rule"))
    out = (
        found.withColumns({"_no": number("_base"), "_word_no": number("_word")})
        .join(small(by_base), "_no", "left")
        .join(small(by_word), "_word_no", "left")
    )
    return out.select(
        *[f"`{c}`" for c in kept],
        "host",
        "path",
        F.col("_rule").alias("rule"),
        F.coalesce("_said", F.when(F.col("_word_rule").isNotNull(), "block"), F.lit(default)).alias("verdict"),
        F.when(F.col("_rule").isNull(), F.col("_word_rule")).alias("pattern_rule"),
    )
