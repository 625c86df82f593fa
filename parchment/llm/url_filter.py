"""URL filters: host-suffix and path-prefix expressions met with rules by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import without

#: Hex digits of the digest that the equi-join uses; the full digest is confirmed after it.
PREFIX_DIGITS = 8
RULES_SCHEMA = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """From after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _expressions(host: Column, path: Column, labels: int, depth: int) -> Column:
    """host suffix + path prefix, for suffixes of up to `labels` labels and prefixes of up to `depth` slashes."""
    parts, dirs = F.split(host, r"\."), F.split(path, "/")
    first = F.greatest(F.lit(1), F.size(parts) - labels + 1)
    suffixes = F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(dirs) - 1, F.lit(depth))),
        lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(dirs, 1, k), "/"), F.lit("/"))),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules (host, path, verdict) fit their host and its subdomains where the url's path starts with the rule's
    path. The longest host + path wins, then the longer host, then `block` over `allow`. Urls that no rule fits
    get a null rule and the verdict `default`. Null urls and urls without `://` have an empty host and path.
    Each row of pages is judged, repeated rows too; columns of pages named host, path, rule or verdict are
    replaced. Rules with a null host, path or verdict are ignored; an empty table of rules leaves the default.

    Each distinct (host, path) is expanded once. The rule's path up to its last slash goes into the expression,
    what follows that slash is confirmed on the path itself, so any prefix can be a rule. Expressions longer than
    any rule are not made.
    """
    good = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
    stem = F.regexp_extract("path", "(?s)^(.*/)?", 0)
    keyed = (
        good.withColumn("r_digest", F.sha2(F.concat("host", stem), 256))
        .select(
            F.substring("r_digest", 1, PREFIX_DIGITS).alias("key"), "r_digest", F.col("path").alias("r_path"),
            F.struct(
                (F.length("host") + F.length("path")).alias("n"), F.length("host").alias("n_host"),
                (F.col("verdict") == "block").alias("blocks"), F.concat("host", "path").alias("rule"), "verdict",
            ).alias("found"),
        )
    )
    most = good.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.size(F.split("path", "/")) - 1).alias("depth")
    ).first()
    judged = without(pages, "host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if most["labels"] is None:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    distinct = judged.select("host", "path").distinct()
    expanded = distinct.withColumn("expression", F.explode(_expressions(F.col("host"), F.col("path"), most["labels"], most["depth"])))
    digest = expanded.select("host", "path", F.sha2("expression", 256).alias("digest"))
    found = (
        digest.withColumn("key", F.substring("digest", 1, PREFIX_DIGITS))
        .join(keyed, "key")
        .where((F.col("digest") == F.col("r_digest")) & F.expr("startswith(path, r_path)"))
        .groupBy("host", "path")
        .agg(F.max("found").alias("found"))
        .select("host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))
    )
    return judged.join(found, ["host", "path"], "left").select(
        *[c for c in judged.columns if c not in ("host", "path")], "host", "path", "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
