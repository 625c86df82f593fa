"""Quality rules: base metrics of each text and the frequency of its lines across the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import SPACE_CLASS, count_words, let, saved, without, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is above limits in a host if more documents of the host than MAX_DOCS, and more than MAX_SHARE of them or than
#: ALWAYS_DOCS, have it, so that the limit doesn't loosen with the size of the host.
MAX_DOCS = 10
MAX_SHARE = 0.02
ALWAYS_DOCS = 100
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.5
SYMBOLS = "#*$%&|<>"


def lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda l: l.rlike("[^\\x20\\x09-\\x0D]"))


def line_hash(line: Column) -> Column:
    """64-bit hash of a line: lower case, runs of white space as one blank, none at the ends."""
    return F.xxhash64(F.lower(F.btrim(F.regexp_replace(line, f"{SPACE_CLASS}+", " "))))


def repeated_words(ws: Column) -> Column:
    """Words in 3-word windows that occur twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash. Sorted by hash and place, those next to an equal hash repeat; each of
    them, in order of place, adds the words up to the next one, three at most.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def places(s: Column) -> Column:
        twin = lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"])
        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["p"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), p + 3) - p))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeats(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(placed, places), covered))

    return let(ws, lambda w: F.when(F.size(w) < 4, 0).otherwise(let(windows(w), repeats))).cast("long")


def quality_rules(
    docs: DataFrame, text: str = "text", host: str = "source", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, always_docs: int = ALWAYS_DOCS,
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_words_left, clean_text, kept.

    Lines are compared after normalisation, by a 64-bit hash. Documents of a host with equal texts count as one, so
    copies alone make no line frequent; they are left to deduplication. A null host is a host of its own. Lines above
    the limits are removed. A document is kept if the base rules pass and at least min_left of its words are left.
    Null and empty texts have no words and fail the base rules. Each row is judged for itself, repeated rows alike.
    Columns of docs named like a result column are replaced.

    Line counts are summed before they are shuffled, by (host, text, line) and then by (host, line), so no host or
    line meets in one task; texts with frequent lines go back to their rows by a join that Spark can split.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_left", "clean_text", "kept")
    own = without(docs, *names)
    rows = own.select(
        F.struct(*[F.col(f"`{c}`") for c in own.columns if c != text]).alias("q_row"), F.col(text).alias("q_whole"),
        F.coalesce(F.concat(F.lit("h"), host), F.lit("")).alias("q_host"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("q_text"),
    )
    parts = saved(
        rows.select("q_host", "q_text", F.explode(F.transform(lines(F.col("q_whole")), lambda l: F.struct(line_hash(l).alias("line"), count_words(l).alias("n")))).alias("x"))
        .groupBy("q_host", "q_text", "x.line")
        .agg(F.sum("x.n").alias("n"))
    )
    hosts = rows.groupBy("q_host", "q_text").agg(F.count(F.lit(1)).alias("copies"))
    n_docs = hosts.groupBy("q_host").agg(F.count(F.lit(1)).alias("n_docs"))
    frequent = (
        parts.groupBy("q_host", "line").agg(F.count(F.lit(1)).alias("n_with"))
        .where(F.col("n_with") > max_docs)
        .join(n_docs, "q_host")
        .where(F.col("n_with") > F.least(max_share * F.col("n_docs"), F.lit(float(always_docs))))
        .select("q_host", "line")
    )
    # parts has the words of all copies of a text together
    removed = saved(
        parts.join(saved(frequent), ["q_host", "line"])
        .groupBy("q_host", "q_text")
        .agg(F.sum("n").alias("q_removed"), F.collect_set("line").alias("q_lines"))
        .join(hosts, ["q_host", "q_text"])
        .select("q_host", "q_text", (F.col("q_removed") / F.col("copies")).cast("long").alias("q_removed"), "q_lines")
    )
    t, w = F.coalesce(F.col("q_whole"), F.lit("")), words(F.col("q_whole"))
    bare = F.regexp_replace(t, SPACE_CLASS, "")
    measured = rows.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines(F.col("q_whole")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(w),
    })
    left = F.col("n_words") - F.coalesce("q_removed", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    clean = F.array_join(F.filter(F.split(t, "\n"), lambda l: ~F.array_contains("q_lines", line_hash(l))), "\n")
    return (
        measured.join(removed, ["q_host", "q_text"], "left")
        .withColumns({"n_words_left": left, "base_failed": failed})
        .withColumns({
            "clean_text": F.when(F.col("q_lines").isNull(), F.col("q_whole")).otherwise(clean),
            "kept": ~F.col("base_failed") & (F.col("n_words_left") >= min_left * F.col("n_words")),
        })
        .select(*[F.col("q_whole" if c == text else f"q_row.`{c}`").alias(c) for c in own.columns], *names)
    )
