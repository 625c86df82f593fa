"""Search, summaries, duplicate checks and validation over registry tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.functions.text import ngrams

#: How many values of an order, or ranges of them, are counted together.
SPAN = 65_536


def empty_to_null(c: str | Column) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def search(df: DataFrame, contains: dict[str, str] | None = None, equals: dict[str, str] | None = None) -> DataFrame:
    """Rows whose columns contain each query, trimmed and in any case, and equal each value. Empty queries, and the
    value ALL, ask for nothing; a null never contains a query."""
    asked = [(c, q.strip().lower()) for c, q in (contains or {}).items()]
    wanted = [F.lower(F.col(c).cast("string")).contains(q) for c, q in asked if q]
    wanted += [F.col(c) == v for c, v in (equals or {}).items() if v not in ("", "ALL", None)]
    return df.where(reduce(and_, wanted)) if wanted else df


def audit_search(df: DataFrame, keyword: str, role: str, in_columns: list[str], role_column: str) -> DataFrame:
    """Rows with the keyword, in any case but as typed, in one of the columns, and the role within the role column."""
    hit = reduce(lambda a, b: a | b, [F.lower(F.col(c).cast("string")).contains(keyword.lower()) for c in in_columns])
    return df.where(hit if role == "ALL" else hit & F.col(role_column).contains(role))


def kpis(records: DataFrame, alerts: DataFrame, status: str, amount: Column) -> DataFrame:
    """One row: total, verified, pending, alerts (rows of alerts, not flagged records) and the sum of amount."""
    zero = F.lit(0).cast("long")
    sums = records.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(status) == "Verified").alias("verified"), F.count_if(F.col(status) == "Pending").alias("pending"),
        zero.alias("alerts"), F.coalesce(F.sum(amount), F.lit(0.0)).alias("amount"),
    )
    counted = alerts.agg(zero.alias("total"), zero.alias("verified"), zero.alias("pending"), F.count(F.lit(1)).alias("alerts"), F.lit(0.0).alias("amount"))
    return sums.unionByName(counted).agg(*[F.sum(c).alias(c) for c in ("total", "verified", "pending", "alerts", "amount")])


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest order of each key, picked by partial maxima rather than by a sort; rows without an order
    come before all others, and a null key is a key like any other."""
    newest = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("order"))
    return df.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*df.columns), newest).alias("x")).select("x.*")


def newest_first(df: DataFrame, ts: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc())


def newest_places(df: DataFrame, ts: str, tie: str) -> DataFrame:
    """df with place, from 1 for the newest row, null times last; rows of one time by descending tie. As in chunk_of: the rows of
    later seconds plus the place within the second, so that no task sorts all rows, nor those of a busy hour."""
    timed = df.withColumn("_at", F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(1 << 62))))
    seconds = timed.groupBy(F.floor(F.col("_at") / 1_000_000).alias("_second")).agg(F.count(F.lit(1)).alias("_n"))
    before = rows_before(seconds.select((-F.col("_second")).alias("_range"), "_n"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(F.desc("_at"), F.col(tie).desc()))
    placed = timed.withColumn("_range", -F.floor(F.col("_at") / 1_000_000)).withColumn("_place", within).join(before, "_range")
    return placed.withColumn("place", (F.col("_before") + F.col("_place")).cast("long")).drop("_at", "_range", "_before", "_place")


def flag_duplicates(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """new with status Flagged where existing has its key in any case, else Verified."""
    there = existing.select(F.lower(key).alias("_k")).distinct().withColumn("_there", F.lit(True))
    met = new.join(there, F.lower(F.col(key)) == F.col("_k"), "left")
    return met.withColumn("status", F.when(F.col("_there"), "Flagged").otherwise("Verified")).drop("_k", "_there")


def first_match(new: DataFrame, existing: DataFrame, key: str, order: str, report: list[str]) -> DataFrame:
    """new with the reported columns, as first_<name>, of the first existing row that has its key in any case."""
    first = existing.groupBy(F.lower(key).alias("_k")).agg(F.min_by(F.struct(*report), order).alias("_f"))
    met = new.join(first, F.lower(F.col(key)) == F.col("_k"), "left")
    return met.select(*new.columns, *[F.col(f"_f.{c}").alias(f"first_{c}") for c in report])


def repeats(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Rows whose key an earlier row has, with first_<order> of that row. Keys are counted before they are joined."""
    keyed = df.withColumn("_k", key)
    firsts = keyed.groupBy("_k").agg(F.min(order).alias(f"first_{order}"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return keyed.join(firsts, "_k").where(F.col(order) > F.col(f"first_{order}")).drop("_k")


def near_repeats(df: DataFrame, key: Column, order: str, least: float = 0.75, n: int = 3) -> DataFrame:
    """(first, other, key, other_key, similarity): pairs of different keys, in lower case, whose sets of character n-grams have
    at least that Jaccard similarity, each with the smallest order that has it. Null and empty keys resemble nothing.

    Keys are compared once, however many rows have them. Two such sets have one of their rarest n-grams in common, as many
    as they may lack and one, so keys meet under those alone: frequent n-grams only where a key has no others.
    """
    named = df.select(F.lower(key).alias("key"), order).where("key <> ''").groupBy("key").agg(F.min(order).alias("first"))
    sets = named.withColumn("grams", F.array_distinct(ngrams(F.col("key"), n)))
    rows = sets.select("key", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    held = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    place = F.row_number().over(W.partitionBy("key").orderBy("held", "gram"))
    rare = rows.join(held, "gram").withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1)
    mates = rare.select("gram", F.col("key").alias("other_key"), F.col("size").alias("other_size"))
    near = F.least("size", "other_size") >= least * F.greatest("size", "other_size") - 1e-9
    pairs = rare.join(mates, "gram").where((F.col("key") < F.col("other_key")) & near).select("key", "other_key").distinct()
    met = pairs.join(sets, "key").join(sets.select(F.col("key").alias("other_key"), F.col("first").alias("other"), F.col("grams").alias("other_grams")), "other_key")
    both = F.size(F.array_intersect("grams", "other_grams"))
    scored = met.withColumn("similarity", both / (F.size("grams") + F.size("other_grams") - both)).where(F.col("similarity") >= least)
    return scored.select("first", "other", "key", "other_key", "similarity")


def resume(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose key isn't among those done; a _result at the end of a done key doesn't count."""
    return inputs.join(done.select(F.regexp_replace(F.col(key).cast("string"), "_result$", "").alias("_k")).distinct(), F.col(key).cast("string") == F.col("_k"), "left_anti")


def missing_fields(required: list[str]) -> Column:
    """The names of required columns that are null or empty."""
    return F.filter(F.array(*[F.when(empty_to_null(F.col(c).cast("string")).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())


def registration_errors(df: DataFrame, existing: DataFrame, roles: tuple[str, ...] = ("citizen", "patwari", "admin")) -> DataFrame:
    """df (name, email, password, role) with errors: missing fields, an unknown role, an e-mail that exists."""
    known = existing.select(F.col("email").alias("_e")).where("email is not null").distinct().withColumn("_known", F.lit(True))
    met = df.join(known, F.col("email") == F.col("_e"), "left")
    checks = F.array(
        F.when(F.size(missing_fields(["name", "email", "password"])) > 0, "missing"), F.when(~F.coalesce(F.col("role").isin(*roles), F.lit(False)), "role"),
        F.when(F.col("_known"), "exists"),
    )
    return met.withColumn("errors", F.filter(checks, lambda x: x.isNotNull())).drop("_e", "_known")


def resolve_alerts(records: DataFrame, alerts: DataFrame, approved: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The alerts left once those in approved (alert_id) are gone, and records where the first record of each approved
    alert's key is Verified."""
    left = alerts.join(approved, "alert_id", "left_anti")
    keys = alerts.join(approved, "alert_id", "left_semi").select(F.col("alert_key").alias("_k")).distinct()
    firsts = records.join(keys, F.col(key) == F.col("_k"), "left_semi").groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_o"))
    met = records.join(firsts, (F.col(key) == F.col("_k")) & (F.col(order) == F.col("_o")), "left")
    return left, met.withColumn("status", F.when(F.col("_o").isNotNull(), "Verified").otherwise(F.col("status"))).drop("_k", "_o")


def rows_before(counts: DataFrame, levels: int = 2) -> DataFrame:
    """(_range, _before) of counts (_range, _n): how many rows smaller ranges have. Prefix sums run within SPAN ranges, and
    over the sums of those in turn, so that two levels keep every window below SPAN rows for any 64-bit order."""
    if not levels:
        return counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    upper = counts.withColumn("_upper", F.floor(F.col("_range") / SPAN))
    above = rows_before(upper.groupBy(F.col("_upper").alias("_range")).agg(F.sum("_n").alias("_n")), levels - 1)
    within = upper.withColumn("_within", F.sum("_n").over(W.partitionBy("_upper").orderBy("_range")) - F.col("_n"))
    return within.join(above.withColumnsRenamed({"_range": "_upper", "_before": "_above"}), "_upper").select("_range", (F.col("_above") + F.col("_within")).alias("_before"))


def chunk_of(df: DataFrame, order: str, size: int) -> DataFrame:
    """df with seq, its place in the numeric order from 0, and chunk, seq by size; nulls come first. Places are counts of the
    rows before a range of SPAN values plus the place within it, so that no task sorts all rows, nor all ranges of sparse values."""
    ranges = df.withColumn("_range", F.coalesce(F.floor(F.col(order) / SPAN), F.lit(-(1 << 62))))
    before = rows_before(ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")))
    placed = ranges.withColumn("_place", F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1).join(before, "_range")
    seq = (F.col("_before") + F.col("_place")).cast("long")
    return placed.withColumns({"seq": seq, "chunk": F.floor(seq / size)}).drop("_range", "_before", "_place")


def sequence_ids(df: DataFrame, order: str, prefix: str, start: int = 1, digits: int = 3) -> DataFrame:
    """df with seq_id, the prefix and a number padded with zeros, in the given order."""
    numbered = chunk_of(df, order, 1)
    number = (F.col("seq") + start).cast("string")
    return numbered.withColumn("seq_id", F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.lit(digits), F.length(number)), F.lit("0")))).drop("seq", "chunk")


def batch_summary(results: DataFrame, ok: Column, seconds: Column, lang: str) -> DataFrame:
    """One row: total, success, failed, the mean seconds of successes and how many there are of each language."""
    by = results.groupBy(lang).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("s"), F.sum(F.when(ok, seconds)).alias("t"))
    return by.agg(
        F.sum("n").alias("total"), F.sum("s").alias("success"), (F.sum("n") - F.sum("s")).alias("failed"), (F.sum("t") / F.sum("s")).alias("mean_seconds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(lang).alias("l"), F.col("n").alias("n")))), lambda x: F.concat_ws(":", x["l"], x["n"])), ",").alias("languages"),
    )


def audit_scan(records: DataFrame, name: Column, key: str, area: Column, least: float, most: float, required: list[str]) -> DataFrame:
    """(key, issues) of the records that a scan finds fault with: duplicate if the name, in any case, is also that of a record
    with a smaller key; area if it is missing or outside of least to most; missing:<field> for each required field
    that is null or empty. Names are counted by partial minima; null names repeat nothing."""
    named = records.withColumn("_name", F.lower(name))
    first = named.where("_name is not null").groupBy("_name").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    found = F.array(
        F.when(F.col(key) > F.col("_first"), "duplicate"), F.when(~F.coalesce(area.between(least, most), F.lit(False)), "area"),
        *[F.when(empty_to_null(c).isNull(), f"missing:{c}") for c in required],
    )
    return named.join(first, "_name", "left").select(key, F.array_compact(found).alias("issues")).where(F.size("issues") > 0)


def checklist(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(id, rule, passing, failing): how many records keep each rule, a condition; one that is null isn't kept. Rules are counted in
    one pass, and numbered from 1 in their order."""
    counted = records.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values(), 1)])
    rows = [F.struct(F.lit(i).alias("id"), F.lit(name).alias("rule"), F.col(f"r{i}").alias("passing"), (F.col("n") - F.col(f"r{i}")).alias("failing")) for i, name in enumerate(rules, 1)]
    return counted.select(F.inline(F.array(*rows)))
