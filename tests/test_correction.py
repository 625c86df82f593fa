"""Correction row by row, the nearest entry without all pairs, and metrics on long texts."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.operators import correction, registry


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_rows_with_repeated_and_null_keys_stay_apart(spark):
    vocabulary = correction.vocabulary_frame(spark, {"en": ["village", "survey"]})
    rows = [(1, "one vilage here", "en"), (1, "two survay there", "en"), (None, "a vilage,", "en"), (None, None, "en"), (None, "vilage", None), (2, "", "en"), (3, "vilage", "xx"), (3, "vilage", "xx")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    got = Counter(map(tuple, correction.correct_vocabulary(df, vocabulary, "id").collect()))
    assert got == Counter([(1, "one village here"), (1, "two survey there"), (None, "a village"), (None, ""), (None, "vilage"), (2, ""), (3, "vilage"), (3, "vilage")])


def test_nearest_entries_equal_brute_force(spark):
    r = random.Random(1)
    make = lambda: "".join(r.choice("abcé") for _ in range(r.randrange(1, 16)))
    entries = sorted({make() for _ in range(300)})
    words = {make() for _ in range(200)} | {e[:2] + e[3:] for e in entries[:80]} | {e + "b" for e in entries[80:140]} | {"x" + e[1:] for e in entries[140:200]}
    vocabulary = correction.vocabulary_frame(spark, {"en": entries, "de": ["abc"]})
    frame = spark.createDataFrame([("en", w) for w in words] + [(None, "abc"), ("fr", "abc"), ("en", None)], "lang string, word string")
    got = {(x["word"], x["entry"]) for x in correction.nearest_words(frame, vocabulary).collect()}
    want = set()
    for w in words:
        scored = [(distance(w, e) / max(len(w), len(e)), i, e) for i, e in enumerate(entries)]
        best = min((s for s in scored if s[0] < 0.3 and 1 - s[0] > 0.7), default=None)
        want |= {(w, best[2])} if best else set()
    assert got == want and len(got) > 150


def test_a_large_vocabulary(spark):
    entries = spark.range(100_000).select(F.lit("en").alias("lang"), F.col("id").cast("int").alias("ord"), F.substr(F.sha1(F.col("id").cast("string")), F.lit(1), 6 + F.col("id").cast("int") % 8).alias("entry"))
    words = entries.where("ord % 50 = 0").select("lang", F.concat(F.substr("entry", F.lit(1), F.lit(3)), F.substr("entry", F.lit(5), F.lit(20))).alias("word"))
    began = time.perf_counter()
    found = correction.nearest_words(words, entries)
    assert found.count() >= words.distinct().count() * 0.99 and found.where("distance >= 0.3").count() == 0
    assert time.perf_counter() - began < 120


def test_latest_rows_of_keys_without_orders(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 5, "b"), (2, None, "c"), (None, 1, "d"), (None, 2, "e")], "k long, o long, v string")
    assert {tuple(r) for r in registry.latest_per_key(df, "k", "o").collect()} == {(1, None, "a"), (2, 5, "b"), (None, 2, "e")}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_overlap_of_ngrams(spark, n):
    r = random.Random(2)
    make = lambda: "".join(r.choice("ab\n\U0001f600é") for _ in range(r.randrange(0, 40)))
    pairs = [(make(), make()) for _ in range(200)] + [("", "a"), ("", ""), ("ab", "ab")]
    grams = lambda s: [s] if 0 < len(s) < n else [s[i : i + n] for i in range(len(s) - n + 1)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", T.ngrams(F.col("a"), n).alias("g"), T.multiset_overlap(T.ngrams(F.col("a"), n), T.ngrams(F.col("b"), n)).alias("both")).collect()
    assert all(x["g"] == grams(x["a"]) and x["both"] == (Counter(grams(x["a"])) & Counter(grams(x["b"]))).total() for x in got)


def test_f1_of_long_texts_takes_little(spark):
    r = random.Random(3)
    long = "".join(r.choice("abcdefghijklmnop ") for _ in range(36_000))
    df = spark.createDataFrame([(long, long[:20_000] + "x" + long[20_500:])], "a string, b string")
    df.select(T.f1(F.lit("ab"), F.col("b"))).collect()
    began = time.perf_counter()
    (got,) = df.select(T.f1(F.col("a"), F.col("b"))).first()
    took = time.perf_counter() - began
    a, b = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (long, long[:20_000] + "x" + long[20_500:]))
    assert got == pytest.approx(2 * (a & b).total() / (a.total() + b.total())) and took < 3


def test_places_in_a_busy_hour(spark):
    rows = [(i, f"2024-01-01 00:00:{i % 7:02d}.{i % 3}") for i in range(500)] + [(900, None), (901, None)]
    df = spark.createDataFrame(rows, "id long, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = [x["id"] for x in registry.newest_places(df, "at", "id").orderBy("place").collect()]
    assert got == [i for _, i in sorted(((at or "", i) for i, at in rows), reverse=True)]


def test_changes_are_not_sent_to_the_driver(spark):
    """Small files may have many rows, so what Spark makes of their size says nothing of the changes."""
    rows = spark.range(3000).select("id", F.concat(F.lit("vilage "), "id").alias("text"), F.lit("en").alias("lang"))
    fixed = correction.correct_vocabulary(rows, correction.vocabulary_frame(spark, {"en": ["village"]}), "id")
    plan = fixed._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 3 and plan.count("BroadcastHashJoin") <= 1
    assert fixed.where(F.col("corrected") == F.concat(F.lit("village "), "id")).count() == 3000
