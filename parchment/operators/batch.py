"""Runs over many inputs, and data sets made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attempt(df: DataFrame, result: Column, error: Column) -> DataFrame:
    """df with result where there is no error, and error: a bad input is a row, not the end of the run."""
    return df.withColumns({"error": error, "result": F.when(error.isNull(), result)})


def split(df: DataFrame, bucket: Column, shares: tuple[int, int, int] = (14, 3, 3)) -> DataFrame:
    """df with part: train, validation or test by bucket, a number from 0 to below the sum of shares."""
    a, b, _ = shares
    return df.withColumn("part", F.when(bucket < a, "train").when(bucket < a + b, "validation").otherwise("test"))


def generate(numbers: DataFrame, number: str, languages: list[str]) -> DataFrame:
    """(lang, i, record_id, survey): a record of each language for each number, the same at each run."""
    langs = F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), F.lit(k + 1).alias("k")) for k, x in enumerate(languages)]))
    rows = numbers.select(F.col(number).cast("long").alias("i"), langs.alias("l")).select("i", "l.*")
    return rows.select("lang", "i", F.concat("lang", F.lit("-"), F.lpad(F.col("i").cast("string"), 9, "0")).alias("record_id"), (100 + (F.col("i") * 37 + F.col("k")) % 900).alias("survey"))


def truth_from_text(df: DataFrame, text: str) -> DataFrame:
    """df with truth: each line "Key: value" of the text, keys in lower case with underscores; the last one of a key
    counts, other lines are passed over."""
    parts = F.transform(F.filter(F.split(F.col(text), "\n"), lambda l: F.contains(l, F.lit(": "))), lambda l: F.split(l, ": ", 2))
    keyed = F.transform(parts, lambda p: F.struct(F.regexp_replace(F.lower(F.trim(F.get(p, F.lit(0)))), " ", "_").alias("k"), F.trim(F.get(p, F.lit(1))).alias("v")))
    last = F.filter(keyed, lambda x, i: ~F.exists(F.slice(keyed, i + 2, F.size(keyed)), lambda y: y["k"] == x["k"]))
    return df.withColumn("truth", F.map_from_entries(last))
