"""Text-quality metrics of pairs (reference, hypothesis), and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import cer, f1, normalize, wer


def pair_metrics(pairs: DataFrame, lang: str = "lang", composed: bool = False) -> DataFrame:
    """pairs with cer, wer and f1 of the normalised texts."""
    n = pairs.withColumns({f"_{c}": normalize(F.col(c), F.col(lang), composed) for c in ("reference", "hypothesis")})
    r, h = F.col("_reference"), F.col("_hypothesis")
    return n.withColumns({"cer": cer(r, h), "wer": wer(r, h), "f1": f1(r, h)}).drop("_reference", "_hypothesis")


def means() -> list[Column]:
    """Macro means: every pair counts alike."""
    return [
        F.avg("cer").alias("cer"), F.avg("wer").alias("wer"), F.avg("f1").alias("f1"), (1 - F.avg("cer")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    ]


def metrics_by(measured: DataFrame, *keys: str) -> DataFrame:
    return measured.groupBy(*keys).agg(*means())


def metrics_with_overall(measured: DataFrame, key: str = "lang", overall: str = "OVERALL") -> DataFrame:
    """A row for each value of key and one over all, in one pass."""
    rolled = measured.rollup(key).agg(*means(), F.grouping(key).alias("all"))
    return rolled.withColumn(key, F.when(F.col("all") == 1, overall).otherwise(F.col(key))).drop("all")


def field_pairs(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc, field, reference, hypothesis) of the fields that either has; what is missing is empty."""
    t = truth.select("doc", "field", F.col("value").alias("reference"))
    p = predicted.select("doc", "field", F.col("value").alias("hypothesis"))
    return t.join(p, ["doc", "field"], "full").fillna("", ["reference", "hypothesis"])


def field_accuracy(measured: DataFrame, field: str, accuracy: str) -> DataFrame:
    """Mean, population deviation and number of each field's accuracies."""
    return measured.groupBy(field).agg(F.avg(accuracy).alias("mean"), F.stddev_pop(accuracy).alias("std"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, n, low, high) of equal bins between the least and the greatest value, which belongs to the last bin."""
    low, high = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    low, step = low or 0.0, ((high or 0.0) - (low or 0.0)) / bins
    bin_of = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / step).cast("int")) if step else F.lit(0)
    counted = df.where(F.col(value).isNotNull()).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", "n", (low + F.col("bin") * step).alias("low"), (low + (F.col("bin") + 1) * step).alias("high"))
