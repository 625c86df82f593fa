"""Alerts on registered deeds: parallel conveyance, claims beyond the recorded area, and rapid resale.

Deeds have parcel, deed, claimant, area, price, date and until (the day up to which the deed bars another one). An alert is
(rule, severity, parcel, primary_deed, conflicting_deed, measure).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.operators.temporal import overlapping, previous

#: The severities of the three rules.
PARALLEL, EXCESS, RESALE = "CRITICAL", "HIGH", "MEDIUM"


def _alert(df: DataFrame, rule: str, severity: str, parcel: Column, primary: Column, conflicting: Column, measure: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), parcel.alias("parcel"), primary.alias("primary_deed"),
        conflicting.alias("conflicting_deed"), measure.cast("double").alias("measure"),
    )


def parallel_deeds(deeds: DataFrame, days: float = 90) -> DataFrame:
    """An alert for each two deeds of one parcel, by different claimants, that are in force at the same time; the primary one is that
    with the earlier date, or the smaller deed of one date. The measure is how many days lie between their dates. A null claimant
    is none, and conflicts with nobody; equal rows of a deed don't conflict with each other."""
    own = deeds.select("parcel", "deed", "claimant", "date", "until").where(F.col("claimant").isNotNull())
    pairs = overlapping(own, own, "parcel", "date", "until", days, ordered=True)
    a, b = F.col("left"), F.col("right")
    first = F.struct(a["date"], a["deed"]) < F.struct(b["date"], b["deed"])
    found = pairs.where(first & (a["claimant"] != b["claimant"]))
    return _alert(found, "parallel_deeds", PARALLEL, a["parcel"], a["deed"], b["deed"], F.datediff(b["date"], a["date"]))


def area_excess(deeds: DataFrame, cadastre: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """An alert for each deed whose area exceeds that of its parcel in cadastre (parcel, area) by more than the tolerance, a share of
    the recorded area. The measure is the excess. Parcels that aren't recorded, or without area, raise none; of several rows of
    a parcel the largest area counts."""
    recorded = cadastre.groupBy("parcel").agg(F.max("area").alias("_recorded"))
    over = deeds.join(recorded, "parcel").where(F.col("area") > F.col("_recorded") * (1 + tolerance))
    return _alert(over, "area_excess", EXCESS, F.col("parcel"), F.lit(None).cast(deeds.schema["deed"].dataType), F.col("deed"), F.col("area") - F.col("_recorded"))


def rapid_resale(deeds: DataFrame, within: int = 30, surge: float = 0.0) -> DataFrame:
    """An alert for each deed less than so many days after the parcel's deed before it (by date, then deed), at a price that is up
    by more than the share `surge`. The measure is the new price by the old one. Deeds without date or price raise none."""
    own = deeds.select("parcel", "deed", "price", "date").where("parcel is not null")
    both = previous(own, "parcel", "date", "deed")
    before = F.col("previous")
    soon = (F.datediff("date", before["date"]) < within) & (F.col("price") > before["price"] * (1 + surge))
    return _alert(both.where(soon), "rapid_resale", RESALE, F.col("parcel"), before["deed"], F.col("deed"), F.col("price") / before["price"])


def alerts(deeds: DataFrame, cadastre: DataFrame, within: int = 30, surge: float = 0.0, tolerance: float = 0.0) -> DataFrame:
    """The alerts of all three rules."""
    return reduce(DataFrame.unionByName, [parallel_deeds(deeds), area_excess(deeds, cadastre, tolerance), rapid_resale(deeds, within, surge)])
