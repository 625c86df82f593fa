"""Plug-ins by name: recognisers and detectors that others add, as functions of tables.

A plug-in takes a table and gives a table. It is a function of a DataFrame, or a class whose eval gets a table's rows one by one
(and terminate what follows them), which runs as a table-valued function with a table argument: partitioned and ordered as it asks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PlugIn:
    """What a name stands for. partition_by and order_by are columns for classes with eval; schema is that of what they give."""

    made: Callable | type
    schema: str | None = None
    partition_by: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.schema is None:
            return self.made(df)
        table = df.asTable()
        table = table.partitionBy(*self.partition_by) if self.partition_by else table
        table = table.orderBy(*self.order_by) if self.order_by else table
        return F.udtf(self.made, returnType=self.schema)(table)


_known: dict[tuple[str, str], PlugIn] = {}


def plug_in(kind: str, *names: str, **options) -> Callable:
    """Registers a function or class as a kind of plug-in under each of the names, in any case; a name that is taken is an error."""

    def register(made):
        for name in names:
            if _known.setdefault((kind, name.lower()), found := PlugIn(made, **options)) is not found:
                raise ValueError(f"there is a {kind} {name} already")
        return made

    return register


def available(kind: str) -> list[str]:
    return sorted(name for k, name in _known if k == kind)


def create(kind: str, name: str) -> PlugIn:
    """The plug-in of a name, in any case."""
    if (kind, name.lower()) not in _known:
        raise ValueError(f"unknown {kind}: {name}; there are {available(kind)}")
    return _known[kind, name.lower()]


def apply_by_name(df: DataFrame, kind: str, chosen: str, names: list[str]) -> DataFrame:
    """What each of the named plug-ins gives of the rows whose column `chosen` has its name, in any case, with plugin, the name. All must
    give the same columns. Rows that name another plug-in, or none, are left out."""
    parts = [create(kind, n)(df.where(F.lower(chosen) == n.lower()).drop(chosen)).withColumn("plugin", F.lit(n.lower())) for n in names]
    return reduce(DataFrame.unionByName, parts)


@plug_in("recognizer", "lines", schema="image_id long, seq int, text string, confidence double", partition_by=("image_id",), order_by=("place",))
class Lines:
    """Each line with text of an image's texts (image_id, place, text), numbered through; the confidence grows with its length, as that of
    a recogniser without one of its own."""

    def __init__(self):
        self.seq = 0

    def eval(self, row):
        for line in (row["text"] or "").split("\n"):
            if line.strip():
                yield row["image_id"], self.seq, line.strip(), min(0.95, 0.5 + 0.01 * len(line.strip()))
                self.seq += 1


@plug_in("recognizer", "whole", "page")
def whole(df: DataFrame) -> DataFrame:
    """Each text as one region, numbered by its place; blank ones are none."""
    text = F.btrim("text", F.lit(" \n"))
    some = df.withColumn("text", text).where("text <> ''")
    return some.select("image_id", F.col("place").cast("int").alias("seq"), "text", F.least(F.lit(0.95), 0.5 + 0.01 * F.length("text")).alias("confidence"))
