"""Boxes as structs of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions.text import let


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])


def box_from_numbers(numbers: Column) -> Column:
    """A box from x1, y1, x2, y2, or the one around the four corners that eight numbers give; null for other sizes."""
    x = F.filter(numbers, lambda v, i: i % 2 == 0)
    y = F.filter(numbers, lambda v, i: i % 2 == 1)
    around = box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))
    return F.when(F.size(numbers) == 4, box(*[F.get(numbers, F.lit(i)) for i in range(4)])).when(F.size(numbers) == 8, around)


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def center(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes apart or without area."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    both = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    union = width(a) * height(a) + width(b) * height(b) - both
    return F.when((both <= 0) | (union <= 0), 0.0).otherwise(both / union)


def clamp(b: Column, image_width: Column, image_height: Column, padding: int = 0) -> Column:
    """The box with padding, cut at the edges of its image."""
    zero = F.lit(0.0)
    return box(
        F.greatest(zero, b["x1"] - padding), F.greatest(zero, b["y1"] - padding),
        F.least(image_width.cast("double"), b["x2"] + padding), F.least(image_height.cast("double"), b["y2"] + padding),
    )


def union_of(x1: str, y1: str, x2: str, y2: str) -> Column:
    """Aggregate: the box around all boxes of a group."""
    return F.struct(F.min(x1).alias("x1"), F.min(y1).alias("y1"), F.max(x2).alias("x2"), F.max(y2).alias("y2"))


def group_of(boxes: Column, threshold: float) -> Column:
    """For each box of an array the place of its group's first box: the first earlier box that leads a group and
    overlaps it by at least the threshold, or itself. A box is compared with the leaders so far alone."""
    number = F.struct(F.lit(0).alias("place"), F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>").alias("box"))
    zero = F.struct(F.array().cast("array<int>").alias("groups"), F.filter(F.array(number), lambda x: F.lit(False)).alias("leads"))

    def place(acc: Column, b: Column) -> Column:
        own = F.size(acc["groups"])
        first = F.get(F.filter(acc["leads"], lambda lead: iou(lead["box"], b) >= threshold), F.lit(0))["place"]

        def joined(lead: Column) -> Column:
            leads = F.when(lead.isNull(), F.concat(acc["leads"], F.array(F.struct(own.alias("place"), b.alias("box"))))).otherwise(acc["leads"])
            return F.struct(F.concat(acc["groups"], F.array(F.coalesce(lead, own))).alias("groups"), leads.alias("leads"))

        return let(first, joined)

    return F.aggregate(boxes, zero, place)["groups"]


def reading_order(boxes: Column, gap: float = 20.0) -> Column:
    """Structs that have x1 and y1 in rows from above: sorted by y1, a row ends where y1 is `gap` or more off the mean y1
    of the row so far; each row from left to right."""

    def by(first: str, second: str):
        return lambda a, b: F.when(a[first] < b[first], -1).when(a[first] > b[first], 1).when(a[second] < b[second], -1).when(a[second] > b[second], 1).otherwise(0)

    down = F.array_sort(boxes, by("y1", "x1"))
    zero = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("rows"))

    def step(acc: Column, b: Column) -> Column:
        new = (acc["n"] == 0) | (F.abs(b["y1"] - acc["sum"] / acc["n"]) >= gap)
        row = acc["row"] + new.cast("int")
        return F.struct(
            row.alias("row"), (F.when(new, 0.0).otherwise(acc["sum"]) + b["y1"]).alias("sum"), (F.when(new, 0).otherwise(acc["n"]) + 1).alias("n"),
            F.concat(acc["rows"], F.array(row)).alias("rows"),
        )

    rows = F.aggregate(down, zero, step)["rows"]
    placed = F.zip_with(rows, down, lambda r, b: F.struct(r.alias("row"), b["x1"].alias("x1"), b.alias("box")))
    return F.transform(F.array_sort(placed, by("row", "x1")), lambda p: p["box"])


def resized(width: Column, height: Column, most: int = 3200, least: int = 640, compat: str | None = None) -> Column:
    """struct(width, height) of an image scaled, in proportion, down until no side is beyond `most` and up until none is below `least`,
    but not beyond `most` again. compat="reference" scales up by the sides as they were and past `most`."""

    def scaled(size: Column, by: Column) -> Column:
        return F.struct(*[F.floor(size[c] * by + 1e-9).cast("int").alias(c) for c in ("width", "height")])

    def both(size: Column) -> Column:
        longest, shortest = F.greatest(size["width"], size["height"]), F.least(size["width"], size["height"])
        if compat == "reference":
            up = F.when(shortest < least, scaled(size, least / shortest))
            return F.when(shortest < least, up).otherwise(F.when(longest > most, scaled(size, most / longest)).otherwise(size))
        return F.when(shortest < least, scaled(size, F.greatest(F.lit(1.0), F.least(least / shortest, most / longest)))).otherwise(size)

    size = F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))
    longest = F.greatest(width, height)
    return both(size) if compat == "reference" else let(F.when(longest > most, scaled(size, most / longest)).otherwise(size), both)
