"""Images as small grids: density of boxes, binarisation, boxes of connected ink, and skew.

A grid is an array of rows, each an array of cells; it has height x width cells whatever it was made from, so an image is a row of
bounded size. What goes into a grid is summed by cell before cells meet. Spark groups and deals the images; what is done
to the cells of one image is done by numpy to all images of an Arrow batch together.
"""

from __future__ import annotations

from math import cos, radians, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Images worked on together, and points up to which an image's votes are counted in one row.
TOGETHER, MOST_POINTS = 512, 4096


def _starts(lists: pa.Array) -> np.ndarray:
    """Where each list of an Arrow array starts in its flattened values, and where the last one ends; null lists are empty."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _lists(starts: np.ndarray, values: pa.Array, mask: pa.Array | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values, mask=mask)


def _null(lists: pa.Array) -> pa.Array | None:
    return lists.is_null() if lists.null_count else None


class _Cells:
    """The cells of all grids of an Arrow array, with the place of each."""

    def __init__(self, grids: pa.Array):
        self.grids, rows = grids, grids.flatten()
        self.of_image, self.of_row = _starts(grids), _starts(rows)
        self.rows, cells = rows, rows.flatten()
        self.known = cells.is_valid().to_numpy(zero_copy_only=False) if cells.null_count else None
        self.values = (cells.fill_null(False) if pa.types.is_boolean(cells.type) else cells.fill_null(0)).to_numpy(zero_copy_only=False)
        self.image_starts = self.of_row[self.of_image]

    def row_of_cell(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of_row) - 1), np.diff(self.of_row))

    def image_of_row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of_image) - 1), np.diff(self.of_image))

    def like(self, values: pa.Array) -> pa.Array:
        """Grids of the same shape with other cells."""
        return _lists(self.of_image, _lists(self.of_row, values, _null(self.rows)), _null(self.grids))


def density(boxes: DataFrame, key: str, width: int, height: int, cell: float = 1.0) -> DataFrame:
    """(key, grid): how many boxes (x1, y1, x2, y2) cover each cell of a grid, for each key. A box covers the cells from that of its
    first corner to that of its second one. Boxes with a null corner, or whose corners are the wrong way round, cover none, and
    what lies beyond the grid is cut off; a key of such boxes alone has a grid of zeros.

    A box adds one to all that is right and below of its first cell and takes it off beyond its last ones, four numbers
    whatever its area; these are summed by cell, and the sum of all above and left of a cell is its density.
    """
    at = lambda c, most: F.least(F.greatest(F.floor(F.col(c) / cell), F.lit(0)), F.lit(most)).cast("int")
    whole = (F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2")) & (F.col("x2") >= 0) & (F.col("y2") >= 0) & (F.col("x1") < width * cell) & (F.col("y1") < height * cell)
    placed = boxes.select(F.col(key).alias("key"), F.coalesce(whole, F.lit(False)).alias("whole"), at("x1", width).alias("a"), at("y1", height).alias("b"), at("x2", width).alias("c"), at("y2", height).alias("d"))
    corner = lambda y, x, n: F.struct((F.least(y, F.lit(height)) * (width + 1) + F.least(x, F.lit(width))).alias("at"), F.lit(n).cast("long").alias("n"))
    a, b, c, d = (F.col(x) for x in "abcd")
    corners = F.when(F.col("whole"), F.array(corner(b, a, 1), corner(b, c + 1, -1), corner(d + 1, a, -1), corner(d + 1, c + 1, 1)))
    sums = placed.select("key", F.explode_outer(corners).alias("p")).groupBy("key", "p.at").agg(F.sum("p.n").alias("n"))
    images = sums.groupBy("key").agg(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "n"))).alias("corners"))

    @F.arrow_udf("array<array<bigint>>")
    def filled(corners: pa.Array) -> pa.Array:
        starts, parts = _starts(corners), corners.flatten()
        at, n = (parts.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        out = np.empty((len(corners), height, width), np.int64)
        for first in range(0, len(corners), TOGETHER):
            ends = starts[first : first + TOGETHER + 1]
            grid = np.zeros((len(ends) - 1, (height + 1) * (width + 1)), np.int64)
            span = slice(ends[0], ends[-1])
            grid[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), at[span]] = n[span]
            square = grid.reshape(-1, height + 1, width + 1)[:, :height, :width]
            np.cumsum(np.cumsum(square, axis=1), axis=2, out=out[first : first + TOGETHER])
        rows = _lists(np.arange(len(corners) * height + 1) * width, pa.array(out.reshape(-1)))
        return _lists(np.arange(len(corners) + 1) * height, rows)

    return images.select(F.col("key").alias(key), filled("corners").alias("grid"))


def shaded(grid: Column, white: int = 255, step: int = 60) -> Column:
    """The grey of each cell of a grid of densities: white, darker by a step for each box up to black."""

    @F.arrow_udf("array<array<bigint>>")
    def grey(grids: pa.Array) -> pa.Array:
        cells = _Cells(grids)
        return cells.like(pa.array(white - np.minimum(white, step * cells.values), mask=None if cells.known is None else ~cells.known))

    return grey(grid)


def _otsu(cells: _Cells) -> tuple[np.ndarray, np.ndarray]:
    """The level of each image, and whether it has one; cells without a value are none."""
    sizes = np.diff(cells.image_starts)
    values, starts = cells.values, cells.image_starts
    if cells.known is not None:
        sizes = np.diff(np.concatenate([[0], np.cumsum(cells.known)])[starts])
        values, starts = values[cells.known], np.concatenate([[0], np.cumsum(sizes)])
    levels, any_level = np.zeros(len(sizes), values.dtype), np.zeros(len(sizes), bool)
    for n in np.unique(sizes):
        same = np.flatnonzero(sizes == n)
        for some in np.split(same, range(TOGETHER, len(same), TOGETHER)) if n > 1 else []:
            own = np.sort(values[starts[some][:, None] + np.arange(n)], axis=1)
            sums = np.cumsum(own, axis=1)
            m, s, total = np.arange(1, n), sums[:, :-1], sums[:, -1:]
            apart = s / m - (total - s) / (n - m)
            variance = np.where(own[:, :-1] != own[:, 1:], m * (n - m) * (apart * apart), -1.0)
            best = np.argmax(variance, axis=1)
            levels[some], any_level[some] = own[np.arange(len(some)), best], own[:, 0] != own[:, -1]
    return levels, any_level


def otsu(grid: Column) -> Column:
    """The level up to which cells are dark so that the variance between dark and light ones is greatest; the least such level. Null if
    all cells are alike."""

    @F.arrow_udf("bigint")
    def level(grids: pa.Array) -> pa.Array:
        levels, known = _otsu(_Cells(grids))
        return pa.array(levels.astype(np.int64), mask=~known)

    return level(grid)


def _sauvola(cells: _Cells, width: int, height: int, radius: int, k: float, spread: float) -> np.ndarray:
    """Whether each cell is ink; cells beyond the grid's width and height, or without a value, are none."""
    rows, images = cells.row_of_cell(), cells.image_of_row()
    x, y = np.arange(len(rows)) - cells.of_row[rows], (np.arange(len(images)) - cells.of_image[images])[rows]
    image, inside = images[rows], (x < width) & (y < height)
    ink = np.zeros(len(rows), bool)
    low = lambda n: np.maximum(np.arange(n) - radius, 0)
    high = lambda n: np.minimum(np.arange(n) + radius, n - 1) + 1
    n = ((high(height) - low(height))[:, None] * (high(width) - low(width))[None, :]).astype(np.int64)

    def around(grid: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(grid), height + 1, width + 1), np.int64)
        np.cumsum(np.cumsum(grid, axis=1), axis=2, out=sums[:, 1:, 1:])
        tall = sums[:, high(height)] - sums[:, low(height)]
        return tall[:, :, high(width)] - tall[:, :, low(width)]

    for first in range(0, len(cells.grids), TOGETHER):
        span = slice(cells.image_starts[first], cells.image_starts[min(first + TOGETHER, len(cells.grids))])
        own, place = inside[span], (image[span] - first, y[span], x[span])
        place = tuple(p[own] for p in place)
        grid = np.zeros((min(TOGETHER, len(cells.grids) - first), height, width), np.int64)
        grid[place] = cells.values[span][own]
        mean, square = around(grid) / n, around(grid * grid) / n
        found = grid <= mean * (1 + k * (np.sqrt(np.maximum(square - mean * mean, 0.0)) / spread - 1))
        ink[np.flatnonzero(own) + span.start] = found[place]
    return ink if cells.known is None else ink & cells.known


def sauvola(grid: Column, width: int, height: int, radius: int = 2, k: float = 0.2, spread: float = 128.0) -> Column:
    """A grid of whether each cell is ink: no lighter than mean * (1 + k * (deviation / spread - 1)) of the cells within the radius,
    which at edges are fewer. Means and deviations come from summed areas of the cells and of their squares."""

    @F.arrow_udf("array<array<boolean>>")
    def ink(grids: pa.Array) -> pa.Array:
        cells = _Cells(grids)
        return cells.like(pa.array(_sauvola(cells, width, height, radius, k, spread)))

    return ink(grid)


def binarized(grid: Column, width: int, height: int, radius: int = 2, k: float = 0.2, spread: float = 128.0) -> Column:
    """struct(level, dark, ink): Otsu's level, and how many cells are ink by it (none without a level) and by Sauvola's."""

    @F.arrow_udf("struct<level:bigint,dark:bigint,ink:bigint>")
    def counted(grids: pa.Array) -> pa.Array:
        cells = _Cells(grids)
        levels, known = _otsu(cells)
        sizes = np.diff(cells.image_starts)
        dark = (cells.values <= np.repeat(levels, sizes)) & np.repeat(known, sizes)
        if cells.known is not None:
            dark &= cells.known
        up_to = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[cells.image_starts])
        ink = _sauvola(cells, width, height, radius, k, spread)
        columns = [pa.array(levels.astype(np.int64), mask=~known), pa.array(up_to(dark)), pa.array(up_to(ink))]
        return pa.StructArray.from_arrays(columns, ["level", "dark", "ink"], mask=_null(grids))

    return counted(grid)


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n things the least one that it is connected with, where a[i] and b[i] are. Labels are lowered along all pairs at
    once, of whole trees, until none changes."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if not (low < high).any():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def ink_boxes(ink: Column) -> Column:
    """array<struct(x1, y1, x2, y2)> of the boxes around each connected piece of ink (cells that share a side), ordered by y1, x1. Cells
    are booleans, or numbers, of which those above 0 are ink.

    Runs of ink in a row are linked with those of the row above that they touch; linked runs are one piece.
    """

    @F.arrow_udf("array<struct<x1:int,y1:int,x2:int,y2:int>>")
    def boxes(grids: pa.Array) -> pa.Array:
        cells = _Cells(grids)
        at = np.flatnonzero(cells.values > 0)
        row = np.searchsorted(cells.of_row, at, "right") - 1
        starts = np.ones(len(at), bool)
        starts[1:] = (np.diff(at) > 1) | (np.diff(row) > 0)
        first = np.flatnonzero(starts)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        row, begin, end = row[first], at[first], at[last]
        base = cells.of_row[row]
        image = np.searchsorted(cells.of_image, row, "right") - 1
        y, x1, x2 = row - cells.of_image[image], begin - base, end - base
        # runs in order of row and place: those of the row above that end no earlier than a run starts, and start no later than it ends
        wide = int(max(x2.max(initial=0) + 2, 1))
        above_from = np.searchsorted(row * wide + x2, (row - 1) * wide + x1, "left")
        above_to = np.searchsorted(row * wide + x1, (row - 1) * wide + x2, "right")
        touched = np.where(y > 0, np.maximum(above_to - above_from, 0), 0)
        own = np.repeat(np.arange(len(row)), touched)
        above = np.repeat(above_from, touched) + np.arange(len(own)) - np.repeat(np.cumsum(touched) - touched, touched)
        piece, of = np.unique(_least_labels(len(row), own, above), return_inverse=True)
        box = [np.full(len(piece), np.iinfo(np.int32).max), y[piece], np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)]
        np.minimum.at(box[0], of, x1)
        np.maximum.at(box[2], of, x2)
        np.maximum.at(box[3], of, y)
        order = np.lexsort((box[2], box[3], box[0], box[1], image[piece]))
        counts = np.bincount(image[piece], minlength=len(grids))
        found = pa.StructArray.from_arrays([pa.array(v[order].astype(np.int32)) for v in box], ["x1", "y1", "x2", "y2"])
        return _lists(np.concatenate([[0], np.cumsum(counts)]), found, _null(grids))

    return boxes(ink)


def skew(points: DataFrame, key: str, angles: list[float]) -> DataFrame:
    """(key, angle): by how many degrees the lines of points (x, y) of each key are turned, one of the given angles. Each point votes at each
    angle for the line through it (its distance from the origin, rounded); at the right angle votes are most uneven, so the sum
    of their squares is greatest. Ties go to the smaller turn, then to the negative one. Points with a null are none.

    The points of a key meet in one row, as they are fewer than their votes. Keys of more than MOST_POINTS points don't: their
    votes are summed by line.
    """
    given = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col(key).alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    busy = F.broadcast(given.groupBy(F.col("key").alias("busy")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_POINTS).select("busy"))
    is_busy = F.col("key").eqNullSafe(F.col("busy"))
    tried = sorted(map(float, angles), key=lambda a: (abs(a), a))

    @F.arrow_udf("double")
    def angle_of(places: pa.Array) -> pa.Array:
        starts, parts = _starts(places), places.flatten()
        x, y = (parts.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        image = np.repeat(np.arange(len(places)), np.diff(starts))
        most, found = np.full(len(places), -1.0), np.full(len(places), np.nan)
        for a in tried:
            line = y * cos(radians(a)) - x * sin(radians(a))
            whole = np.trunc(line)
            line = whole + np.sign(line) * (np.abs(line - whole) >= 0.5)
            order = np.lexsort((line, image))
            same_image, same_line = image[order], line[order]
            first = np.flatnonzero(np.concatenate([[True], (same_image[1:] != same_image[:-1]) | (same_line[1:] != same_line[:-1])])[: len(line)])
            votes = np.diff(np.append(first, len(line))).astype(float)
            uneven = np.bincount(same_image[first], weights=votes * votes, minlength=len(places))
            better = uneven > most
            most[better], found[better] = uneven[better], a
        return pa.array(found)

    few = given.join(busy, is_busy, "left_anti").groupBy("key").agg(F.collect_list(F.struct("x", "y")).alias("places")).select("key", angle_of("places").alias("angle"))
    turns = F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(radians(a)).alias("r")) for a in tried])
    asked = given.join(busy, is_busy, "left_semi").select("key", "x", "y", F.explode(turns).alias("t"))
    line = F.round(F.col("y") * F.cos("t.r") - F.col("x") * F.sin("t.r")).cast("long")
    votes = asked.groupBy("key", "t.angle", line.alias("line")).agg(F.count(F.lit(1)).alias("n"))
    sums = votes.groupBy("key", "angle").agg(F.sum(F.col("n") * F.col("n")).alias("uneven"))
    many = sums.groupBy("key").agg(F.max_by("angle", F.struct("uneven", -F.abs("angle"), -F.col("angle"))).alias("angle"))
    return few.unionByName(many).withColumnRenamed("key", key)
