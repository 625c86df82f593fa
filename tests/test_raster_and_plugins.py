"""Grids against plain loops, and plug-ins by name."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from parchment.operators import plugins, raster

W, H = 11, 7


def grids(n=40, seed=1, most=6):
    r = random.Random(seed)
    return [(i, [[r.randrange(most) if r.random() < r.choice([0.3, 0.9]) else 0 for _ in range(W)] for _ in range(H)]) for i in range(n)] + [(90, [[3] * W] * H), (91, [[0] * W] * H)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, grid array<array<bigint>>")


@pytest.mark.parametrize("cell", [1.0, 2.5])
def test_density(spark, cell):
    r = random.Random(2)
    place = lambda: r.choice([None, *[r.uniform(-5, 30)] * 9])
    boxes = [(r.choice(["a", "b", None]), place(), place(), place(), place()) for _ in range(300)] + [("empty", 5.0, 5.0, 1.0, 1.0), ("c", -9.0, -9.0, 99.0, 99.0), ("c", -9.0, -9.0, 99.0, 99.0), ("edge", float(W * cell), 0.0, 99.0, 1.0)]
    got = {x["k"]: x["grid"] for x in raster.density(spark.createDataFrame(boxes, "k string, x1 double, y1 double, x2 double, y2 double"), "k", W, H, cell).collect()}
    want = {b[0]: [[0] * W for _ in range(H)] for b in boxes}
    for k, x1, y1, x2, y2 in boxes:
        if None not in (x1, y1, x2, y2) and x1 <= x2 and y1 <= y2:
            for y in range(max(0, math.floor(y1 / cell)), min(H - 1, math.floor(y2 / cell)) + 1):
                for x in range(max(0, math.floor(x1 / cell)), min(W - 1, math.floor(x2 / cell)) + 1):
                    want[k][y][x] += 1
    assert got == want


def test_binarisation(spark):
    rows = grids(most=200)
    got = frame(spark, rows).select("id", raster.otsu(F.col("grid")).alias("level"), raster.sauvola(F.col("grid"), W, H).alias("ink")).collect()
    for (i, grid), x in zip(rows, sorted(got, key=lambda x: x["id"])):
        flat, best = [v for row in grid for v in row], None
        for level in sorted(set(flat))[:-1]:
            dark, light = [v for v in flat if v <= level], [v for v in flat if v > level]
            variance = len(dark) * len(light) * (sum(dark) / len(dark) - sum(light) / len(light)) ** 2
            best = max(best or (variance, -level), (variance, -level))
        assert x["id"] == i and x["level"] == (best and -best[1])
        for y in range(H):
            for c in range(W):
                near = [grid[a][b] for a in range(max(0, y - 2), min(H, y + 3)) for b in range(max(0, c - 2), min(W, c + 3))]
                mean = sum(near) / len(near)
                bound = mean * (1 + 0.2 * (math.sqrt(max(0.0, sum(v * v for v in near) / len(near) - mean * mean)) / 128 - 1))
                assert x["ink"][y][c] == (grid[y][c] <= bound) or abs(grid[y][c] - bound) < 1e-9


def test_boxes_of_connected_ink(spark):
    rows = grids(60, 3, 2) + [(95, [[1, 0] * 5 + [1]] * 6 + [[1] * W])]  # a comb: columns that meet in the last row
    got = frame(spark, rows).select("id", raster.ink_boxes(F.transform("grid", lambda row: F.transform(row, lambda v: v > 0))).alias("boxes")).collect()
    for (i, grid), x in zip(rows, sorted(got, key=lambda x: x["id"])):
        left, want = {(y, c) for y in range(H) for c in range(W) if grid[y][c]}, []
        while left:
            piece, todo = set(), [left.pop()]
            while todo:
                y, c = todo.pop()
                piece.add((y, c))
                for at in ((y + 1, c), (y - 1, c), (y, c + 1), (y, c - 1)):
                    if at in left:
                        left.remove(at)
                        todo.append(at)
            ys, xs = [p[0] for p in piece], [p[1] for p in piece]
            want.append((min(xs), min(ys), max(xs), max(ys)))
        assert x["id"] == i and sorted(map(tuple, x["boxes"])) == sorted(want)


def test_known_turns(spark):
    r, rows, turns = random.Random(4), [], {}
    for i in range(40):
        turns[i] = a = r.randrange(-30, 31) / 2
        for _ in range(r.randrange(2, 6)):
            v = r.randrange(0, 400)
            for _ in range(25):
                u = r.uniform(0, 300)
                rows.append((i, u * math.cos(math.radians(a)) - v * math.sin(math.radians(a)), u * math.sin(math.radians(a)) + v * math.cos(math.radians(a))))
    rows += [(0, None, 1.0), (77, None, None)]
    got = {x["id"]: x["angle"] for x in raster.skew(spark.createDataFrame(rows, "id long, x double, y double"), "id", [a / 2 for a in range(-32, 33)]).collect()}
    assert got.keys() == turns.keys() and all(abs(got[i] - a) <= 0.5 for i, a in turns.items())


def test_plug_ins_by_name(spark):
    assert {"lines", "page", "whole"} <= set(plugins.available("recognizer"))
    with pytest.raises(ValueError, match="there are .*lines"):
        plugins.create("recognizer", "trocr")
    with pytest.raises(ValueError, match="already"):
        plugins.plug_in("recognizer", "LINES")(lambda df: df)
    rows = [(1, 1, "b\n\n c ", "Lines"), (1, 0, "a", "lines"), (2, 0, " whole\ntext ", "whole"), (3, 0, "x", None), (4, 0, "y", "other"), (1, 2, None, "LINES"), (2, 1, " ", "whole")]
    df = spark.createDataFrame(rows, "image_id long, place long, text string, by string")
    got = {(x["plugin"], x["image_id"], x["seq"], x["text"]) for x in plugins.apply_by_name(df, "recognizer", "by", ["lines", "Whole"]).collect()}
    assert got == {("lines", 1, 0, "a"), ("lines", 1, 1, "b"), ("lines", 1, 2, "c"), ("whole", 2, 0, "whole\ntext")}

    @plugins.plug_in("recognizer", "upper-test")
    def upper(df):
        return df.select("image_id", F.lit(0).alias("seq"), F.upper("text").alias("text"), F.lit(1.0).alias("confidence"))

    assert {x["text"] for x in plugins.create("recognizer", "UPPER-test")(df.where("image_id = 3")).collect()} == {"X"}


def shuffled(spark, df):
    """How many rows df's stages hand to shuffles."""
    sc, jvm = spark.sparkContext, spark._jvm
    stages = lambda: sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    before = stages().size()
    rows = df.collect()
    time.sleep(1)
    after = stages()
    return rows, sum(after.apply(i).shuffleWriteRecords() for i in range(after.size() - before))


def test_grids_of_many_images_leave_python_as_grids(spark):
    rows = [*grids(30, 5, 200), (200, None)]
    one = raster.binarized(F.col("grid"), W, H).alias("b")
    ink = F.flatten(raster.sauvola(F.col("grid"), W, H))
    got = frame(spark, rows).select("id", one, raster.otsu(F.col("grid")).alias("level"), F.size(F.filter(ink, lambda v: v)).alias("ink"), F.flatten("grid").alias("flat"), raster.ink_boxes(F.col("grid")).alias("boxes")).collect()
    for x in got:
        if x["id"] == 200:
            assert x["b"] is None and x["level"] is None and x["boxes"] is None
        else:
            assert x["b"]["level"] == x["level"] and x["b"]["ink"] == x["ink"]
            assert x["b"]["dark"] == (0 if x["level"] is None else sum(v <= x["level"] for v in x["flat"]))
    plan = raster.ink_boxes(F.col("grid"))  # numbers count as ink, so no grid goes back to the JVM between density and boxes
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 1.0), (1, 5.0, 3.0, 6.0, 3.0), (2, 5.0, 5.0, 1.0, 1.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    found = {x["id"]: [tuple(b) for b in x["b"]] for x in raster.density(boxes, "id", W, H).select("id", plan.alias("b")).collect()}
    assert found == {1: [(0, 0, 2, 1), (5, 3, 6, 3)], 2: []}


def turned(n, a, seed):
    r = random.Random(seed)
    at = [(r.uniform(0, 300), 40.0 * r.randrange(5)) for _ in range(n)]
    return [(u * math.cos(math.radians(a)) - v * math.sin(math.radians(a)), u * math.sin(math.radians(a)) + v * math.cos(math.radians(a))) for u, v in at]


def test_points_are_shuffled_and_not_their_votes(spark):
    rows = [(i, *p) for i in range(50) for p in turned(20, i % 21 - 10, i)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(3).localCheckpoint()
    got, records = shuffled(spark, raster.skew(df, "id", [float(a) for a in range(-15, 16)]))
    assert all(abs(x["angle"] - (x["id"] % 21 - 10)) <= 1 for x in got) and len(got) == 50
    assert records <= 2 * len(rows) + 50


def test_busy_images_are_turned_alike(spark, monkeypatch):
    rows = [(k, *p) for k, a, n in ((1, -7, 200), (2, 4, 30), (None, 9, 120), (None, 9, 100)) for p in turned(n, a, 8)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    angles = [float(a) for a in range(-15, 16)]
    whole = {x["id"]: x["angle"] for x in raster.skew(df, "id", angles).collect()}
    monkeypatch.setattr(raster, "MOST_POINTS", 100)
    assert {x["id"]: x["angle"] for x in raster.skew(df, "id", angles).collect()} == whole == {1: -7.0, 2: 4.0, None: 9.0}
