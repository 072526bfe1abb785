"""Filling against plain tests of pixel middles."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators.fill import CHORDS, chorded, filled_runs, painted_pixels, preview
from tessera.operators.paths import PATHS


def inside(x, y, outlines):
    odd = False
    for line in outlines:
        for (ax, ay), (bx, by) in zip(line, line[1:] + line[:1]):
            if (ay <= y) != (by <= y) and ax + (y - ay) / (by - ay) * (bx - ax) <= x:
                odd = not odd
    return odd


def table(spark, shapes):
    rows = [(image, z, *paint, k, [{"x": float(x), "y": float(y)} for x, y in line], cubic) for image, z, paint, lines, cubic in shapes for k, line in enumerate(lines)]
    return spark.createDataFrame(rows, PATHS)


def test_polygons_with_holes(spark):
    r = random.Random(6)
    shapes = [(i, 0, (1, 2, 3), [[(r.uniform(-2, 14), r.uniform(-2, 14)) for _ in range(r.randint(3, 7))] for _ in range(r.randint(1, 3))], False) for i in range(25)]
    shapes.append((30, 0, (1, 2, 3), [[(0, 0), (6, 0), (6, 6), (0, 6), (0, 0)], [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)]], False))
    got = {(p.image_id, x, p.y) for p in filled_runs(table(spark, shapes)).collect() for x in range(p.x0, p.x1 + 1)}
    assert got == {(i, x, y) for i, _, _, lines, _ in shapes for x in range(-3, 16) for y in range(-3, 16) if inside(x + 0.5, y + 0.5, lines)}
    assert len([p for p in got if p[0] == 30]) == 32


def test_layers_size_and_preview(spark):
    shapes = [(0, 0, (9, 9, 9), [[(0, 0), (8, 0), (8, 4), (0, 4)]], False), (0, 1, (200, 0, 0), [[(2, -5), (20, -5), (20, 2), (2, 2)]], False)]
    sizes = spark.createDataFrame([(0, 8, 4)], "image_id long, w int, h int")
    got = {(p.x, p.y): p.r for p in painted_pixels(table(spark, shapes), sizes).collect()}
    assert got == {(x, y): 200 if x >= 2 and y < 2 else 9 for x in range(8) for y in range(4)}
    small = {(p.x, p.y): p.r for p in preview(table(spark, shapes), sizes, 4).collect()}
    assert small == {(x, y): 200 if x >= 1 and y < 1 else 9 for x in range(4) for y in range(2)}


def test_cubics_are_near_their_curve(spark):
    k = 0.5522847498 * 10
    circle = [(10, 0), (10, k), (k, 10), (0, 10), (-k, 10), (-10, k), (-10, 0), (-10, -k), (-k, -10), (0, -10), (k, -10), (10, -k), (10, 0)]
    paths = table(spark, [(0, 0, (0, 0, 0), [circle], True)])
    (row,) = paths.select(chorded(F.col("points"), F.col("cubic")).alias("p")).collect()
    assert len(row.p) == 4 * CHORDS + 1 and all(abs((p.x**2 + p.y**2) ** 0.5 - 10) < 0.01 for p in row.p)
    n = sum(p.x1 - p.x0 + 1 for p in filled_runs(paths).collect())
    assert abs(n - 314) < 8
