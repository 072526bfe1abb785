"""Outlines of layers, their simplification, and SVG.

paths(image_id, z, r, g, b, path, points, cubic): the outlines of a layer in
order and its paint.  Points are corners whose last repeats the first, or a chain
of cubics.  Texts and documents are put together by ordered aggregation; paints
travel with the outlines, so that layers are made once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.colour import hex_colour
from tessera.operators.clusters import mask_labels, setting
from tessera.operators.curves import spline, thinned_chain

POINTS = "array<struct<x:double,y:double>>"
PATHS = f"image_id long, z int, r int, g int, b int, path int, points {POINTS}, cubic boolean"
#: Steps along the lattice, and the two pixels (dx, dy) whose border a step follows.
STEPS = {"N": ((0, -1), (-1, -1), (0, -1)), "E": ((1, 0), (0, 0), (0, -1)), "S": ((0, 1), (-1, 0), (0, 0)), "W": ((-1, 0), (-1, 0), (-1, -1))}


def outline(mask: np.ndarray, reverse: bool = False) -> list[tuple[int, int]]:
    """Turning points of the border around the first set pixel, back to the start.

    At each lattice point the first step that follows a border and does not go
    back is taken, in the order N, E, S, W, or the other way round.
    """
    h, w = mask.shape
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return []
    pad = np.zeros((h + 2, w + 2), bool)
    pad[1:-1, 1:-1] = mask
    start = (int(xs[0]), int(ys[0]))
    at, before, earlier, heading = start, start, start, ""
    points = [start]
    order = "WSEN" if reverse else "NESW"
    while True:
        x, y = at
        for step in order:
            (dx, dy), (ax, ay), (bx, by) = STEPS[step]
            ahead = (x + dx, y + dy)
            if ahead not in (before, earlier) and pad[y + ay + 1, x + ax + 1] != pad[y + by + 1, x + bx + 1]:
                break
        else:
            raise ValueError("a border ends")
        if heading and step != heading:
            points.append(at)
            if at == start:
                return points
            heading = ""
            continue
        earlier, before, at, heading = before, at, ahead, step
        if len(points) > 1_000_000:
            raise ValueError("a border without end")


def outlines(mask: np.ndarray) -> list[tuple[list[tuple[int, int]], bool]]:
    """(points, clockwise) of each 4-connected component: its outer border, then those of its holes.

    A hole is a component of what is clear in the component's box and does not
    touch the box's edge.
    """
    out = []
    labels = mask_labels(mask)
    for k in range(1, int(labels.max(initial=0)) + 1):
        ys, xs = np.nonzero(labels == k)
        top, left = ys.min(), xs.min()
        own = labels[top : ys.max() + 1, left : xs.max() + 1] == k
        clear = mask_labels(~own)
        edge = set(np.concatenate([clear[0], clear[-1], clear[:, 0], clear[:, -1]]).tolist())
        inner = [j for j in range(1, int(clear.max(initial=0)) + 1) if j not in edge]
        shapes = [(own | np.isin(clear, inner), False), *((clear == j, True) for j in inner)]
        for shape, hole in shapes:
            out.append(([(int(x + left), int(y + top)) for x, y in outline(shape, hole)], not hole))
    return out


def cross(a: tuple, b: tuple, c: tuple) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])


def without_stairs(points: list[tuple[int, int]], clockwise: bool) -> list[tuple[int, int]]:
    """Points at steps of one pixel go unless they turn the border's own way; both ends stay."""
    n = len(points)
    out = []
    for i, p in enumerate(points):
        before, after = points[i - 1], points[(i + 1) % n]
        if 0 < i < n - 1 and 1 in (abs(p[0] - before[0]) + abs(p[1] - before[1]), abs(p[0] - after[0]) + abs(p[1] - after[1])):
            turn = cross(before, p, after)
            if turn == 0 or (turn > 0) != clockwise:
                continue
        out.append(p)
    return out


def penalty(a: tuple, b: tuple, c: tuple) -> float:
    """Square of the triangle's area over the length of a - c."""
    base = math.dist(a, c)
    s = (math.dist(a, b) + math.dist(b, c) + base) / 2
    square = s * (s - math.dist(a, b)) * (s - math.dist(b, c)) * (s - base)
    area = math.sqrt(square) if square > 0 else 0.0
    return area * area / (base or 1e-30)


def thinned(points: list[tuple[int, int]], most: float = 1.0) -> list[tuple[int, int]]:
    """Greedy: from each kept point as far as the passed points' penalties stay below ``most``; both ends stay."""
    if not points:
        return []
    out, last = [points[0]], 0
    for i in range(2, len(points)):
        if any(penalty(points[last], points[j], points[i]) >= most for j in range(last + 1, i)):
            last = i - 1
            out.append(points[last])
    return [*out, points[-1]] if len(points) > 1 else out


def contours(layers: DataFrame, mode: str = "pixel", corner: float = 60, length: float = 4.0, rounds: int = 10, splice: float = 45, simplify: float = 0.0) -> DataFrame:
    """paths of layers(image_id, z, ..., cells) with ``cubic``, whether the points are a chain of cubics.

    A layer is a group, so that an image's layers are traced side by side.
    Angles are in degrees.  ``simplify`` is the distance within which cubics may
    be fitted anew to have fewer.  Layers may bring their own fit_mode,
    corner_threshold, segment_length, splice_threshold and simplify as columns.
    """

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        how, sharp = setting(pdf, "fit_mode", mode), math.radians(setting(pdf, "corner_threshold", corner))
        within, fine, bend = setting(pdf, "simplify", simplify), setting(pdf, "segment_length", length), math.radians(setting(pdf, "splice_threshold", splice))
        for cells in pdf.cells:
            ys, xs = np.array([c["y"] for c in cells]), np.array([c["x"] for c in cells])
            mask = np.zeros((ys.max() - ys.min() + 1, xs.max() - xs.min() + 1), bool)
            mask[ys - ys.min(), xs - xs.min()] = True
            for points, clockwise in outlines(mask):
                if how != "pixel":
                    points = thinned(without_stairs(points, clockwise))
                if how == "spline":
                    line = spline(points, sharp, fine, rounds, bend)
                    line = thinned_chain(line, within, sharp) if line and within > 0 else line
                    points = [(p.real, p.imag) for p in line]
                if points:
                    found.append([{"x": float(x + xs.min()), "y": float(y + ys.min())} for x, y in points])
        paint = {c: int(pdf[c].iloc[0]) for c in "rgb"}
        return pd.DataFrame({"image_id": key[0], "z": key[1], **paint, "path": range(len(found)), "points": found, "cubic": how == "spline"})

    return layers.groupBy("image_id", "z").applyInPandas(kernel, PATHS)


# --- cleaning and writing ------------------------------------------------------------------------


def quantised(points: Column, digits: int) -> Column:
    """Coordinates rounded half away from zero."""
    k = float(10**digits)

    def away(v: Column) -> Column:
        return F.signum(v) * F.floor(F.abs(v) * k + 0.5) / k

    return F.transform(points, lambda p: F.struct(away(p["x"]).alias("x"), away(p["y"]).alias("y")))


def tidied(points: Column) -> Column:
    """Drops repeated points and merges lines in the same direction; the closing line is left alone."""
    kind = f"struct<out:{POINTS},first:struct<x:double,y:double>,last:struct<x:double,y:double>>"
    start = F.struct(F.array().cast(POINTS).alias("out"), F.lit(None).cast("struct<x:double,y:double>").alias("first"), F.lit(None).cast("struct<x:double,y:double>").alias("last"))

    def step(acc: Column, p: Column) -> Column:
        a, b = acc["first"], acc["last"]
        same = (F.abs(b["x"] - p["x"]) < 1e-6) & (F.abs(b["y"] - p["y"]) < 1e-6)
        base = F.sqrt((p["x"] - a["x"]) * (p["x"] - a["x"]) + (p["y"] - a["y"]) * (p["y"] - a["y"]))
        turn = (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
        straight = (base < 1e-6) | (F.abs(turn) / F.when(base > 0, base).otherwise(1.0) < 1e-4)
        longer = F.struct(F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(p)).alias("out"), a.alias("first"), p.alias("last"))
        more = F.struct(F.concat(acc["out"], F.array(p)).alias("out"), b.alias("first"), p.alias("last"))
        return F.when(b.isNull(), more).when(same, acc).when((F.size(acc["out"]) > 1) & straight, longer).otherwise(more).cast(kind)

    return F.aggregate(points, start.cast(kind), step, lambda acc: acc["out"])


def number(v: float, digits: int | None) -> str:
    """A coordinate as paths write it."""
    if digits is not None:
        k = 10.0**digits
        v = math.copysign(math.floor(abs(v) * k + 0.5), v) / k
    if v == 0:
        return "0"
    s = f"{v:.{digits}f}" if digits is not None else repr(v)
    s = s.rstrip("0").rstrip(".") if "." in s else s
    return s.replace("0.", ".", 1) if s.startswith(("0.", "-0.")) else s


class Pen:
    """Writes a layer's subpaths, each command in its shortest form that the level allows (0: absolute, 1: relative too, 2: shorthands too)."""

    def __init__(self, level: int, digits: int | None):
        self.level, self.digits = level, digits
        self.at = self.home = (0.0, 0.0)
        self.control: tuple[float, float] | None = None
        self.text = ""

    def numbers(self, *values: float) -> str:
        return ",".join(number(v, self.digits) for v in values).replace(",-", "-")

    def forms(self, letter: str, *points: tuple[float, float]) -> list[str]:
        x, y = self.at
        out = [letter + self.numbers(*(v for p in points for v in p))]
        if self.level:
            out.append(letter.lower() + self.numbers(*(v for p in points for v in (p[0] - x, p[1] - y))))
        return out

    def write(self, forms: list[str], end: tuple[float, float], control: tuple[float, float] | None = None) -> None:
        self.text += min(forms, key=len)
        self.at, self.control = end, control

    def move(self, p: tuple[float, float]) -> None:
        self.write(self.forms("M", p)[: None if self.text else 1], p)
        self.home = p

    def line(self, p: tuple[float, float]) -> None:
        forms = []
        if self.level == 2:
            for k, letter in ((1, "H"), (0, "V")):
                if p[k] == self.at[k]:
                    v = p[1 - k]
                    forms += [letter + self.numbers(v), letter.lower() + self.numbers(v - self.at[1 - k])]
        self.write(forms + self.forms("L", p), p)

    def cubic(self, c1: tuple[float, float], c2: tuple[float, float], p: tuple[float, float]) -> None:
        forms = []
        if self.level == 2 and self.control and all(abs(2 * a - c - n) < 1e-6 for a, c, n in zip(self.at, self.control, c1)):
            forms = self.forms("S", c2, p)
        self.write(forms + self.forms("C", c1, c2, p), p, c2)

    def close(self) -> None:
        self.text += "Z"
        self.at, self.control = self.home, None


def path_texts(paths: DataFrame, level: int = 1, digits: int | None = 2) -> DataFrame:
    """(image_id, z, fill, d): each layer's colour and path text, its outlines in order."""

    def text(subpaths: list) -> str:
        pen = Pen(level, digits)
        for points, cubic in ((p["points"], p["cubic"]) for p in subpaths):
            corners = [(p["x"], p["y"]) for p in points]
            if len(corners) < 2:
                continue
            if cubic:
                pen.move(corners[0])
                for k in range(1, len(corners) - 2, 3):
                    pen.cubic(*corners[k : k + 3])
                pen.close()
                continue
            body = corners[1:-1] if corners[0] == corners[-1] else corners[1:]
            pen.move(corners[0])
            for p in body:
                pen.line(p)
            pen.close()
        return pen.text

    @F.pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        return rows.map(text)

    fill = hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("fill")
    ordered = paths.groupBy("image_id", "z", fill).agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "points", "cubic"))), lambda p: F.struct(p["points"].alias("points"), p["cubic"].alias("cubic"))).alias("subpaths"))
    return ordered.select("image_id", "z", "fill", texts("subpaths").alias("d")).filter("d <> ''")


def svg_documents(shapes: DataFrame, sizes: DataFrame, level: int = 1) -> DataFrame:
    """(image_id, svg): layers bottom first; at level 2, runs of one fill share a group."""
    plain = F.concat(F.lit('<path d="'), F.col("d"), F.lit('" fill="'), F.col("fill"), F.lit('"/>\n'))
    if level == 2:
        order = Window.partitionBy("image_id").orderBy("z")
        turns = shapes.withColumn("turn", F.when(F.lag("fill").over(order) == F.col("fill"), 0).otherwise(1))
        runs = turns.withColumn("run", F.sum("turn").over(order)).withColumn("plain", plain)
        bare = F.concat(F.lit('<path d="'), F.col("d"), F.lit('"/>\n'))
        grouped = runs.groupBy("image_id", "run").agg(
            F.first("fill").alias("fill"), F.count("*").alias("n"), F.first("plain").alias("one"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("z", bare.alias("t")))), lambda p: p["t"]), "").alias("many"),
        )
        parts = grouped.select("image_id", F.col("run").alias("z"), F.when(F.col("n") > 1, F.concat(F.lit('<g fill="'), F.col("fill"), F.lit('">\n'), F.col("many"), F.lit("</g>\n"))).otherwise(F.col("one")).alias("t"))
    else:
        parts = shapes.select("image_id", "z", plain.alias("t"))
    body = parts.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("z", "t"))), lambda p: p["t"]), "").alias("body"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<svg version="1.1" xmlns="http://www.w3.org/2000/svg" width="'), F.col("w"), F.lit('" height="'), F.col("h"), F.lit('">\n'))
    return sizes.join(body, "image_id", "left").select("image_id", F.concat(head, F.coalesce("body", F.lit("")), F.lit("</svg>\n")).alias("svg"))


def documents_of(paths: DataFrame, sizes: DataFrame, level: int = 1, digits: int = 2) -> DataFrame:
    """(image_id, svg): rounding and tidying (but at level 0), texts, documents."""
    if level:
        rounded = quantised(F.col("points"), digits)
        paths = paths.withColumn("points", F.when(F.col("cubic"), rounded).otherwise(tidied(rounded))).filter(F.size("points") > 1)
    return svg_documents(path_texts(paths, level, digits), sizes, level)


def vectorised(layers: DataFrame, sizes: DataFrame, mode: str = "pixel", level: int = 1, digits: int = 2, **curve: float) -> DataFrame:
    """Layers to SVG, stacked."""
    return documents_of(contours(layers, mode, **curve), sizes, level, digits)
