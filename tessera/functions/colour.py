"""Colour functions over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def intensity(r: Column, g: Column, b: Column) -> Column:
    """The truncated mean of the channels."""
    return F.floor((r + g + b) / 3).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def same_colour(one: list[Column], other: list[Column], shift: int, most: int = 1) -> Column:
    """Channels differ by ``most`` at most after dropping ``shift`` bits."""
    return reduce(lambda x, y: x & y, [F.abs(F.shiftright(p, shift) - F.shiftright(q, shift)) <= most for p, q in zip(one, other)])


def difference(one: list[Column], other: list[Column]) -> Column:
    """Sum of the channels' distances."""
    return sum((F.abs(p - q) for p, q in zip(one[1:], other[1:])), F.abs(one[0] - other[0]))


def edge_weight(one: list[Column], other: list[Column]) -> Column:
    """The largest of the channels' distances."""
    return F.greatest(*[F.abs(p - q) for p, q in zip(one, other)])


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in (r, g, b)])


def linear(c: Column) -> Column:
    """An sRGB channel, 0 to 255, as linear light."""
    v = c / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))


# The OKLab matrices.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def oklab(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b) of the OKLab colour."""
    rgb = [linear(c) for c in (r, g, b)]
    lms = [F.cbrt(sum((k * c for k, c in zip(row[1:], rgb[1:])), row[0] * rgb[0])) for row in TO_LMS]
    lab = [sum((k * c for k, c in zip(row[1:], lms[1:])), row[0] * lms[0]) for row in TO_LAB]
    return F.struct(*[c.alias(n) for c, n in zip(lab, "lab")])


def lab_distance(p: Column, q: Column) -> Column:
    """Squared."""
    return sum(((p[c] - q[c]) * (p[c] - q[c]) for c in "ab"), (p["l"] - q["l"]) * (p["l"] - q["l"]))
