"""Segmentation of images into regions and layers: one image is one group.

The order-defined steps run in small functions over an image's arrays; grouping,
statistics and everything about sets of regions stays in DataFrames.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.runs import labelled_runs, numbered, run_cells
from tessera.operators.tiles import least_labels


def mask_labels(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Component numbers from 1 in raster order of first pixels, 0 where the mask is clear."""
    h, w = mask.shape
    at = np.arange(h * w).reshape(h, w)
    steps = [(slice(None), slice(None, -1), slice(None), slice(1, None)), (slice(None, -1), slice(None), slice(1, None), slice(None))]
    if diagonal:
        steps += [(slice(None, -1), slice(None, -1), slice(1, None), slice(1, None)), (slice(None, -1), slice(1, None), slice(1, None), slice(None, -1))]
    a, b = [], []
    for y0, x0, y1, x1 in steps:
        both = mask[y0, x0] & mask[y1, x1]
        a.append(at[y0, x0][both])
        b.append(at[y1, x1][both])
    least = least_labels(h * w, np.concatenate(a), np.concatenate(b)).reshape(h, w)
    firsts = np.unique(least[mask])
    out = np.zeros((h, w), np.int64)
    out[mask] = np.searchsorted(firsts, least[mask]) + 1
    return out


def grid(pdf: pd.DataFrame, *columns: str) -> tuple[int, int, list[np.ndarray]]:
    """Width, height and one (height, width) array for each column; cells without a row are zero."""
    w, h = int(pdf.x.max()) + 1, int(pdf.y.max()) + 1
    planes = []
    for c in columns:
        p = np.zeros((h, w), np.int64)
        p[pdf.y.to_numpy(), pdf.x.to_numpy()] = pdf[c].to_numpy()
        planes.append(p)
    return w, h, planes


def setting(pdf: pd.DataFrame, name: str, default):
    """A group's own value of a setting, where its rows carry one."""
    value = pdf[name].iloc[0] if name in pdf else default
    return default if pd.isna(value) else value


def per_image(pixels: DataFrame, kernel: Callable[[pd.DataFrame], dict[str, list]], schema: str) -> DataFrame:
    """Run ``kernel`` on each image's rows; it returns the columns of ``schema`` but for image_id."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(kernel(pdf))
        out.insert(0, "image_id", key[0])
        return out

    return pixels.groupBy("image_id").applyInPandas(run, f"image_id long, {schema}")


def connected_components(mask: DataFrame, diagonal: bool = False) -> DataFrame:
    """(image_id, component, y, x0, x1) of the set pixels of masks(image_id, x, y, fg), as runs; components are numbered from 1 in raster order."""
    return numbered(labelled_runs(mask.filter("fg = 1"), "fg", diagonal))


def binary_layers(mask: DataFrame, speckle: int = 4) -> DataFrame:
    """(image_id, z, r, g, b, cells): each 4-connected component of speckle ** 2 pixels or more is a black layer."""
    cells = run_cells(connected_components(mask), "component").groupBy("image_id", "component").agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("cells"))
    large = cells.filter(F.size("cells") >= speckle * speckle)
    return large.select("image_id", F.col("component").cast("int").alias("z"), *[F.lit(0).alias(c) for c in "rgb"], "cells")


# --- colour clustering -------------------------------------------------------------------------


class Regions:
    """Regions of one image while they are found and merged: pixels, colour sums and what was seen to be a hole."""

    def __init__(self, rgb: np.ndarray):
        self.h, self.w = rgb.shape[:2]
        self.colours = rgb.reshape(-1, 3).tolist()
        self.label = [0] * (self.w * self.h)
        self.pixels: list[list[int]] = [[]]
        self.sums: list[list[int]] = [[0, 0, 0, 0]]

    def add(self, region: int, i: int) -> None:
        self.label[i] = region
        self.pixels[region].append(i)
        s = self.sums[region]
        for k, v in enumerate(self.colours[i]):
            s[k] += v
        s[3] += 1

    def move(self, src: int, dst: int) -> None:
        for i in self.pixels[src]:
            self.label[i] = dst
        self.pixels[dst] += self.pixels[src]
        self.sums[dst] = [a + b for a, b in zip(self.sums[dst], self.sums[src])]
        self.pixels[src], self.sums[src] = [], [0, 0, 0, 0]

    def mean(self, region: int) -> tuple[int, int, int]:
        return mean_of(self.sums[region])

    def around(self, region: int) -> set[int]:
        """Labels next to a region, of four sides; 0 is none."""
        found, label, w, last = set(), self.label, self.w, len(self.label) - self.w
        for i in self.pixels[region]:
            x = i % w
            if i >= w:
                found.add(label[i - w])
            if i < last:
                found.add(label[i + w])
            if x:
                found.add(label[i - 1])
            if x < w - 1:
                found.add(label[i + 1])
        return found - {0, region}


def mean_of(sums: list[int]) -> tuple[int, int, int]:
    return tuple(v // sums[3] for v in sums[:3]) if sums[3] else (0, 0, 0)  # type: ignore[return-value]


def scanned(rgb: np.ndarray, precision: int, diagonal: bool, keyed: np.ndarray) -> Regions:
    """First stage, in raster order.

    A pixel joins the region above if it and the pixel above left are alike
    above it, else the one to the left on the same terms, else (diagonal) the
    one above left, else it starts a region.  Where the regions above and to the
    left differ but are alike, the smaller (the left one of equals) is merged
    first; the newest number, when merged away, is used again.
    """
    shift = 8 - precision
    q = rgb.astype(np.int64) >> shift

    def alike(dy: int, dx: int, ey: int, ex: int) -> np.ndarray:
        """Whether the neighbours of each pixel at two offsets are of the same colour; outside is like nothing."""
        h, w = q.shape[:2]
        pad = np.full((h + 1, w + 1, 3), 10_000)
        pad[1:, 1:] = q
        one, two = (pad[1 - a : 1 - a + h, 1 - b : 1 - b + w] for a, b in ((dy, dx), (ey, ex)))
        return (np.abs(one - two).max(2) <= 1) & (one[:, :, 0] < 10_000) & (two[:, :, 0] < 10_000)

    up, left, corner = alike(0, 0, 1, 0).ravel(), alike(0, 0, 0, 1).ravel(), alike(0, 0, 1, 1).ravel()
    left_up = alike(0, 1, 1, 0).ravel()
    r = Regions(rgb)
    label, w, off = r.label, r.w, keyed.ravel()
    fresh = 1
    for i in range(len(label)):
        above = label[i - w] if i >= w else 0
        before = label[i - 1] if i % w else 0
        if before != above and left_up[i] and (diagonal or (left[i] and up[i])):
            if len(r.pixels[before]) <= len(r.pixels[above]):
                r.move(before, above)
                if before == fresh - 1 and fresh == len(r.pixels):
                    fresh -= 1
                before = above
            else:
                r.move(above, before)
                above = before
        if off[i]:
            continue
        if up[i] and corner[i]:
            r.add(above, i)
        elif left[i] and corner[i]:
            r.add(before, i)
        elif diagonal and corner[i]:
            r.add(label[i - w - 1], i)
        else:
            if fresh == len(r.pixels):
                r.pixels.append([])
                r.sums.append([0, 0, 0, 0])
            else:
                r.pixels[fresh], r.sums[fresh] = [], [0, 0, 0, 0]
            r.add(fresh, i)
            fresh += 1
    return r


def edge_length(pixels: list[int], holes: set[int], w: int) -> int:
    """How many pixels of a region, its holes left out, have a neighbour that is not of it."""
    own = set(pixels) - holes
    xs, ys = [i % w for i in pixels], [i // w for i in pixels]
    left, right, top, bottom = min(xs), max(xs), min(ys), max(ys)
    n = 0
    for i in own:
        x, y = i % w, i // w
        n += x == left or x == right or y == top or y == bottom or not {i - 1, i + 1, i - w, i + w} <= own
    return n


def layered(r: Regions, difference: int, least: int) -> list[tuple[list[int], tuple[int, int, int]]]:
    """Second stage: (pixels, paint) of the layers, bottom first.

    Regions go by area, then number.  Each merges into the neighbour of the
    nearest mean colour.  One that is larger than ``least``, not thread-like, and
    farther than ``difference`` from that neighbour becomes a layer of its own
    first, painted by the pixels that no layer of it took; the neighbour then
    covers its pixels as well.
    """
    whole = r.w * r.h
    rest = [list(s) for s in r.sums]
    holes: dict[int, set[int]] = {}
    out: list[tuple[list[int], int]] = []
    queue = [(len(p), k) for k, p in enumerate(r.pixels) if p]
    heapq.heapify(queue)
    done: set[tuple[int, int]] = set()
    while queue:
        area, k = heapq.heappop(queue)
        if len(r.pixels[k]) != area or r.sums[k][3] != area or (area, k) in done:
            continue
        done.add((area, k))
        own = r.mean(k)
        near = [n for n in r.around(k) if r.sums[n][3]]
        if not near:
            out.append((r.pixels[k], k))
            continue

        def rank(n: int) -> int:
            return sum(abs(a - b) for a, b in zip(own, r.mean(n))) * 65535 + n  # noqa: B023

        target = min(near, key=rank)
        far = sum(abs(a - b) for a, b in zip(own, r.mean(target)))
        if least < area < whole and far > difference and (least == 0 or edge_length(r.pixels[k], holes.get(k, set()), r.w) < area):
            kept = list(r.pixels[k])
            out.append((kept, k))
            if len(near) <= 1:
                holes.setdefault(target, set()).update(kept)
        else:
            rest[target] = [a + b for a, b in zip(rest[target], rest[k])]
        r.move(k, target)
        heapq.heappush(queue, (len(r.pixels[target]), target))
    return [(pixels, mean_of(rest[k])) for pixels, k in reversed(out)]


def colour_layers(pixels: DataFrame, precision: int = 6, difference: int = 16, speckle: int = 4) -> DataFrame:
    """(image_id, z, r, g, b, cells) of pixels(image_id, x, y, r, g, b, a, keyed): z from the bottom, cells as (y, x).

    ``keyed`` marks pixels that belong to no layer.  Images may bring their own
    color_precision, layer_difference and filter_speckle, and a clustering of
    "binary" with a binary_threshold, as columns.
    """

    def kernel(pdf: pd.DataFrame) -> dict[str, list]:
        w, _, (r, g, b, keyed) = grid(pdf, "r", "g", "b", "keyed")
        least = int(setting(pdf, "filter_speckle", speckle)) ** 2
        if setting(pdf, "clustering", "") == "binary":
            labels = mask_labels((r + g + b) // 3 < int(setting(pdf, "binary_threshold", 128))).ravel()
            found = [np.flatnonzero(labels == k).tolist() for k in np.flatnonzero(np.bincount(labels) >= max(1, least)) if k]
            layers = [(p, (0, 0, 0)) for p in found]
        else:
            apart = int(setting(pdf, "layer_difference", difference))
            regions = scanned(np.stack([r, g, b], 2), int(setting(pdf, "color_precision", precision)), apart == 0, keyed == 1)
            layers = layered(regions, apart, least)
        cells = [[{"y": i // w, "x": i % w} for i in sorted(p)] for p, _ in layers]
        return {"z": list(range(len(layers))), **{c: [paint[k] for _, paint in layers] for k, c in enumerate("rgb")}, "cells": cells}

    return per_image(pixels, kernel, "z int, r int, g int, b int, cells array<struct<y:int,x:int>>")


def with_keyed(pixels: DataFrame) -> DataFrame:
    """``pixels`` with ``keyed``: transparent pixels of images that hold enough of them, in their image's unused colour."""
    from tessera.operators.pixels import key_decision, unused_colour

    keys = unused_colour(pixels).select("image_id", *[F.col(c).alias(f"_{c}") for c in "rgb"])
    marked = pixels.join(key_decision(pixels).withColumnRenamed("keyed", "_on"), "image_id").join(keys, "image_id")
    out = marked.withColumn("keyed", (F.col("_on") & (F.col("a") == 0)).cast("int"))
    return out.withColumns({c: F.when(F.col("keyed") == 1, F.col(f"_{c}")).otherwise(F.col(c)) for c in "rgb"}).select("image_id", "x", "y", "r", "g", "b", "a", "keyed")


# --- watershed ---------------------------------------------------------------------------------


def spanning_tree(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, weight, persistence) of the tree's edges in the order they are taken.

    Edges to the right and below go by largest channel distance, then position.
    Each taken edge makes a node over two; a node's volume is what its area, at
    its height below its parent, adds to its children's.  An edge persists as
    long as the lesser of its two sides' volumes.
    """
    h, w = rgb.shape[:2]
    v = rgb.astype(np.int64)
    n = h * w
    at = np.arange(n).reshape(h, w)
    weight = np.concatenate([np.abs(v[:, 1:] - v[:, :-1]).max(2).ravel(), np.abs(v[1:] - v[:-1]).max(2).ravel()])
    p = np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()])
    q = np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])
    ident = np.concatenate([2 * at[:, :-1].ravel(), 2 * at[:-1].ravel() + 1])
    order = np.lexsort((ident, weight))
    root, top = list(range(n)), list(range(n))
    area, left, right = [1] * n, [], []
    taken = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for e, a, b in zip(order.tolist(), p[order].tolist(), q[order].tolist()):
        x, y = find(a), find(b)
        if x == y:
            continue
        left.append(top[x])
        right.append(top[y])
        area.append(area[top[x]] + area[top[y]])
        root[x] = y
        top[y] = n + len(taken)
        taken.append(e)
        if len(taken) == n - 1:
            break
    height = [0] * n + weight[taken].tolist()
    volume = [0] * len(area)
    corrected = [0] * len(area)
    keep = []
    for k, (a, b) in enumerate(zip(left, right)):
        here = n + k
        for side in (a, b):
            volume[side] += area[side] * (height[here] - height[side])
            if height[side] == height[here] and side >= n:
                corrected[side] = max(corrected[left[side - n]], corrected[right[side - n]])
            else:
                corrected[side] = volume[side]
        volume[here] = volume[a] + volume[b]
        keep.append(min(corrected[a], corrected[b]))
    return p[taken], q[taken], weight[taken], np.array(keep, np.int64)


def watershed_labels(pixels: DataFrame, detail: int = 128) -> DataFrame:
    """labels(image_id, x, y, region, r, g, b): the tree cut to about 2 ** (detail / 25.5) regions, numbered in raster order."""

    def kernel(pdf: pd.DataFrame) -> dict[str, list]:
        w, h, (r, g, b) = grid(pdf, "r", "g", "b")
        p, q, _, keep = spanning_tree(np.stack([r, g, b], 2))
        n = w * h
        if len(keep):
            target = min(max(int(np.floor(2 ** (detail / 25.5) + 0.5)), 1), len(keep))
            level = np.sort(keep)[len(keep) - target]
            joined = keep <= level
            least = least_labels(n, p[joined], q[joined])
        else:
            least = np.zeros(n, np.int64)
        region = np.searchsorted(np.unique(least), least)
        at = np.arange(n)
        return {"x": at % w, "y": at // w, "region": region, "r": r.ravel(), "g": g.ravel(), "b": b.ravel()}

    return per_image(pixels, kernel, "x int, y int, region int, r int, g int, b int")
