"""Runs, borders, trees and merging as joins, against plain ways over one image's array."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import borders as B
from tessera.operators import graphs as G
from tessera.operators import merging as R
from tessera.operators import mosaic as M
from tessera.operators import runs as U
from tessera.operators import trees as T

LABELS = "image_id long, x int, y int, region int, r int, g int, b int"


def images():
    """Arrays of regions of several kinds: noise, stripes, one region, islands in islands, a hole without cells."""
    r = np.random.default_rng(3)
    nested = np.zeros((9, 11), int)
    nested[1:8, 1:10], nested[2:7, 2:9], nested[4, 4] = 1, 0, 2
    hollow = r.integers(0, 2, (6, 6))
    hollow[2:4, 2:4] = -1
    return [r.integers(0, 2, (8, 7)), r.integers(0, 4, (6, 9)), np.tile(np.arange(5) // 2, (4, 1)), np.zeros((3, 2), int), np.array([[4]]), nested, hollow, np.array([[0, 1], [1, 0]])]


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, x, y, int(v) if v >= 0 else None, 20 * int(v), 3 * x, 5 * y) for k, a in enumerate(images()) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, LABELS).repartition(3).cache()


def flood(a, diagonal):
    """first cell of each cell's piece of equal value."""
    out = -np.ones(a.shape, int)
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (diagonal or not (dy and dx))]
    for y, x in np.ndindex(a.shape):
        if out[y, x] >= 0 or a[y, x] < 0:
            continue
        todo, out[y, x] = [(y, x)], y * a.shape[1] + x
        while todo:
            cy, cx = todo.pop()
            for dy, dx in near:
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < a.shape[0] and 0 <= nx < a.shape[1] and out[ny, nx] < 0 and a[ny, nx] == a[y, x]:
                    out[ny, nx] = out[y, x]
                    todo.append((ny, nx))
    return out


@pytest.mark.parametrize("diagonal", [False, True])
def test_pieces_equal_a_flood_fill(labels, diagonal):
    cells = U.run_cells(U.labelled_runs(labels.filter("region is not null"), "region", diagonal), "label")
    got = {(r.image_id, r.y, r.x): (r.label // U.STRIDE, r.label % U.STRIDE) for r in cells.collect()}
    for k, a in enumerate(images()):
        want = flood(a, diagonal)
        assert {p: got[k, *p] for p in np.ndindex(a.shape) if a[p] >= 0} == {p: divmod(want[p], a.shape[1]) for p in np.ndindex(a.shape) if a[p] >= 0}


def test_runs_that_meet(labels):
    got = {(r.image_id, r.a, r.b, r.shared) for r in U.meeting(U.row_runs(labels.filter("region is not null"), "region"), same=False).collect()}
    want = set()
    for k, a in enumerate(images()):
        runs = []
        for y, line in enumerate(a):
            x = 0
            while x < len(line):
                e = x
                while e + 1 < len(line) and line[e + 1] == line[x]:
                    e += 1
                if line[x] >= 0:
                    runs.append((y, x, e))
                x = e + 1
        for y, s, e in runs:
            for v, t, f in runs:
                if v == y + 1 and t <= e and s <= f:
                    want.add((k, y * U.STRIDE + s, v * U.STRIDE + t, min(e, f) - max(s, t) + 1))
    assert got == want
    with pytest.raises(ValueError):
        U.meeting(U.row_runs(labels, "region"), diagonal=True, same=False)


def test_components_and_roots_of_long_chains(spark):
    chain = [(0, i * 7 % 101, (i + 1) * 7 % 101) for i in range(100)] + [(1, 5, 5), (1, 9, 3)]
    got = {(r.image_id, r.node): r.label for r in G.components(spark.createDataFrame(chain, "image_id long, a long, b long")).collect()}
    assert got == {(0, i): 0 for i in range(101)} | {(1, 5): 5, (1, 9): 3, (1, 3): 3}
    forest = [(0, i, max(i - 1, 0)) for i in range(50)] + [(1, 7, 7)]
    roots = G.rooted(spark.createDataFrame(forest, "image_id long, node long, parent long")).collect()
    assert {(r.image_id, r.node): r.root for r in roots} == {(0, i): 0 for i in range(50)} | {(1, 7): 7}


def test_spanning_tree_equals_kruskal(spark):
    r = np.random.default_rng(5)
    arrays = [r.integers(0, 256, (7, 9, 3)), r.integers(0, 3, (8, 8, 3)), np.zeros((5, 4, 3), int), np.zeros((1, 1, 3), int)]
    rows = [(k, x, y, *map(int, a[y, x])) for k, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    links = T.tree_links(spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int")).collect()
    for k, a in enumerate(arrays):
        h, w = a.shape[:2]
        edges = sorted((int(np.abs(a[y, x] - a[y + dy, x + dx]).max()), y, x, dy, dx) for y in range(h) for x in range(w) for dy, dx in ((0, 1), (1, 0)) if y + dy < h and x + dx < w)
        root = {p: p for p in np.ndindex(h, w)}
        want = set()
        for weight, y, x, dy, dx in edges:
            p, q = root[y, x], root[y + dy, x + dx]
            if p != q:
                root = {i: p if j == q else j for i, j in root.items()}
                want.add((y * U.STRIDE + x, (y + dy) * U.STRIDE + x + dx, weight))
        assert {(r.a, r.b, r.weight) for r in links if r.image_id == k} == want


def area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:])) / 2


def padded(a):
    return np.pad(a, 1, constant_values=-1)


def test_borders_are_found_once_and_end_in_nodes(labels):
    found = M.border_segments(labels).collect()
    for k, a in enumerate(images()):
        own = sorted((r for r in found if r.image_id == k), key=lambda r: r.segment)
        assert [r.segment for r in own] == list(range(len(own)))
        p = padded(a)
        unit = {((x, y - 1), (x, y)) for y in range(1, p.shape[0]) for x in range(p.shape[1] - 1) if p[y, x] != p[y, x + 1]} | {((x - 1, y), (x, y)) for y in range(p.shape[0] - 1) for x in range(1, p.shape[1]) if p[y, x] != p[y + 1, x]}
        degree = defaultdict(int)
        for ends in unit:
            for c in ends:
                degree[c] += 1
        seen = []
        for r in own:
            line = [(int(q.x), int(q.y)) for q in r.points]
            units = []
            for (x0, y0), (x1, y1) in zip(line, line[1:]):
                n = abs(x1 - x0) + abs(y1 - y0)
                dx, dy = np.sign(x1 - x0), np.sign(y1 - y0)
                assert not (dx and dy)
                units += [((x0 + i * dx, y0 + i * dy), (x0 + (i + 1) * dx, y0 + (i + 1) * dy)) for i in range(n)]
            assert all(degree[c] == 2 for u in units[:-1] for c in u[1:])
            assert line[0] == line[-1] if degree[line[0]] == 2 else degree[line[-1]] > 2
            for (ax, ay), (bx, by) in units:  # the right side, y pointing down
                px, py = (ax + bx - (by - ay)) / 2, (ay + by + (bx - ax)) / 2
                qx, qy = (ax + bx + (by - ay)) / 2, (ay + by - (bx - ax)) / 2
                right, left = p[int(np.floor(py)) + 1, int(np.floor(px)) + 1], p[int(np.floor(qy)) + 1, int(np.floor(qx)) + 1]
                assert (right, left if left >= 0 else None) == (r.region_right, r.region_left)
            seen += [tuple(sorted(u)) for u in units]
        assert sorted(seen) == sorted(tuple(sorted(u)) for u in unit)


def test_outlines_make_up_their_regions(labels):
    out = M.region_outlines(labels.filter("region is not null")).groupBy("image_id", "region").agg(F.sum("area2").alias("area2")).collect()
    assert {(r.image_id, r.region): r.area2 for r in out} == {(k, int(v)): 2 * int((a == v).sum()) for k, a in enumerate(images()) for v in np.unique(a) if v >= 0}


@pytest.mark.parametrize("mode", ["pixel", "polygon", "spline"])
def test_faces_are_islands_with_their_holes(labels, mode):
    paths = M.region_paths(labels.filter("region is not null"), mode).collect()
    for k, a in enumerate(images()):
        pieces = flood(a, True)
        want = sorted({(int(a[p]), int(pieces[p])) for p in np.ndindex(a.shape) if a[p] >= 0})
        faces = defaultdict(list)
        for r in paths:
            if r.image_id == k:
                faces[r.z].append(r)
                assert r.points[0] == r.points[-1] and (not r.cubic or len(r.points) % 3 == 1)
        assert sorted(faces) == list(range(len(want)))
        if mode == "pixel":
            for z, (region, first) in enumerate(want):
                assert {r.r for r in faces[z]} == {20 * region} and sorted(r.path for r in faces[z]) == list(range(len(faces[z])))
                assert sum(area([(q.x, q.y) for q in r.points]) for r in faces[z]) == ((pieces == first) & (a == region)).sum()


def test_own_settings_of_an_image(labels):
    own = labels.filter("region is not null").withColumn("fit_mode", F.when(F.col("image_id") == 5, "pixel").otherwise("spline"))
    plain = {k: sorted(map(str, M.region_paths(labels.filter("region is not null"), k).filter("image_id in (0, 5)").collect())) for k in ("pixel", "spline")}
    got = sorted(map(str, M.region_paths(own.filter("image_id in (0, 5)")).collect()))
    assert got == sorted([r for r in plain["spline"] if "image_id=0" in r] + [r for r in plain["pixel"] if "image_id=5" in r])


def merged_plainly(a, rgb, most):
    """The rounds, one after another, over dictionaries."""
    of = {int(v): int(v) for v in np.unique(a)}
    pairs = {(int(p), int(q)) for p, q in [*zip(a[:, :-1].ravel(), a[:, 1:].ravel()), *zip(a[:-1].ravel(), a[1:].ravel())] if p != q}
    while True:
        mean = {r: [int(rgb[np.isin(a, [k for k, v in of.items() if v == r])][:, c].sum()) // int(np.isin(a, [k for k, v in of.items() if v == r]).sum()) for c in range(3)] for r in set(of.values())}
        near = {}
        for p, q in {(of[p], of[q]) for p, q in pairs} | {(of[q], of[p]) for p, q in pairs}:
            d = sum(abs(i - j) for i, j in zip(mean[p], mean[q]))
            if p != q and d <= most:
                near[p] = min(near.get(p, (1 << 30, 0, 0, 0)), (d, min(p, q), max(p, q), q))
        near = {p: v[3] for p, v in near.items()}
        pair = {p: min(p, q) for p, q in near.items() if near.get(q) == p}
        move = pair | {p: pair[q] for p, q in near.items() if p not in pair and q in pair}
        if all(p == q for p, q in move.items()):
            return np.vectorize(of.get)(a), mean
        of = {k: move.get(v, v) for k, v in of.items()}


@pytest.mark.parametrize("most", [0, 6, 30, 90])
def test_images_of_bounded_size_merge_without_rounds_of_joins(spark, monkeypatch, most):
    """As by joins, which larger images still go through; a few jobs, however many rounds it takes."""
    r = np.random.default_rng(most)
    rows = [(k, x, y, (y // 2) * 8 + x // 2, *map(int, r.integers(0, 60, 3)), most) for k in range(6) for y, x in np.ndindex(16, 16)]
    rows += [(9, 0, 0, 1, None, None, None, most), (9, 1, 0, 2, 5, 5, 5, None), (9, 2, 0, 3, 5, 5, 5, None)]
    df = spark.createDataFrame(rows, LABELS + ", layer_difference int")
    jobs = []
    monkeypatch.setattr(R, "merged_by_joins", lambda *a: jobs.append(a))
    got = sorted(map(str, R.merged_regions(df).collect()))
    assert not jobs
    monkeypatch.undo()
    for whole in (0, 3):
        monkeypatch.setattr(R, "WHOLE", whole)
        assert sorted(map(str, R.merged_regions(df).collect())) == got


def test_merging_in_rounds(spark):
    r = np.random.default_rng(11)
    rows, want = [], {}
    for k, most in enumerate((0, 6, 30, 90, -1)):
        a = np.kron(np.arange(20).reshape(4, 5), np.ones((2, 3), int))
        rgb = (np.array([100, 80, 60]) + r.integers(0, 25, (*a.shape, 3)) * (1 + k % 2)).astype(int)
        rows += [(k, x, y, int(a[y, x]), *map(int, rgb[y, x]), most) for y, x in np.ndindex(a.shape)]
        root, mean = merged_plainly(a, rgb, most)
        firsts = {}
        for v in root.ravel().tolist():
            firsts.setdefault(v, len(firsts))
        want |= {(k, y, x): (firsts[root[y, x]], *mean[root[y, x]]) for y, x in np.ndindex(a.shape)}
    got = R.merged_similar(spark.createDataFrame(rows, LABELS + ", layer_difference int"), 0).collect()
    assert {(p.image_id, p.y, p.x): (p.region, p.r, p.g, p.b) for p in got} == want
