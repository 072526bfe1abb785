"""Fixture rasters with known results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clusters as C
from tessera.operators import curves as V
from tessera.operators import decisions as D
from tessera.operators import features as X
from tessera.operators import mosaic as M
from tessera.operators import palettes as A
from tessera.operators import paths as S
from tessera.operators import pixels as P
from tessera.operators import watershed as W
from tessera.operators.runs import run_boxes
from tessera.plans.auto import auto_vectorise, tuned
from tessera.plans.config import PRESETS, Session, Settings, vectorise
from tessera.sources.files import palette_file, preview_size, scene_pixels, write_documents
from tessera.sources.rasters import exploded, image_rows
from tessera.streaming.images import arriving_files, newest_requests

PIXELS = "image_id long, x int, y int, r int, g int, b int, a int"


def pixels(spark, w, h, colour, image=0):
    return spark.createDataFrame([(image, x, y, *c, *(() if len(c) == 4 else (255,))) for y in range(h) for x in range(w) for c in [colour(x, y)]], PIXELS)


def three(x, y):
    return (0, 255, 0) if 6 <= x < 10 and y < 4 else (255, 0, 0) if x < 8 else (0, 0, 255)


def picture(spark, text):
    return P.mask_from_picture(spark.createDataFrame([(0, text)], "image_id long, picture string"))


def test_diagonal_pixels_are_one_or_three_components(spark):
    mask = picture(spark, "*--\n-*-\n--*\n")
    assert run_boxes(C.connected_components(mask)).count() == 3
    assert [r.area for r in run_boxes(C.connected_components(mask, diagonal=True)).collect()] == [3]


def test_component_of_a_block(spark):
    (r,) = run_boxes(C.connected_components(picture(spark, "----\n-**-\n-**-\n----\n"))).collect()
    assert (r.area, r.left, r.top, r.right, r.bottom) == (4, 1, 1, 3, 3)


def test_labels_against_flood_fill():
    r = np.random.default_rng(0)
    for diagonal in (False, True):
        mask = r.random((23, 31)) < 0.55
        labels = C.mask_labels(mask, diagonal)
        seen = np.zeros_like(labels)
        k = 0
        for y, x in np.argwhere(mask):
            if seen[y, x]:
                continue
            k += 1
            todo = [(y, x)]
            seen[y, x] = k
            while todo:
                cy, cx = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        ny, nx = cy + dy, cx + dx
                        if (diagonal or not (dx and dy)) and 0 <= ny < 23 and 0 <= nx < 31 and mask[ny, nx] and not seen[ny, nx]:
                            seen[ny, nx] = k
                            todo.append((ny, nx))
        assert np.array_equal(labels, seen)


def test_outlines_of_square_and_ring():
    ((points, clockwise),) = S.outlines(np.ones((3, 3), bool))
    assert clockwise and points == [(0, 0), (3, 0), (3, 3), (0, 3), (0, 0)]
    ring = np.ones((4, 4), bool)
    ring[1:3, 1:3] = False
    found = S.outlines(ring)
    assert [c for _, c in found] == [True, False] and found[1][0][0] == (1, 1)


def test_outlines_enclose_their_area():
    r = np.random.default_rng(2)
    for _ in range(20):
        mask = r.random((12, 14)) < 0.6
        total = 0.0
        for points, clockwise in S.outlines(mask):
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:])) / 2
            assert (area > 0) == clockwise
            total += area
        assert total == mask.sum()


def test_stairs_are_thinned():
    stairs = [p for i in range(10) for p in ((i, i), (i + 1, i))] + [(10, 10)]
    assert len(S.thinned(stairs)) < len(stairs)
    assert S.without_stairs(stairs, True)[0] == (0, 0) and S.without_stairs(stairs, True)[-1] == (10, 10)


def test_two_colours_are_two_layers(spark):
    px = pixels(spark, 4, 2, lambda x, y: (255, 0, 0) if x < 2 else (0, 0, 255)).withColumn("keyed", F.lit(0))
    got = {(r.r, r.g, r.b): len(r.cells) for r in C.colour_layers(px, 8, 16, 0).collect()}
    assert set(got) == {(255, 0, 0), (0, 0, 255)} and max(got.values()) == 8


def test_summed_areas(spark):
    v = np.random.default_rng(4).integers(0, 256, (6, 6)).tolist()
    px = pixels(spark, 6, 6, lambda x, y: (v[y][x],) * 3)
    sat = P.summed_area(px)
    want = np.cumsum(np.cumsum(np.array(v), 0), 1)
    assert all(r.sat == want[r.y][r.x] for r in sat.collect())
    (r,) = P.rectangle_sum(sat, F.lit(2), F.lit(3), F.lit(4), F.lit(4)).filter("x = 0 and y = 0").collect()
    assert r.total == np.array(v)[3:5, 2:5].sum()


def test_features_of_halves_and_posters(spark):
    (f,) = X.image_features(pixels(spark, 80, 60, lambda x, y: (0, 0, 0) if x < 40 else (255, 255, 255))).collect()
    assert (f.quantized_colors, f.palette_share_top8, f.noise_level, f.colorfulness) == (2, 1.0, 0.0, 0.0)
    assert f.dark_share == f.light_share == 0.5
    colours = [(200, 30, 30), (30, 200, 30), (30, 30, 200), (240, 220, 30)]
    (f,) = X.image_features(pixels(spark, 80, 80, lambda x, y: colours[x // 40 + 2 * (y // 40)])).collect()
    assert f.palette_share_top8 == 1.0 and abs(f.dominant_color_share - 0.25) < 0.01 and f.colorfulness > 20 and f.noise_level < 2


ROW = {"image_id": 1, "width": 100, "height": 100, "megapixels": 1.0, "aspect_ratio": 1.0, "quantized_colors": 100, "palette_share_top8": 0.5, "dominant_color_share": 0.2, "edge_density": 0.1, "mean_gradient": 5.0, "flat_share": 0.5, "noise_level": 1.0, "colorfulness": 30.0, "transparent_share": 0.0, "luminance_spread": 100.0, "dark_share": 0.1, "light_share": 0.1, "background_uniformity": 5.0}


@pytest.mark.parametrize(
    "row,want",
    [
        ({"quantized_colors": 4, "palette_share_top8": 0.99, "colorfulness": 2.0, "dark_share": 0.45, "light_share": 0.5, "background_uniformity": 1.5}, {"clustering": "binary", "fit_mode": "spline", "binary_adaptive": False}),
        ({"quantized_colors": 16, "palette_share_top8": 0.9, "colorfulness": 5.0, "dark_share": 0.3, "light_share": 0.4, "background_uniformity": 30.0}, {"clustering": "binary", "binary_adaptive": True}),
        ({"quantized_colors": 40, "palette_share_top8": 0.95, "flat_share": 0.85, "colorfulness": 35.0}, {"clustering": "color-cluster", "hierarchical": "cutout", "max_colors": None}),
        ({"quantized_colors": 900, "palette_share_top8": 0.25, "mean_gradient": 18.0, "noise_level": 4.0}, {"clustering": "color-cluster", "filter_speckle": 4, "layer_difference": 36, "color_precision": 8}),
    ],
)
def test_decisions(spark, row, want):
    df = spark.createDataFrame([tuple((ROW | row).values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in ROW.items()))
    got = {r.goal: r for r in D.heuristic_decision(df).collect()}
    assert {k: got["balanced"][k] for k in want} == want and 0.55 <= got["balanced"].confidence <= 0.95
    if want.get("layer_difference") == 36:
        assert got["faithful"].filter_speckle < got["compact"].filter_speckle and got["faithful"].layer_difference < got["compact"].layer_difference
        assert got["faithful"].simplify is None and got["compact"].simplify and got["compact"].max_colors
    letters = [(r.letter, r.family, r.clustering) for r in D.candidates(df).filter("goal = 'balanced'").orderBy("letter").collect()]
    assert letters[0][:2] == ("A", "flat") and all(c != "binary" for _, _, c in letters)


def test_documents(spark):
    px = pixels(spark, 16, 8, three)
    (r,) = vectorise(px, Settings(filter_speckle=2, mode="pixel", optimize=2)).collect()
    assert 'width="16" height="8"' in r.svg and "#0000FF" in r.svg and "#00FF00" in r.svg and "Z" in r.svg and "C" not in r.svg.split("?>")[1].split("<path", 1)[1]
    (r,) = vectorise(px, PRESETS["bw"]).collect()
    assert 'fill="#000000"' in r.svg
    (r,) = vectorise(px, Settings(filter_speckle=2, palette=((200, 10, 10), (10, 10, 200)))).collect()
    assert set(__import__("re").findall('fill="([^"]+)"', r.svg)) <= {"#C80A0A", "#0A0AC8"}


def test_curves(spark):
    arc = [100 * np.exp(1j * np.pi / 2 * k / 20) for k in range(21)]
    found = V.chain(arc, 0.5)
    assert 1 <= len(found) <= 3 and abs(found[0][0] - arc[0]) < 1e-9 and abs(found[-1][3] - arc[-1]) < 1e-9
    t = np.linspace(0, 1, 50)
    assert max(abs(np.abs(V.at(c, t)) - 100).max() for c in found) < 0.6
    (r,) = vectorise(pixels(spark, 16, 8, three), Settings(filter_speckle=2)).collect()
    assert "#0000FF" in r.svg and "#00FF00" in r.svg and "C" in r.svg.split("<path", 1)[1].upper() and "Z" in r.svg
    disc = pixels(spark, 40, 40, lambda x, y: (0, 0, 0) if (x - 20) ** 2 + (y - 20) ** 2 < 225 else (255, 255, 255))
    (p,) = S.contours(C.binary_layers(P.fixed_threshold(disc)), "spline").collect()
    ring = np.array([complex(q.x, q.y) for q in p.points])
    assert len(ring) % 3 == 1 and np.abs(np.abs(ring[::3] - 20 - 20j) - 15).max() < 1.6


def test_transparent_background_is_left_out(spark):
    px = pixels(spark, 8, 8, lambda x, y: (255, 255, 255, 255) if 2 <= x < 6 and 2 <= y < 6 else (0, 0, 0, 0))
    (r,) = vectorise(px, Settings(filter_speckle=1, mode="polygon")).collect()
    assert r.svg.count("<path") == 1 and "#FFFFFF" in r.svg


def test_levels_draw_the_same(spark):
    px = pixels(spark, 16, 8, three)
    sizes = {k: len(vectorise(px, Settings(filter_speckle=2, mode="pixel", optimize=k)).first().svg) for k in (0, 1, 2)}
    assert sizes[0] >= sizes[1] >= sizes[2]


def test_numbers():
    cases = [(0.0, "0"), (-0.001, "0"), (0.5, ".5"), (-0.5, "-.5"), (2.345, "2.35"), (10.0, "10"), (-0.125, "-.13"), (100.1, "100.1")]
    assert [S.number(v, 2) for v, _ in cases] == [t for _, t in cases]


def test_packed_images_come_back(spark):
    px = pixels(spark, 5, 4, lambda x, y: (x, y, 9, 255 if x else 0))
    assert sorted(map(tuple, exploded(image_rows(px)).collect())) == sorted(map(tuple, px.collect()))


def test_session_keeps_its_segmentation(spark):
    px = pixels(spark, 16, 8, three)
    s = Session(px)
    a = s.render(Settings(filter_speckle=2, mode="pixel")).first().svg
    b = s.render(Settings(filter_speckle=2, mode="polygon", optimize=2)).first().svg
    assert s.made == 1 and a == vectorise(px, Settings(filter_speckle=2, mode="pixel")).first().svg and b
    s.render(Settings(filter_speckle=1, mode="pixel")).first()
    assert s.made == 2
    s.close()


def test_refused_settings():
    with pytest.raises(ValueError):
        Settings(color_precision=9)
    with pytest.raises(ValueError):
        Settings(clustering="other")
    assert Settings(clustering="bw").clustering == "binary" and Settings(mode="none").mode == "pixel"


def test_arriving_files_and_requests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(bytes.fromhex("89504e470d0a1a0a00"))
    (tmp_path / "in" / "b.bin").write_bytes(b"zz")
    q = arriving_files(spark, str(tmp_path / "in")).select("path", "format").writeStream.format("memory").queryName("files").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.format for r in spark.table("files").collect()) == ["Image", "PNG"]
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")], "image_id long, generation long, settings string")
    assert {(r.image_id, r.settings, r.superseded) for r in newest_requests(rows).collect()} == {(1, "c", 2), (2, "x", 0)}


def test_answers_over_rules(spark):
    df = spark.createDataFrame([tuple((ROW | {"quantized_colors": 900}).values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in ROW.items()))
    rules = D.heuristic_decision(df).filter("goal = 'balanced'")
    for answer, speckle in [('{"arguments": {"filter_speckle": 7}}', 7), ('{"filter_speckle": "9"}', 9), ('text {"function_calls": [{"arguments": {"filter_speckle": 500}}]} more', 128), ('{"success": false, "filter_speckle": 7}', 4), ("no object", 4)]:
        (r,) = D.merged_answer(D.answer_fields(rules.withColumn("answer", F.lit(answer)))).collect()
        assert r.filter_speckle == speckle and r.repaired


def test_cutouts(spark):
    px = pixels(spark, 16, 8, three)
    for mode in ("pixel", "polygon", "spline"):
        (r,) = vectorise(px, Settings(filter_speckle=2, hierarchical="cutout", mode=mode, color_precision=8)).collect()
        assert r.svg.count("<path") == 3 and "Z" in r.svg


def test_similar_regions_merge(spark):
    px = pixels(spark, 8, 4, lambda x, y: (100 + x // 2, 100, 100) if x < 6 else (200, 0, 0))
    labels = px.withColumn("region", F.expr("x div 2"))
    got = {(r.region, r.r) for r in M.merged_similar(labels.drop("a"), 5).select("region", "r").distinct().collect()}
    assert got == {(0, 101), (1, 200)}


def test_watershed_layers(spark):
    def scene(x, y):
        return (250, 250, 250) if (x - 12) ** 2 + (y - 10) ** 2 < 36 else (30, 30, 30) if x < 20 else (30, 120 + y, 30)

    layers = W.watershed_layers(pixels(spark, 32, 24, scene), 60, 4).collect()
    cells = {r.z: {(c.x, c.y) for c in r.cells} for r in layers}
    assert len(cells[0]) == 32 * 24
    disc = {(x, y) for x in range(32) for y in range(24) if (x - 12) ** 2 + (y - 10) ** 2 < 36}
    assert any(c == disc for c in cells.values())
    (r,) = vectorise(pixels(spark, 16, 8, three), Settings(clustering="watershed", mode="pixel")).collect()
    assert 'width="16" height="8"' in r.svg and "<path" in r.svg


def test_tree_weights_are_the_smallest():
    r = np.random.default_rng(5)
    rgb = r.integers(0, 256, (7, 9, 3))
    p, q, weight, keep = C.spanning_tree(rgb)
    assert len(weight) == 62 and (np.diff(weight) >= 0).all() and (keep >= 0).all()
    flat = rgb.reshape(-1, 3)
    edges = sorted((int(np.abs(flat[i] - flat[j]).max()), i, j) for i in range(63) for j in (i + 1, i + 9) if j < 63 and (j - i == 9 or j % 9))
    parent = list(range(63))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    total = []
    for d, i, j in edges:
        if find(i) != find(j):
            parent[find(i)] = find(j)
            total.append(d)
    assert sorted(weight.tolist()) == total


def test_few_colours(spark):
    assert A.median_cut([((0, 0, 0), 5), ((10, 0, 0), 5), ((200, 0, 0), 5)], 2) == [(5, 0, 0), (200, 0, 0)] or len(A.median_cut([((0, 0, 0), 5), ((10, 0, 0), 5), ((200, 0, 0), 5)], 2)) == 2
    assert len(A.median_cut([((i, i, i), 1) for i in range(50)], 8)) == 8
    (r,) = vectorise(pixels(spark, 16, 8, three), Settings(filter_speckle=2, max_colors=2, mode="pixel")).collect()
    assert len(set(__import__("re").findall('fill="([^"]+)"', r.svg))) <= 3


def test_fewer_cubics():
    t = np.linspace(0, 2 * np.pi, 25)
    ring = (50 * np.exp(1j * t)).tolist()
    many = [c for a, b in zip(ring, ring[1:]) for c in V.chain([a, b], 0.5)]
    few = V.simplified(many, 1.0, np.pi / 3, True)
    assert len(few) < len(many) and few[0][0] == few[-1][3]
    u = np.linspace(0, 1, 20)
    assert max(np.abs(np.abs(V.at(c, u)) - 50).max() for c in few) < 2
    assert V.simplified(many, 0.0, 1.0, True) is many


def test_simplified_documents_are_not_longer(spark):
    px = pixels(spark, 40, 40, lambda x, y: (0, 0, 0) if (x - 20) ** 2 + (y - 20) ** 2 < 300 else (255, 255, 255))
    plain, less = (len(vectorise(px, Settings(simplify=s)).first().svg) for s in (None, 2.0))
    assert less <= plain


def test_files_and_scenes(spark, tmp_path):
    (tmp_path / "p.txt").write_text("#ff0000, 00f\n\n 112233")
    assert palette_file(spark, str(tmp_path / "p.txt")) == ((255, 0, 0), (0, 0, 255), (17, 34, 51))
    (tmp_path / "q.txt").write_text("#ff0000 nope")
    with pytest.raises(ValueError, match="nope"):
        palette_file(spark, str(tmp_path / "q.txt"))
    px = scene_pixels(spark, 2, 48, 32)
    assert px.count() == 2 * 48 * 32
    svgs = vectorise(px, Settings(mode="polygon"))
    write_documents(svgs, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"), wholetext=True)
    assert sorted(r.value for r in back.select("value").collect()) == sorted(r.svg for r in svgs.collect())
    (r,) = spark.range(1).select(preview_size(F.lit(1000), F.lit(10), 100, 100).alias("s")).collect()
    assert tuple(r.s) == (100, 1)


def test_each_image_has_its_own_settings(spark):
    scan = pixels(spark, 40, 40, lambda x, y: (0, 0, 0) if 8 <= x < 30 and 10 <= y < 30 else (255, 255, 255), image=1)
    poster = pixels(spark, 40, 40, lambda x, y: ((200, 30, 30), (30, 30, 200))[x // 20], image=2)
    px = scan.union(poster)
    got = {r.image_id: r for r in tuned(px).collect()}
    assert got[1].clustering == "binary" and got[2].clustering == "color-cluster"
    svgs = {r.image_id: r.svg for r in auto_vectorise(px).collect()}
    assert svgs[1].count("<path") == 1 and 'fill="#000000"' in svgs[1]
    assert "#C81E1E" in svgs[2] and "#1E1EC8" in svgs[2]


def test_choices_by_letter_and_decisions_as_texts(spark):
    found = X.image_features(pixels(spark, 16, 8, three))
    menu, shown = D.candidates(found), D.presented(D.candidates(found), found)
    own = {r.letter: r.family for r in menu.filter("goal = 'balanced'").collect()}
    turned = {r.letter: r.family for r in shown.filter("goal = 'balanced'").collect()}
    letters, (f,) = sorted(own), found.collect()
    offset = (f.quantized_colors * 7 + f.width + f.height) % len(letters)
    assert turned == {letter: own[letters[(offset + i) % len(letters)]] for i, letter in enumerate(letters)}
    answers = spark.createDataFrame([(0, "balanced", " b\n"), (0, "compact", "Z"), (0, "faithful", None)], "image_id long, goal string, choice string")
    got = {r.goal: r for r in D.chosen_by_letter(shown, answers).collect()}
    assert got["balanced"].family == turned["B"] and got["balanced"].error is None and got["balanced"].clustering
    assert got["compact"].family is None and got["compact"].error.endswith("Z") and got["faithful"].error.endswith("(missing)")
    rules = D.heuristic_decision(found)
    (line,) = rules.filter("goal = 'compact'").select(D.summary().alias("s")).collect()
    assert line.s.startswith("clustering=") and " max_colors=" in line.s and line.s[-4:-3] == "0" or line.s.endswith("1.00")
    back = D.from_json(D.as_json(rules), rules).select("goal", "confidence", *D.PARAMETERS)
    assert sorted(map(str, back.collect())) == sorted(map(str, rules.select("goal", "confidence", *D.PARAMETERS).collect()))
    assert '"rationale":null' in D.as_json(rules).first().json
    kept = {r.goal: r.clustering for r in D.kept_binary(rules, found).collect()}
    assert set(kept.values()) == {"binary"}
