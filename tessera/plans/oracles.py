"""The catalogue's rows in DuckDB's SQL."""

from __future__ import annotations

V = "least(255, greatest(0, floor((embedding[{}]::DOUBLE + 0.6) * 212.5)))::INTEGER"
PX = f"""px AS (
  SELECT *, CASE WHEN r < 48 THEN 0 ELSE 255 END AS a FROM (
    SELECT vec_id // 64 AS image_id, (i - 1)::INTEGER AS x, (vec_id % 64)::INTEGER AS y,
      {V.format('i')} AS r, {V.format('(i + 20) % 64 + 1')} AS g, {V.format('(i + 41) % 64 + 1')} AS b
    FROM embeddings, range(1, 65) t(i)))"""
GREY = "gr AS (SELECT image_id, x, y, ((r + g + b) // 3)::INTEGER AS v FROM px)"
MASK = "mask AS (SELECT image_id, x, y, (v < 128)::INTEGER AS fg FROM gr)"
SIZES = "sizes AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY image_id)"
LABELS = "lab AS (SELECT image_id, x, y, (r // 64)::INTEGER AS region, r, g, b FROM px)"
SAT = """sat AS (
  SELECT image_id, x, y, v, sum(s) OVER (PARTITION BY image_id, x ORDER BY y) AS sat
  FROM (SELECT *, sum(v) OVER (PARTITION BY image_id, y ORDER BY x) AS s FROM gr))"""
LUMA = "(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"
PAIRS = """pairs AS (
  SELECT p.*, q.r AS nr, q.g AS ng, q.b AS nb FROM px p JOIN px q ON p.image_id = q.image_id AND p.y = q.y AND q.x = p.x + 1
  UNION ALL
  SELECT p.*, q.r AS nr, q.g AS ng, q.b AS nb FROM px p JOIN px q ON p.image_id = q.image_id AND p.x = q.x AND q.y = p.y + 1)"""
LPAIRS = """lpairs AS (
  SELECT p.image_id, least(p.region, q.region) AS a, greatest(p.region, q.region) AS b FROM lab p JOIN lab q ON p.image_id = q.image_id AND ((p.y = q.y AND q.x = p.x + 1) OR (p.x = q.x AND q.y = p.y + 1))
  WHERE p.region <> q.region)"""
STATS = """stats AS (
  SELECT image_id, region, count(*) AS area, sum(r)::BIGINT AS sum_r, sum(g)::BIGINT AS sum_g, sum(b)::BIGINT AS sum_b, min(x) AS "left", min(y) AS top, max(x) + 1 AS "right", max(y) + 1 AS bottom,
    (sum(r) // count(*))::INTEGER AS mean_r, (sum(g) // count(*))::INTEGER AS mean_g, (sum(b) // count(*))::INTEGER AS mean_b
  FROM lab GROUP BY image_id, region)"""


def lin(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"


# Linear RGB to cone response, and its cube root to lightness and two axes.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def lab_of(r: str, g: str, b: str) -> tuple[str, str, str]:
    lms = [f"cbrt({' + '.join(f'{k}::DOUBLE * {lin(c)}' for k, c in zip(row, (r, g, b)))})" for row in TO_LMS]
    return tuple("(" + " + ".join(f"({k})::DOUBLE * {m}" for k, m in zip(row, lms)) + ")" for row in TO_LAB)  # type: ignore[return-value]


L, A, B = lab_of("mean_r", "mean_g", "mean_b")
PALETTE = [(200, 10, 10), (10, 10, 200), (10, 200, 10), (240, 220, 30), (128, 128, 128), (20, 20, 20), (245, 245, 245), (120, 60, 160)]
PL, PA, PB = lab_of("pr", "pg", "pb")

SMALL_SIDE = 32  # of the reduction that downsample_nn shows; the features look at 200 a side


def sampled_sql(side: int) -> str:
    return f"""dims AS (
  SELECT *, sqrt(w * h / {float(side * side)}::DOUBLE) AS s FROM sizes),
small AS (SELECT image_id, w, h, CASE WHEN s <= 1 THEN w ELSE greatest(2, floor(w / s + 0.5)::INTEGER) END AS dw, CASE WHEN s <= 1 THEN h ELSE greatest(2, floor(h / s + 0.5)::INTEGER) END AS dh FROM dims),
grid AS (SELECT image_id, w, h, dw, dh, i::INTEGER AS x, j::INTEGER AS y, (i * w // dw)::INTEGER AS px, (j * h // dh)::INTEGER AS py FROM small, range(0, dw) t(i), range(0, dh) u(j)),
smp AS (SELECT g.image_id, g.w, g.h, g.dw, g.dh, g.x, g.y, p.r, p.g, p.b, p.a FROM grid g JOIN px p ON p.image_id = g.image_id AND p.x = g.px AND p.y = g.py)"""


SAMPLED = sampled_sql(200)
HIST = """bk AS (SELECT image_id, (r // 16) * 256 + (g // 16) * 16 + b // 16 AS k, count(*) AS n FROM smp GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, k) AS rank FROM bk),
hist AS (SELECT image_id, count(*)::INTEGER AS quantized_colors, sum(CASE WHEN rank <= 8 THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS palette_share_top8, max(n)::DOUBLE / sum(n)::DOUBLE AS dominant_color_share FROM rk GROUP BY image_id)"""
PCT = f"""lb AS (SELECT image_id, (floor(least(255, greatest(0, {LUMA}))))::INTEGER // 8 AS bin, count(*) AS n FROM smp GROUP BY ALL),
la AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY bin) AS acc, sum(n) OVER (PARTITION BY image_id) AS total FROM lb),
pct AS (SELECT image_id, (min(CASE WHEN acc >= floor(total * 0.05::DOUBLE + 0.5) THEN bin END) * 8 + 4)::INTEGER AS p5, (min(CASE WHEN acc >= floor(total * 0.95::DOUBLE + 0.5) THEN bin END) * 8 + 4)::INTEGER AS p95 FROM la GROUP BY image_id)"""
COL = """cm AS (SELECT image_id, avg(r - g) AS m1, avg(0.5::DOUBLE * (r + g) - b) AS m2, avg((r - g) * (r - g)) AS s1, avg((0.5::DOUBLE * (r + g) - b) * (0.5::DOUBLE * (r + g) - b)) AS s2 FROM smp GROUP BY image_id),
col AS (SELECT image_id, sqrt(greatest(0, s1 - m1 * m1) + greatest(0, s2 - m2 * m2)) + 0.3::DOUBLE * sqrt(m1 * m1 + m2 * m2) AS colorfulness FROM cm)"""
GRAD = f"""lm AS (SELECT image_id, x, y, {LUMA} AS c FROM smp),
nb AS (SELECT c.image_id, c.c, tl.c AS tl, t.c AS t, tr.c AS tr, l.c AS l, r.c AS r, bl.c AS bl, b.c AS b, br.c AS br FROM lm c
  {' '.join(f'JOIN lm {n} ON {n}.image_id = c.image_id AND {n}.x = c.x + {dx} AND {n}.y = c.y + {dy}' for n, dx, dy in (('tl', -1, -1), ('t', 0, -1), ('tr', 1, -1), ('l', -1, 0), ('r', 1, 0), ('bl', -1, 1), ('b', 0, 1), ('br', 1, 1)))}),
gd AS (SELECT image_id, sqrt(pow((tr + 2 * r + br) - (tl + 2 * l + bl), 2) + pow((bl + 2 * b + br) - (tl + 2 * t + tr), 2)) / 8 AS g, abs((t + b + l + r) - 4 * c) AS lap FROM nb),
grad AS (SELECT image_id, avg(g) AS mean_gradient, count(*) FILTER (g > 48)::DOUBLE / count(*) AS edge_density, count(*) FILTER (g < 24)::DOUBLE / count(*) AS flat_share, coalesce(avg(lap) FILTER (g < 24), 0) AS noise_level FROM gd GROUP BY image_id)"""
BORDER = f"""bord AS (SELECT image_id, stddev_pop({LUMA}) AS background_uniformity FROM (SELECT *, greatest(1, floor(least(dw, dh) * 0.08::DOUBLE + 0.5))::INTEGER AS k FROM smp) WHERE x < k OR y < k OR x >= dw - k OR y >= dh - k GROUP BY image_id)"""
FEAT = f"""shares AS (SELECT image_id, any_value(w) AS width, any_value(h) AS height, count(*) FILTER (a < 250)::DOUBLE / count(*) AS transparent_share, count(*) FILTER ({LUMA} < 64)::DOUBLE / count(*) AS dark_share, count(*) FILTER ({LUMA} > 192)::DOUBLE / count(*) AS light_share FROM smp GROUP BY image_id),
feat AS (SELECT image_id, width, height, width * height / 1000000.0::DOUBLE AS megapixels, width / height::DOUBLE AS aspect_ratio, quantized_colors, palette_share_top8, dominant_color_share, edge_density, mean_gradient, flat_share, noise_level, colorfulness, transparent_share, (p95 - p5)::DOUBLE AS luminance_spread, dark_share, light_share, background_uniformity
  FROM shares JOIN hist USING (image_id) JOIN pct USING (image_id) JOIN col USING (image_id) JOIN bord USING (image_id) JOIN grad USING (image_id))"""
ALL_FEAT = ", ".join((PX, SIZES, SAMPLED, HIST, PCT, COL, GRAD, BORDER, FEAT))
GREYISH = "(colorfulness < 14.0)"
SCORES = f"""scored AS (SELECT *,
  CASE WHEN {GREYISH} THEN 1.0::DOUBLE ELSE 0.15::DOUBLE END + CASE WHEN palette_share_top8 > 0.85 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN quantized_colors <= 24 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END + CASE WHEN dark_share + light_share > 0.6 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END + CASE WHEN noise_level < 2.0 THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS line_art,
  CASE WHEN palette_share_top8 > 0.75 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END + CASE WHEN quantized_colors <= 96 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END + CASE WHEN flat_share > 0.5 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN noise_level < 2.5 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END + CASE WHEN {GREYISH} THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS flat_art,
  CASE WHEN quantized_colors > 96 THEN 1.0::DOUBLE ELSE 0.15::DOUBLE END + CASE WHEN palette_share_top8 < 0.55 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END + CASE WHEN noise_level > 1.5 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END + CASE WHEN {GREYISH} THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN mean_gradient > 12 THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS photo
  FROM feat)"""
GOALS = "goals AS (SELECT unnest(['faithful', 'balanced', 'compact']) AS goal)"


def goal(f: object, b: object, c: object) -> str:
    return f"CASE goal WHEN 'faithful' THEN {f} WHEN 'balanced' THEN {b} ELSE {c} END"


def whole(x: str, lo: int, hi: int) -> str:
    return f"least({hi}, greatest({lo}, floor({x} + 0.5)::INTEGER))"


def parameters(column: str) -> str:
    """The rules of each profile, written out."""
    two = "dark_share + light_share > 0.55"
    rules: dict[str, dict[str, object]] = {
        "clustering": {"line-art": "'binary'", "": "'color-cluster'"},
        "hierarchical": {"flat": "CASE WHEN flat_share > 0.55 AND palette_share_top8 > 0.75 THEN 'cutout' ELSE 'stacked' END", "": "'stacked'"},
        "fit_mode": {"pixel-icon": "'pixel'", "": "'spline'"},
        "filter_speckle": {"line-art": goal(1, 3, 3), "flat": goal(2, 4, 4), "line-illustration": goal(1, 2, 2), "gradient-illustration": goal(4, 6, 8), "photo": goal(2, whole("noise_level / 4", 4, 12), 12), "": 1},
        "color_precision": {"flat": "CASE WHEN quantized_colors > 24 THEN 8 ELSE 6 END", "": 8},
        "layer_difference": {
            "flat": goal(12, "CASE WHEN palette_share_top8 > 0.9 THEN 16 ELSE 24 END", 28), "line-illustration": goal(12, 12, 20), "gradient-illustration": goal(24, 32, 40),
            "photo": goal(whole("mean_gradient * 1.5", 24, 40), whole("mean_gradient * 2", 32, 64), whole("mean_gradient * 2.5", 48, 96)), "": 16,
        },
        "corner_threshold": {"gradient-illustration": 120, "photo": 180, "": 60},
        "segment_length": {"": "4.0::DOUBLE"},
        "splice_threshold": {"": 45},
        "max_colors": {"flat": goal("NULL", "NULL", 16), "photo": goal("NULL", "NULL", 24), "": "NULL::INTEGER"},
        "simplify": {"line-art": goal("NULL", "NULL", "1.0::DOUBLE"), "flat": goal("NULL", "NULL", "1.2::DOUBLE"), "line-illustration": goal("NULL", "NULL", "1.0::DOUBLE"), "gradient-illustration": goal("NULL", "1.0::DOUBLE", "1.0::DOUBLE"), "photo": goal("NULL", "1.0::DOUBLE", "2.0::DOUBLE"), "": "NULL::DOUBLE"},
        "binary_threshold": {"line-art": f"CASE WHEN {two} THEN 128 ELSE 160 END", "": 128},
        "binary_adaptive": {"line-art": f"(NOT ({two}) OR background_uniformity > 12)", "": "false"},
        "watershed_detail": {"": 128},
    }
    out = []
    for p, cases in rules.items():
        whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items() if k)
        out.append(f"CASE {column} {whens} ELSE {cases['']} END AS {p}" if whens else f"{cases['']} AS {p}")
    return ", ".join(out)


SVG = """svg AS (SELECT page_id, url, '<svg xmlns="http://www.w3.org/2000/svg" width="' || length(url) || '" height="' || (page_id % 997) || '"><path fill="#' || upper(substr(md5(url), 1, 2)) || '0000" d="M0,0Z"/><path fill="#00FF00" d="M1,1Z"/></svg>' AS svg FROM pages)"""


def q(select: str, *parts: str) -> str:
    return f"WITH {', '.join(parts)} {select}"


CAND = "cand AS (SELECT * FROM (VALUES (0, 255, 0, 0), (1, 0, 255, 0), (2, 0, 0, 255), (3, 255, 255, 0), (4, 0, 255, 255), (5, 255, 0, 255)) t(o, r, g, b) UNION ALL SELECT 6 + i * 49 + j * 7 + k, i * 37, j * 37, k * 37 FROM range(0, 7) a(i), range(0, 7) b(j), range(0, 7) c(k))"
FREE = "free AS (SELECT i.image_id, c.* FROM (SELECT DISTINCT image_id FROM px) i, cand c WHERE NOT EXISTS (SELECT 1 FROM px p WHERE p.image_id = i.image_id AND p.r = c.r AND p.g = c.g AND p.b = c.b))"



def components_sql(reach: int) -> str:
    """Components of dark pixels: runs of each row, joined where they meet in the next row (``reach`` 1: also at corners)."""
    return f"""WITH RECURSIVE {PX}, {GREY},
dark AS (SELECT image_id, x, y, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS k FROM gr WHERE v < 110),
runs AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1, y * 100000 + min(x) AS run FROM dark GROUP BY image_id, y, k),
meet AS (SELECT p.image_id, p.run AS a, q.run AS b FROM runs p JOIN runs q ON p.image_id = q.image_id AND q.y = p.y + 1 AND q.x0 <= p.x1 + {reach} AND q.x1 >= p.x0 - {reach}),
both_ways AS (SELECT * FROM meet UNION SELECT image_id, b, a FROM meet),
reached AS (
  SELECT image_id, run, run AS other FROM runs
  UNION SELECT r.image_id, r.run, e.b FROM reached r JOIN both_ways e ON e.image_id = r.image_id AND e.a = r.other),
least AS (SELECT image_id, run, min(other) AS root FROM reached GROUP BY image_id, run),
numbered AS (SELECT image_id, root, row_number() OVER (PARTITION BY image_id ORDER BY root) AS component FROM (SELECT DISTINCT image_id, root FROM least))
SELECT image_id, component, sum(x1 - x0 + 1)::BIGINT AS area, min(x0) AS "left", min(y) AS top, max(x1) + 1 AS "right", max(y) + 1 AS bottom
FROM runs JOIN least USING (image_id, run) JOIN numbered USING (image_id, root) GROUP BY image_id, component"""


ORACLES: dict[str, str] = {
    "pixels_from_embeddings": q("SELECT * FROM px", PX),
    "pixels_from_events": "SELECT user_id // 64 AS image_id, hour(ts)::INTEGER AS x, (user_id % 64)::INTEGER AS y, least(255, 16 * count(*))::INTEGER AS r, least(255, 16 * count(*))::INTEGER AS g, least(255, 16 * count(*))::INTEGER AS b, 255 AS a FROM events GROUP BY user_id, hour(ts)",
    "packed_images": q("SELECT image_id, w AS width, h AS height, md5(string_agg(printf('%02X%02X%02X%02X', r, g, b, a), '' ORDER BY y, x)) AS rgba_md5 FROM px JOIN sizes USING (image_id) GROUP BY ALL", PX, SIZES),
    "intensity": q("SELECT * FROM gr", PX, GREY),
    "threshold_fixed": q("SELECT * FROM mask", PX, GREY, MASK),
    "sat": q("SELECT image_id, x, y, sat::BIGINT AS sat FROM sat", PX, GREY, SAT),
    "region_sum": q("SELECT g.image_id, g.x, g.y, sum(o.v)::BIGINT AS total FROM gr g JOIN gr o ON g.image_id = o.image_id AND o.x BETWEEN g.x AND g.x + 7 AND o.y BETWEEN g.y AND g.y + 7 GROUP BY ALL", PX, GREY),
    "threshold_adaptive": q(
        """SELECT image_id, x, y, (v * cnt <= tot * 0.85::DOUBLE)::INTEGER AS fg FROM (
        SELECT b.image_id, b.x, b.y, b.v, (x1 - x0 + 1) * (y1 - y0 + 1) AS cnt, p.sat - coalesce(l.sat, 0) - coalesce(u.sat, 0) + coalesce(c.sat, 0) AS tot FROM box b
        JOIN sat p ON p.image_id = b.image_id AND p.x = x1 AND p.y = y1 LEFT JOIN sat l ON l.image_id = b.image_id AND l.x = x0 - 1 AND l.y = y1
        LEFT JOIN sat u ON u.image_id = b.image_id AND u.x = x1 AND u.y = y0 - 1 LEFT JOIN sat c ON c.image_id = b.image_id AND c.x = x0 - 1 AND c.y = y0 - 1)""",
        PX, GREY, SAT, SIZES,
        "box AS (SELECT s.*, greatest(0, x - k) AS x0, least(w - 1, x + k) AS x1, greatest(0, y - k) AS y0, least(h - 1, y + k) AS y1 FROM sat s JOIN (SELECT image_id, w, h, greatest(1, least(w, h) // 8) // 2 AS k FROM sizes) USING (image_id))",
    ),
    "key_decision": q("SELECT image_id, sum(CASE WHEN a = 0 THEN (y = 0)::INT + (y = h // 4)::INT + (y = h // 2)::INT + (y = 3 * h // 4)::INT + (y = h - 1)::INT ELSE 0 END) >= floor(any_value(w) * 2 * 0.2::DOUBLE) AS keyed FROM px JOIN sizes USING (image_id) GROUP BY image_id", PX, SIZES),
    "unused_colour": q(
        "SELECT image_id, arg_min(r, o)::INTEGER AS r, arg_min(g, o)::INTEGER AS g, arg_min(b, o)::INTEGER AS b FROM free GROUP BY image_id", PX,
        CAND, FREE,
    ),
    "same_colour_edges": q("SELECT image_id, count(*) AS n, count(*) FILTER (abs((r >> 2) - (nr >> 2)) <= 1 AND abs((g >> 2) - (ng >> 2)) <= 1 AND abs((b >> 2) - (nb >> 2)) <= 1) AS same FROM pairs GROUP BY image_id", PX, PAIRS),
    "edge_weight_histogram": q("SELECT image_id, greatest(abs(r - nr), abs(g - ng), abs(b - nb)) AS weight, count(*) AS n FROM pairs GROUP BY ALL", PX, PAIRS),
    "boundary_pixels": q("SELECT m.image_id, m.x, m.y FROM mask m WHERE fg = 1 AND (SELECT count(*) FROM mask n WHERE n.image_id = m.image_id AND n.fg = 1 AND abs(n.x - m.x) + abs(n.y - m.y) = 1) < 4", PX, GREY, MASK),
    "mask_facts": q(
        "SELECT image_id, area, \"left\", top, \"right\", bottom, first_x, first_y, length FROM (SELECT image_id, count(*) AS area, min(x) AS \"left\", min(y) AS top, max(x) + 1 AS \"right\", max(y) + 1 AS bottom FROM mask WHERE fg = 1 GROUP BY image_id) JOIN (SELECT image_id, arg_min(x, y * 64 + x) AS first_x, arg_min(y, y * 64 + x) AS first_y, count(*) AS length FROM edge GROUP BY image_id) USING (image_id)",
        PX, GREY, MASK, "edge AS (SELECT m.image_id, m.x, m.y FROM mask m WHERE fg = 1 AND (SELECT count(*) FROM mask n WHERE n.image_id = m.image_id AND n.fg = 1 AND abs(n.x - m.x) + abs(n.y - m.y) = 1) < 4)",
    ),
    "mask_crop": q("SELECT m.image_id, m.x - l AS x, m.y - t AS y, fg FROM mask m JOIN (SELECT image_id, min(x) l, max(x) r, min(y) t, max(y) b FROM mask WHERE fg = 1 GROUP BY image_id) k ON m.image_id = k.image_id AND m.x BETWEEN l AND r AND m.y BETWEEN t AND b", PX, GREY, "mask AS (SELECT image_id, x, y, (v < 90)::INTEGER AS fg FROM gr)"),
    "mask_negative": q("SELECT image_id, x, y, 1 - fg AS fg FROM mask", PX, GREY, MASK),
    "mask_union": q("SELECT DISTINCT image_id, x, y FROM px WHERE (r + g + b) // 3 < 110 OR r < 90", PX),
    "hole_punch": q("SELECT image_id, x, y FROM px WHERE (r + g + b) // 3 < 110 AND NOT r < 90", PX),
    "mask_picture": q("SELECT image_id, string_agg(CASE WHEN fg = 1 THEN '*' ELSE '-' END || CASE WHEN x = 63 THEN chr(10) ELSE '' END, '' ORDER BY y, x) AS picture FROM mask GROUP BY image_id", PX, GREY, MASK),
    "mask_from_picture": q("SELECT * FROM mask", PX, GREY, MASK),
    "region_stats": q("SELECT * FROM stats", PX, LABELS, STATS),
    "region_adjacency": q("SELECT DISTINCT * FROM lpairs", PX, LABELS, LPAIRS),
    "region_adjacency_bag": q("SELECT image_id, a, b, count(*) AS n FROM lpairs GROUP BY ALL", PX, LABELS, LPAIRS),
    "nearest_neighbour_region": q(
        "SELECT image_id, region, arg_min(target, diff * 65535 + target) AS target, arg_min(diff, diff * 65535 + target) AS diff FROM (SELECT t.image_id, s.region, u.region AS target, abs(s.mean_r - u.mean_r) + abs(s.mean_g - u.mean_g) + abs(s.mean_b - u.mean_b) AS diff FROM (SELECT DISTINCT image_id, a, b FROM lpairs UNION SELECT DISTINCT image_id, b, a FROM lpairs) t JOIN stats s ON s.image_id = t.image_id AND s.region = t.a JOIN stats u ON u.image_id = t.image_id AND u.region = t.b) GROUP BY ALL",
        PX, LABELS, LPAIRS, STATS,
    ),
    "flatten_layers": q("SELECT image_id, x, y, CASE WHEN b < 100 THEN 3 WHEN g < 150 THEN 2 ELSE 1 END AS paint, CASE WHEN b < 100 THEN 2 WHEN g < 150 THEN 1 ELSE 0 END AS z FROM px WHERE b < 100 OR g < 150 OR r < 200", PX),
    "merge_adjacent_layers": q(
        "SELECT image_id, min(z) AS z, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b, any_value(a) AS a, count(*) AS layers, sum(area)::BIGINT AS area FROM runs GROUP BY image_id, run", PX,
        "lay AS (SELECT image_id, y AS z, floor(avg(r) / 16)::INTEGER * 16 AS r, floor(avg(g) / 16)::INTEGER * 16 AS g, floor(avg(b) / 16)::INTEGER * 16 AS b, 255 AS a, count(*) AS area FROM px GROUP BY image_id, y)",
        "fl AS (SELECT *, CASE WHEN lag((r, g, b, a)) OVER (PARTITION BY image_id ORDER BY z) = (r, g, b, a) THEN 0 ELSE 1 END AS turn FROM lay)",
        "runs AS (SELECT *, sum(turn) OVER (PARTITION BY image_id ORDER BY z) AS run FROM fl)",
    ),
    "oklab_convert": q(f"SELECT image_id, region, round({L}, 9) AS l, round({A}, 9) AS a, round({B}, 9) AS b FROM stats", PX, LABELS, STATS),
    "palette_snap": q(
        "SELECT image_id, region, arg_min(pr, i) AS pr, arg_min(pg, i) AS pg, arg_min(pb, i) AS pb FROM (SELECT *, rank() OVER (PARTITION BY image_id, region ORDER BY d) AS k FROM dist) WHERE k = 1 GROUP BY ALL",
        PX, LABELS, STATS, f"pal AS (SELECT * FROM (VALUES {', '.join(str((i, *p)) for i, p in enumerate(PALETTE))}) t(i, pr, pg, pb))",
        f"dist AS (SELECT image_id, region, i, pr, pg, pb, pow({L} - {PL}, 2) + pow({A} - {PA}, 2) + pow({B} - {PB}, 2) AS d FROM stats, pal)",
    ),
    "hex_format": q("SELECT image_id, region, printf('#%02X%02X%02X', mean_r, mean_g, mean_b) AS hex FROM stats", PX, LABELS, STATS),
    "lattice_nodes": q(
        "SELECT image_id, x, y, degree FROM (SELECT c.image_id, c.x, c.y, (a <> b)::INT + (b <> e)::INT + (e <> d)::INT + (d <> a)::INT AS degree FROM (SELECT c.image_id, c.x, c.y, coalesce(p.region, -1) a, coalesce(q.region, -1) b, coalesce(r.region, -1) d, coalesce(s.region, -1) e FROM c LEFT JOIN lab p ON p.image_id = c.image_id AND p.x = c.x - 1 AND p.y = c.y - 1 LEFT JOIN lab q ON q.image_id = c.image_id AND q.x = c.x AND q.y = c.y - 1 LEFT JOIN lab r ON r.image_id = c.image_id AND r.x = c.x - 1 AND r.y = c.y LEFT JOIN lab s ON s.image_id = c.image_id AND s.x = c.x AND s.y = c.y) c) WHERE degree >= 3",
        PX, LABELS, SIZES, "c AS (SELECT image_id, i::INTEGER AS x, j::INTEGER AS y FROM sizes, range(0, w + 1) t(i), range(0, h + 1) u(j))",
    ),
    "downsample_nn": q("SELECT image_id, x, y, r, g, b, a FROM smp", PX, SIZES, sampled_sql(SMALL_SIDE)),
    "connected_components": components_sql(0),
    "connected_components_diagonal": components_sql(1),
    "colour_histogram_topk": q("SELECT * FROM hist", PX, SIZES, SAMPLED, HIST),
    "luma_percentiles": q("SELECT * FROM pct", PX, SIZES, SAMPLED, PCT),
    "colourfulness": q("SELECT * FROM col", PX, SIZES, SAMPLED, COL),
    "sobel_laplacian": q("SELECT * FROM grad", PX, SIZES, SAMPLED, GRAD),
    "border_stddev": q("SELECT * FROM bord", PX, SIZES, SAMPLED, BORDER),
    "image_features": q("SELECT * FROM feat", ALL_FEAT),
    "class_scores": q("SELECT image_id, line_art, flat_art, photo FROM scored", ALL_FEAT, SCORES),
    "heuristic_decision": q(
        f"SELECT image_id, goal, class, confidence, {parameters('class')} FROM chosen", ALL_FEAT, SCORES, GOALS,
        "chosen AS (SELECT *, CASE WHEN line_art = best THEN 'line-art' WHEN flat_art = best THEN 'flat' ELSE 'photo' END AS class, least(0.95::DOUBLE, 0.55::DOUBLE + 0.4::DOUBLE * least(1, greatest(0, (best - second) / greatest(0.001::DOUBLE, abs(best))))) AS confidence FROM (SELECT *, greatest(line_art, flat_art, photo) AS best, line_art + flat_art + photo - greatest(line_art, flat_art, photo) - least(line_art, flat_art, photo) AS second FROM scored), goals)",
    ),
    "scan_detector": q(f"SELECT image_id, goal, {parameters('class')} FROM (SELECT *, 'line-art' AS class FROM feat, goals WHERE {GREYISH} AND dark_share + light_share > 0.7)", ALL_FEAT, GOALS),
    "candidate_menu": q(
        f"SELECT image_id, goal, substr('ABCDE', row_number() OVER (PARTITION BY image_id, goal ORDER BY o)::INTEGER, 1) AS letter, family, {parameters('family')} FROM (SELECT * FROM feat, goals, fam) WHERE CASE family WHEN 'line-illustration' THEN edge_density > 0.08 AND light_share > 0.45 AND colorfulness >= 14 WHEN 'gradient-illustration' THEN flat_share > 0.4 AND colorfulness > 20 AND noise_level < 2.5 WHEN 'pixel-icon' THEN megapixels <= 0.1 AND quantized_colors <= 32 ELSE true END",
        ALL_FEAT, GOALS, "fam AS (SELECT * FROM (VALUES (0, 'flat'), (1, 'line-illustration'), (2, 'gradient-illustration'), (3, 'photo'), (4, 'pixel-icon')) t(o, family))",
    ),
    "config_clamp": "SELECT event_id, least(128, greatest(0, (value * 3)::BIGINT - 40)) AS filter_speckle, least(8, greatest(1, event_id % 13 - 2)) AS color_precision, least(10.0::DOUBLE, greatest(3.5::DOUBLE, value)) AS segment_length, CASE WHEN event_id % 3 = 0 THEN NULL ELSE least(64, greatest(2, event_id % 100)) END AS max_colors FROM (SELECT event_id, floor(value) AS value FROM events)",
    "svg_number_format": "SELECT vec_id, i::INTEGER AS pos, CASE WHEN v = 0 THEN '0' ELSE regexp_replace(regexp_replace(regexp_replace(printf('%.2f', v), '0+$', ''), '\\.$', ''), '^(-?)0\\.', '\\1.') END AS num FROM (SELECT vec_id, i - 1 AS i, sign(e) * floor(abs(e) * 100 + 0.5) / 100 AS v FROM (SELECT vec_id, i, embedding[i]::DOUBLE * 4 AS e FROM embeddings, range(1, 65) t(i)))",
    "coordinate_quantise": "SELECT l_orderkey, l_linenumber, sign(l_extendedprice) * floor(abs(l_extendedprice) * 10 + 0.5) / 10 AS price FROM lineitem",
    "palette_parse": "SELECT p_partkey, i::INTEGER AS pos, token, CASE WHEN ok THEN ('0x' || substr(d, 1, 2))::INTEGER END AS r, CASE WHEN ok THEN ('0x' || substr(d, 3, 2))::INTEGER END AS g, CASE WHEN ok THEN ('0x' || substr(d, 5, 2))::INTEGER END AS b FROM (SELECT p_partkey, i - 1 AS i, token, regexp_full_match(token, '#?([0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})') AS ok, CASE WHEN length(ltrim(token, '#')) = 3 THEN regexp_replace(ltrim(token, '#'), '(.)', '\\1\\1', 'g') ELSE ltrim(token, '#') END AS d FROM (SELECT p_partkey, unnest([substr(m, 1, 6), '#' || substr(m, 7, 3), 'zz' || substr(m, 1, 2)]) AS token, unnest([1, 2, 3]) AS i FROM (SELECT p_partkey, md5(p_name) AS m FROM part)))",
    "human_bytes": "SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', floor(n / 1024::DOUBLE * 10 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(n / 1048576::DOUBLE * 10 + 0.5) / 10) || ' MB' END AS size FROM (SELECT o_orderkey, (floor(o_totalprice) * (o_orderkey % 40))::BIGINT AS n FROM orders)",
    "save_name": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'image' ELSE regexp_replace(event_type, '[\\\\/:*?\"<>|]', '_', 'g') END || '_' || strftime(ts, '%Y%m%d-%H%M%S') || '-traced.svg' AS name FROM events",
    "format_sniff": "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'GIF' WHEN 3 THEN 'WebP' WHEN 4 THEN 'BMP' ELSE 'Image' END AS format FROM supplier",
    "svg_output_facts": q("SELECT page_id, length(url)::INTEGER AS width, (page_id % 997)::INTEGER AS height, 2 AS shapes, 2 AS layers, length(svg)::INTEGER AS bytes FROM svg", SVG),
    "apply_key": q(
        "SELECT p.image_id, x, y, CASE WHEN a = 0 THEN k.r ELSE p.r END AS r, CASE WHEN a = 0 THEN k.g ELSE p.g END AS g, CASE WHEN a = 0 THEN k.b ELSE p.b END AS b, 255 AS a FROM px p JOIN (SELECT image_id, arg_min(r, o)::INTEGER AS r, arg_min(g, o)::INTEGER AS g, arg_min(b, o)::INTEGER AS b FROM free GROUP BY image_id) k USING (image_id)",
        PX, CAND, FREE,
    ),
    "progress_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, count(*) AS superseded FROM events GROUP BY user_id",
    "answer_parse": """SELECT conv_id, turn, 2 + (turn % 3)::INTEGER AS filter_speckle, CASE WHEN turn % 2 = 0 THEN 'binary' ELSE 'color-cluster' END AS clustering FROM conversations""",
}


# --- borders, trees and merging ------------------------------------------------------------------

# Unit steps between lattice corners, both ways: east 0, south 1, west 2, north 3; the region on the right of a step, outside -1.
STEPS = """vert AS (SELECT c.image_id, c.x, c.y, coalesce(p.region, -1) AS low, coalesce(q.region, -1) AS high FROM (SELECT image_id, i::INTEGER AS x, j::INTEGER AS y FROM sizes, range(0, w + 1) t(i), range(0, h) u(j)) c
  LEFT JOIN lab p ON p.image_id = c.image_id AND p.x = c.x - 1 AND p.y = c.y LEFT JOIN lab q ON q.image_id = c.image_id AND q.x = c.x AND q.y = c.y),
hori AS (SELECT c.image_id, c.x, c.y, coalesce(p.region, -1) AS low, coalesce(q.region, -1) AS high FROM (SELECT image_id, i::INTEGER AS x, j::INTEGER AS y FROM sizes, range(0, w) t(i), range(0, h + 1) u(j)) c
  LEFT JOIN lab p ON p.image_id = c.image_id AND p.x = c.x AND p.y = c.y - 1 LEFT JOIN lab q ON q.image_id = c.image_id AND q.x = c.x AND q.y = c.y),
bare AS (
  SELECT image_id, x, y, 1 AS d, x AS hx, y + 1 AS hy, low AS rt, high AS lf FROM vert WHERE low <> high UNION ALL SELECT image_id, x, y + 1, 3, x, y, high, low FROM vert WHERE low <> high
  UNION ALL SELECT image_id, x, y, 0, x + 1, y, high, low FROM hori WHERE low <> high UNION ALL SELECT image_id, x + 1, y, 2, x, y, low, high FROM hori WHERE low <> high),
steps AS (SELECT *, (y * 65536 + x) * 4 + d AS name, (hy * 65536 + hx) * 4 + (d + 2) % 4 AS back, count(*) OVER (PARTITION BY image_id, x, y) AS degree, count(*) OVER (PARTITION BY image_id, hx, hy) AS unused FROM bare)"""
# Borders from node to node, step by step; then rings, from every step that may be a ring's first.
BORDERS = STEPS + """,
ahead AS (SELECT s.image_id, s.name, n.name AS next, n.d <> s.d AS turned FROM steps s JOIN steps n ON n.image_id = s.image_id AND n.x = s.hx AND n.y = s.hy AND n.degree = 2 AND n.d <> (s.d + 2) % 4),
walk AS (
  SELECT image_id, name AS first, name, 1 AS n, 0 AS turns FROM steps WHERE degree >= 3
  UNION ALL SELECT w.image_id, w.first, a.next, w.n + 1, w.turns + a.turned::INTEGER FROM walk w JOIN ahead a ON a.image_id = w.image_id AND a.name = w.name),
ring AS (
  SELECT s.image_id, s.name AS first, s.name, 1 AS n, 0 AS turns FROM steps s WHERE s.d <= 1 AND NOT EXISTS (SELECT 1 FROM walk w WHERE w.image_id = s.image_id AND w.name = s.name)
  UNION ALL SELECT r.image_id, r.first, a.next, r.n + 1, r.turns + a.turned::INTEGER FROM ring r JOIN ahead a ON a.image_id = r.image_id AND a.name = r.name WHERE a.next > r.first),
closed AS (SELECT r.image_id, r.first FROM ring r JOIN ahead a ON a.image_id = r.image_id AND a.name = r.name AND a.next = r.first),
lines AS (SELECT *, false AS ring FROM walk UNION ALL SELECT r.*, true FROM ring r JOIN closed USING (image_id, first)),
whole AS (
  SELECT l.image_id, l.first, any_value(l.ring) AS ring, any_value(s.rt) AS rt, any_value(s.lf) AS lf, max(l.n) AS steps, max(l.turns) + 2 AS corners, sum(s.x * s.hy - s.hx * s.y)::BIGINT AS area2, CASE WHEN any_value(l.ring) THEN min(s.back) ELSE arg_max(s.back, l.n) END AS twin
  FROM lines l JOIN steps s ON s.image_id = l.image_id AND s.name = l.name GROUP BY l.image_id, l.first)"""
OUTLINES = STEPS + """,
follow AS (SELECT s.image_id, s.name, arg_min(n.name, CASE (n.d - s.d + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS next FROM steps s JOIN steps n ON n.image_id = s.image_id AND n.x = s.hx AND n.y = s.hy AND n.rt = s.rt AND n.d <> (s.d + 2) % 4 WHERE s.rt >= 0 GROUP BY ALL),
jump AS (
  SELECT 0 AS i, image_id, name, next AS ptr, name AS least FROM follow
  UNION ALL SELECT a.i + 1, a.image_id, a.name, b.ptr, least(a.least, b.least) FROM jump a JOIN jump b ON b.image_id = a.image_id AND b.name = a.ptr WHERE a.i < 14)"""
# Rounds in which every tree takes its least link; a tree's new root comes from jumps over what trees hooked to.
TREE = PAIRS.replace("p.*", "p.image_id, p.x, p.y, p.r, p.g, p.b, q.x AS qx, q.y AS qy") + """,
links AS (SELECT image_id, y * w + x AS p, qy * w + qx AS q, greatest(abs(r - nr), abs(g - ng), abs(b - nb)) AS weight, (y * w + x) * 2 + (qy > y)::INTEGER AS ident FROM pairs JOIN sizes USING (image_id)),
trees AS (
  SELECT 0 AS i, image_id, y * w + x AS node, y * w + x AS root, NULL::INTEGER AS weight FROM px JOIN sizes USING (image_id)
  UNION ALL
  SELECT i + 1, image_id, node, new_root, weight FROM (
    WITH cur AS (SELECT * FROM trees),
    ed AS (SELECT l.image_id, p.root AS a, q.root AS b, l.weight, l.ident FROM links l JOIN cur p ON p.image_id = l.image_id AND p.node = l.p JOIN cur q ON q.image_id = l.image_id AND q.node = l.q WHERE p.root <> q.root),
    best AS (SELECT image_id, a, arg_min(b, (weight, ident)) AS b, min(weight) AS weight FROM (SELECT * FROM ed UNION ALL SELECT image_id, b, a, weight, ident FROM ed) GROUP BY image_id, a),
    h0 AS (SELECT n.image_id, n.a, CASE WHEN m.b = n.a AND n.a < n.b THEN n.a ELSE n.b END AS p, n.weight FROM best n JOIN best m ON m.image_id = n.image_id AND m.a = n.b),
    """ + ",\n    ".join(f"h{k + 1} AS (SELECT f.image_id, f.a, g.p FROM h{k} f JOIN h{k} g ON g.image_id = f.image_id AND g.a = f.p)" for k in range(12)) + """
    SELECT c.i, c.image_id, c.node, h.p AS new_root, CASE WHEN c.node = c.root AND o.p <> o.a THEN o.weight END AS weight
    FROM cur c JOIN h12 h ON h.image_id = c.image_id AND h.a = c.root JOIN h0 o ON o.image_id = c.image_id AND o.a = c.root))"""
# Rounds of mutually nearest regions and those nearest to them; what a region holds is summed anew from the first regions in each round.
MERGE = """tile AS (SELECT image_id, (y // 4 * 16 + x // 4)::INTEGER AS region, x, y, r, g, b FROM px),
base AS (SELECT image_id, region, count(*) AS area, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb FROM tile GROUP BY ALL),
touch AS (SELECT p.image_id, p.region AS a, q.region AS b FROM tile p JOIN tile q ON p.image_id = q.image_id AND p.y = q.y AND q.x = p.x + 1 AND p.region <> q.region UNION SELECT p.image_id, p.region, q.region FROM tile p JOIN tile q ON p.image_id = q.image_id AND p.x = q.x AND q.y = p.y + 1 AND p.region <> q.region),
rounds AS (
  SELECT 0 AS i, image_id, region, region AS root, true AS moved FROM base
  UNION ALL
  SELECT i + 1, image_id, region, new_root, bool_or(new_root <> root) OVER () FROM (
    WITH cur AS (SELECT * FROM rounds),
    st AS (SELECT c.image_id, c.root, sum(sr) // sum(area) AS r, sum(sg) // sum(area) AS g, sum(sb) // sum(area) AS b FROM cur c JOIN base USING (image_id, region) GROUP BY ALL),
    ed AS (SELECT DISTINCT t.image_id, p.root AS a, q.root AS b FROM (SELECT * FROM touch UNION SELECT image_id, b, a FROM touch) t JOIN cur p ON p.image_id = t.image_id AND p.region = t.a JOIN cur q ON q.image_id = t.image_id AND q.region = t.b WHERE p.root <> q.root),
    far AS (SELECT e.image_id, e.a, e.b, abs(u.r - v.r) + abs(u.g - v.g) + abs(u.b - v.b) AS diff FROM ed e JOIN st u ON u.image_id = e.image_id AND u.root = e.a JOIN st v ON v.image_id = e.image_id AND v.root = e.b),
    near AS (SELECT image_id, a, arg_min(b, (diff, least(a, b), greatest(a, b))) AS b FROM far WHERE diff <= 16 GROUP BY ALL),
    pair AS (SELECT n.image_id, n.a, least(n.a, n.b) AS b FROM near n JOIN near m ON m.image_id = n.image_id AND m.a = n.b AND m.b = n.a),
    both_ AS (SELECT * FROM pair UNION ALL SELECT n.image_id, n.a, m.b FROM near n JOIN pair m ON m.image_id = n.image_id AND m.a = n.b WHERE NOT EXISTS (SELECT 1 FROM pair s WHERE s.image_id = n.image_id AND s.a = n.a))
    SELECT c.i, c.image_id, c.region, c.root, coalesce(m.b, c.root) AS new_root FROM cur c LEFT JOIN both_ m ON m.image_id = c.image_id AND m.a = c.root WHERE c.moved)),
final AS (SELECT image_id, region, root FROM rounds WHERE i = (SELECT max(i) FROM rounds)),
lab AS (SELECT image_id, x, y, dense_rank() OVER (PARTITION BY image_id ORDER BY first) - 1 AS region, r, g, b FROM (SELECT t.image_id, t.x, t.y, min(t.y * 65536 + t.x) OVER whole AS first, sum(t.r) OVER whole // count(*) OVER whole AS r, sum(t.g) OVER whole // count(*) OVER whole AS g, sum(t.b) OVER whole // count(*) OVER whole AS b FROM tile t JOIN final f USING (image_id, region) WINDOW whole AS (PARTITION BY t.image_id, f.root)))"""


def recursive(select: str, *parts: str) -> str:
    return q(select, *parts).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES |= {
    "border_steps": q('SELECT image_id, x, y, d, hx, hy, rt AS "right", lf AS "left" FROM bare', PX, LABELS, SIZES, STEPS),
    "border_lengths": recursive(
        "SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY ring, first) - 1 AS segment, rt AS region_right, nullif(lf, -1) AS region_left, steps, corners, area2 FROM whole WHERE CASE WHEN ring AND rt = -1 THEN false WHEN ring AND lf = -1 THEN true ELSE first < twin END",
        PX, LABELS, SIZES, BORDERS,
    ),
    "region_outlines": recursive(
        'SELECT s.image_id, s.rt AS region, min(s.x) AS "left", min(s.y) AS top, count(*) AS length, sum(s.x * s.hy - s.hx * s.y)::BIGINT AS area2 FROM jump j JOIN steps s ON s.image_id = j.image_id AND s.name = j.name WHERE j.i = 14 GROUP BY s.image_id, s.rt, j.least',
        PX, LABELS, SIZES, OUTLINES,
    ),
    "outline_raster": q("SELECT image_id, x, y, " + ", ".join(f"first_value({c}) OVER whole AS {c}" for c in "rgb") + " FROM lab WINDOW whole AS (PARTITION BY image_id, region ORDER BY y, x)", PX, LABELS),
    "watershed_mst_weights": recursive("SELECT image_id, weight, count(*) AS n FROM trees WHERE weight IS NOT NULL GROUP BY image_id, weight", PX, SIZES, TREE),
    "merge_tiles": recursive('SELECT image_id, region, area, sum_r, sum_g, sum_b, "left", top, "right", bottom, mean_r, mean_g, mean_b FROM stats', PX, MERGE, STATS),
}

MENU = f"menu AS ({ORACLES['candidate_menu']})"
TURNED = "shown AS (SELECT m.* EXCLUDE (letter), substr('ABCDE', (((ascii(letter) - 65 - (quantized_colors * 7 + w + h)) % n + n) % n)::INTEGER + 1, 1) AS letter FROM (SELECT *, count(*) OVER (PARTITION BY image_id, goal) AS n FROM menu) m JOIN (SELECT image_id, quantized_colors FROM hist) USING (image_id) JOIN sizes USING (image_id))"
DECIDED = f"decided AS ({ORACLES['heuristic_decision']})"
ORACLES |= {
    "rotated_menu": q("SELECT image_id, goal, letter, family FROM shown", MENU, PX, SIZES, SAMPLED, HIST, TURNED),
    "letter_choice": q(
        "SELECT i.image_id, i.goal, family, clustering, filter_speckle, layer_difference, CASE WHEN family IS NULL THEN 'not one of the letters shown:  c' END AS error FROM (SELECT DISTINCT image_id, goal FROM sizes, (VALUES ('faithful'), ('balanced'), ('compact')) g(goal)) i LEFT JOIN (SELECT * FROM shown WHERE letter = 'C') s ON s.image_id = i.image_id AND s.goal = i.goal",
        MENU, PX, SIZES, SAMPLED, HIST, TURNED,
    ),
    "decision_summary": q(
        "SELECT image_id, goal, 'clustering=' || clustering || ' hierarchical=' || hierarchical || ' fit=' || fit_mode || ' speckle=' || filter_speckle || ' precision=' || color_precision || ' gradient=' || layer_difference || ' max_colors=' || coalesce(max_colors::VARCHAR, 'null') || ' simplify=' || coalesce(simplify::VARCHAR, 'null') || ' confidence=' || printf('%.2f', confidence) AS line FROM decided",
        DECIDED,
    ),
}
