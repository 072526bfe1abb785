"""Parameters chosen by rules from image features: one row for each image and goal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GOALS = ("faithful", "balanced", "compact")

PARAMETERS = ["clustering", "hierarchical", "fit_mode", "filter_speckle", "color_precision", "layer_difference", "corner_threshold", "segment_length", "splice_threshold", "max_colors", "simplify", "binary_threshold", "binary_adaptive", "watershed_detail"]

# Fixed values: (least, most) of each parameter.
RANGES = {
    "filter_speckle": (0, 128), "color_precision": (1, 8), "layer_difference": (0, 255), "corner_threshold": (0, 180), "segment_length": (3.5, 10.0), "splice_threshold": (0, 180),
    "max_colors": (2, 64), "simplify": (0.1, 10.0), "binary_threshold": (0, 255), "watershed_detail": (16, 255), "confidence": (0.0, 1.0),
}
# What a profile has unless it says otherwise.
BASE = {
    "clustering": "color-cluster", "hierarchical": "stacked", "fit_mode": "spline", "color_precision": 8, "corner_threshold": 60, "segment_length": 4.0, "splice_threshold": 45,
    "max_colors": None, "simplify": None, "binary_threshold": 128, "binary_adaptive": False, "watershed_detail": 128,
}
KINDS = {"max_colors": "int", "simplify": "double"}

c = F.col


def by_goal(faithful, balanced, compact) -> Column:
    """A value for each goal; plain values or columns."""
    return F.when(c("goal") == "faithful", faithful).when(c("goal") == "balanced", balanced).otherwise(compact)


def whole(x: Column, low: int, high: int) -> Column:
    """Rounded half up, within bounds."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(x + 0.5).cast("int")))


def is_greyish() -> Column:
    return c("colorfulness") < 14.0


def is_flat_palette() -> Column:
    return (c("palette_share_top8") >= 0.80) & (c("quantized_colors") <= 64)


def is_photo_like() -> Column:
    return (c("quantized_colors") > 96) & (c("palette_share_top8") < 0.55) & (c("noise_level") > 1.5)


def profiles() -> dict[str, dict[str, object]]:
    """What each profile sets, given the features and the goal of a row."""
    none = F.lit(None)
    mosaic = (c("flat_share") > 0.55) & (c("palette_share_top8") > 0.75)
    two_toned = c("dark_share") + c("light_share") > 0.55
    gradient = c("mean_gradient")
    return {
        "line-art": {
            "clustering": "binary", "filter_speckle": by_goal(1, 3, 3), "layer_difference": 16, "simplify": by_goal(none, none, 1.0),
            "binary_threshold": F.when(two_toned, 128).otherwise(160), "binary_adaptive": ~two_toned | (c("background_uniformity") > 12),
        },
        "flat": {
            "hierarchical": F.when(mosaic, "cutout").otherwise("stacked"), "filter_speckle": by_goal(2, 4, 4), "color_precision": F.when(c("quantized_colors") > 24, 8).otherwise(6),
            "layer_difference": by_goal(12, F.when(c("palette_share_top8") > 0.9, 16).otherwise(24), 28), "max_colors": by_goal(none, none, 16), "simplify": by_goal(none, none, 1.2),
        },
        "line-illustration": {"filter_speckle": by_goal(1, 2, 2), "layer_difference": by_goal(12, 12, 20), "simplify": by_goal(none, none, 1.0)},
        "gradient-illustration": {"filter_speckle": by_goal(4, 6, 8), "layer_difference": by_goal(24, 32, 40), "corner_threshold": 120, "simplify": by_goal(none, 1.0, 1.0)},
        "photo": {
            "filter_speckle": by_goal(2, whole(c("noise_level") / 4, 4, 12), 12),
            "layer_difference": by_goal(whole(gradient * 1.5, 24, 40), whole(gradient * 2, 32, 64), whole(gradient * 2.5, 48, 96)),
            "corner_threshold": 180, "max_colors": by_goal(none, none, 24), "simplify": by_goal(none, 1.0, 2.0),
        },
        "pixel-icon": {"fit_mode": "pixel", "filter_speckle": 1, "layer_difference": 16},
    }


#: Families of the menu in order, and when one is offered.
def feasible() -> dict[str, Column]:
    return {
        "flat": F.lit(True),
        "line-illustration": (c("edge_density") > 0.08) & (c("light_share") > 0.45) & (c("colorfulness") >= 14),
        "gradient-illustration": (c("flat_share") > 0.4) & (c("colorfulness") > 20) & (c("noise_level") < 2.5),
        "photo": F.lit(True),
        "pixel-icon": (c("megapixels") <= 0.1) & (c("quantized_colors") <= 32),
    }


def with_goals(features: DataFrame) -> DataFrame:
    """Each row once for each goal."""
    return features.withColumn("goal", F.explode(F.array(*[F.lit(g) for g in GOALS])))


def column_of(value: object, name: str) -> Column:
    out = value if isinstance(value, Column) else F.lit(value)
    return out.cast(KINDS[name]) if name in KINDS else out


def with_profile(rows: DataFrame, chosen: str) -> DataFrame:
    """``rows`` with the parameters of the profile that column ``chosen`` names."""
    made = profiles()
    columns = {}
    for p in PARAMETERS:
        value = None
        for name, sets in made.items():
            own = column_of(sets.get(p, BASE.get(p)), p)
            value = F.when(c(chosen) == name, own) if value is None else value.when(c(chosen) == name, own)
        columns[p] = value
    return rows.withColumns(columns)


def class_scores(features: DataFrame) -> DataFrame:
    """``features`` with the scores of line art, flat art and photo."""

    def score(*terms: tuple[Column, float, float]) -> Column:
        values = [F.when(hit, yes).otherwise(no) for hit, yes, no in terms]
        total = values[0]
        for v in values[1:]:
            total = total + v
        return total

    share, colours, noise = c("palette_share_top8"), c("quantized_colors"), c("noise_level")
    return features.withColumns({
        "line_art": score((is_greyish(), 1.0, 0.15), (share > 0.85, 1.0, 0.3), (colours <= 24, 1.0, 0.2), (c("dark_share") + c("light_share") > 0.6, 1.0, 0.2), (noise < 2.0, 0.8, 0.1)),
        "flat_art": score((share > 0.75, 1.0, 0.2), (colours <= 96, 1.0, 0.2), (c("flat_share") > 0.5, 1.0, 0.3), (noise < 2.5, 1.0, 0.2), (is_greyish(), 0.3, 1.0)),
        "photo": score((colours > 96, 1.0, 0.15), (share < 0.55, 1.0, 0.2), (noise > 1.5, 1.0, 0.2), (is_greyish(), 0.2, 1.0), (c("mean_gradient") > 12, 0.8, 0.3)),
    })


def clamped(decisions: DataFrame) -> DataFrame:
    """Every parameter within its range; nulls stay."""
    return decisions.withColumns({p: F.when(c(p).isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c(p)))) for p, (low, high) in RANGES.items() if p in decisions.columns})


def heuristic_decision(features: DataFrame) -> DataFrame:
    """(image_id, goal, class, confidence, parameters...): the class of the best score, first in order of equals."""
    s = with_goals(class_scores(features))
    best = F.greatest("line_art", "flat_art", "photo")
    second = F.sort_array(F.array("line_art", "flat_art", "photo"), False)[1]
    s = s.withColumn("class", F.when(c("line_art") == best, "line-art").when(c("flat_art") == best, "flat").otherwise("photo"))
    margin = (best - second) / F.greatest(F.lit(0.001), F.abs(best))
    s = s.withColumn("confidence", F.least(F.lit(0.95), 0.55 + 0.4 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), margin))))
    return clamped(with_profile(s, "class")).select("image_id", "goal", "class", "confidence", *PARAMETERS)


def candidates(features: DataFrame) -> DataFrame:
    """The menu: (image_id, goal, letter, family, parameters...) of each family that is feasible, lettered in order."""
    offered = F.filter(F.array(*[F.when(ok, F.lit(name)) for name, ok in feasible().items()]), lambda f: f.isNotNull())
    menu = with_goals(features).select("*", F.posexplode(offered).alias("at", "family"))
    return with_profile(menu, "family").select("image_id", "goal", F.substring(F.lit("ABCDE"), c("at") + 1, F.lit(1)).alias("letter"), "family", *PARAMETERS)


def scan_direct(features: DataFrame) -> DataFrame:
    """Line-art parameters for images that are nearly grey and mostly dark or light; other images have no row."""
    scans = with_goals(features.filter(is_greyish() & (c("dark_share") + c("light_share") > 0.7)))
    return with_profile(scans.withColumn("class", F.lit("line-art")), "class").select("image_id", "goal", *PARAMETERS)


# --- answers of an injected model ------------------------------------------------------------

def answer_fields(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Parameters that a model's answer names, from any of its envelopes: bare arguments, a call, or the first of several.

    A text without a readable object, or one that reports failure, has nulls.
    """
    body = F.try_parse_json(F.regexp_extract(column, r"(?s)\{.*\}", 0))
    rows = answers.withColumn("_v", body)
    failed = F.coalesce(F.try_variant_get("_v", "$.success", "boolean") == F.lit(False), F.lit(False))

    def field(name: str) -> Column:
        paths = [f"$.function_calls[0].arguments.{name}", f"$.arguments.{name}", f"$.{name}"]
        return F.when(~failed, F.coalesce(*[F.try_variant_get("_v", p, "string") for p in paths]))

    return rows.withColumns({f"answer_{p}": field(p) for p in PARAMETERS}).drop("_v")


def merged_answer(decisions: DataFrame) -> DataFrame:
    """The rules' parameters with an answer's valid fields in their place; ``repaired`` where a field is missing or out of range."""
    out, flawed = {}, F.lit(False)
    words = {"clustering": ("color-cluster", "binary", "watershed"), "hierarchical": ("stacked", "cutout"), "fit_mode": ("pixel", "polygon", "spline")}
    for p in PARAMETERS:
        given = c(f"answer_{p}")
        kind = decisions.schema[p].dataType.simpleString()
        value = given if p in words else given.try_cast("double").cast(kind) if kind in ("int", "bigint") else given.try_cast(kind)
        if p in words:
            value = F.when(F.lower(value).isin(*words[p]), F.lower(value))
        elif p in RANGES:
            low, high = RANGES[p]
            flawed = flawed | F.coalesce((value < low) | (value > high), F.lit(False))
            value = F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)).cast(kind))
        if p not in ("max_colors", "simplify"):
            flawed = flawed | value.isNull()
        out[p] = F.coalesce(value, c(p))
    return decisions.withColumn("repaired", flawed).withColumns(out).drop(*[f"answer_{p}" for p in PARAMETERS])


# --- choosing by letter, and decisions as texts ------------------------------------------------


def presented(menu: DataFrame, features: DataFrame) -> DataFrame:
    """The menu as a model sees it: letters stay, and what they stand for is turned by an offset that the image's features fix.

    So a model that leans to one letter does not lean to one family.
    """
    offset = features.select("image_id", (c("quantized_colors") * 7 + c("width") + c("height")).alias("turn"))
    at = F.ascii("letter") - F.ascii(F.lit("A"))
    own = [x for x in menu.columns if x not in ("image_id", "goal", "letter")]
    counted = menu.withColumns({"at": at, "n": F.count("*").over(Window.partitionBy("image_id", "goal"))}).join(offset, "image_id")
    turned = counted.withColumn("place", F.pmod(c("at") - c("turn"), c("n")).cast("int"))
    return turned.select("image_id", "goal", F.substring(F.lit("ABCDE"), c("place") + 1, F.lit(1)).alias("letter"), *own)


def chosen_by_letter(shown: DataFrame, answers: DataFrame) -> DataFrame:
    """(image_id, goal, choice, family, parameters..., error) of answers(image_id, goal, choice) over a menu as it was shown.

    Blanks and case of a choice do not count; one that is none of the letters
    shown has null parameters and an error.
    """
    said = answers.select("image_id", "goal", "choice", F.upper(F.regexp_replace("choice", r"^\s+|\s+$", "")).alias("letter"))
    found = said.join(shown, ["image_id", "goal", "letter"], "left")
    error = F.when(c("family").isNull(), F.concat(F.lit("not one of the letters shown: "), F.coalesce("choice", F.lit("(missing)"))))
    return found.select("image_id", "goal", "choice", "family", *PARAMETERS, error.alias("error"))


def kept_binary(decisions: DataFrame, features: DataFrame) -> DataFrame:
    """Decisions with the line-art profile in place of those that would leave black and white, for users who asked for it."""
    art = with_profile(with_goals(features).withColumn("class", F.lit("line-art")), "class").select("image_id", "goal", F.struct(*PARAMETERS).alias("art"))
    joined = decisions.join(art, ["image_id", "goal"])
    leaves = c("clustering") != "binary"
    return joined.withColumns({p: F.when(leaves, c("art")[p]).otherwise(c(p)) for p in PARAMETERS}).drop("art")


def summary() -> Column:
    """A decision in one line."""
    named = {"clustering": "clustering", "hierarchical": "hierarchical", "fit": "fit_mode", "speckle": "filter_speckle", "precision": "color_precision", "gradient": "layer_difference", "max_colors": "max_colors", "simplify": "simplify"}
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(c(p).cast("string"), F.lit("null"))) for k, p in named.items()]
    return F.concat_ws(" ", *parts, F.concat(F.lit("confidence="), F.format_string("%.2f", c("confidence"))))


JSON_FIELDS = [*PARAMETERS, "rationale", "confidence", "source", "goal"]


def as_json(decisions: DataFrame) -> DataFrame:
    """(image_id, goal, json) of decisions; rationale and source are null where there is no such column, and nulls are written."""
    fields = [c(f) if f in decisions.columns else F.lit(None).cast("string").alias(f) for f in JSON_FIELDS]
    return decisions.select("image_id", "goal", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def from_json(texts: DataFrame, like: DataFrame) -> DataFrame:
    """Decisions back from (image_id, json), with the types of ``like``; a text that is no object has nulls."""
    kinds = {f.name: f.dataType.simpleString() for f in like.schema.fields}
    schema = ", ".join(f"{f} {kinds.get(f, 'string')}" for f in JSON_FIELDS)
    return texts.select("image_id", F.from_json("json", schema).alias("d")).select("image_id", "d.*")
