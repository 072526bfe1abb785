"""Settings of a vectorisation and the plan they make."""

from __future__ import annotations

from dataclasses import astuple, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import clusters, mosaic, palettes, paths, pixels, regions, watershed

# Other spellings of a choice.
ALIASES = {
    "clustering": {"color": "color-cluster", "colorcluster": "color-cluster", "color-cluster": "color-cluster", "bw": "binary", "BW": "binary", "binary": "binary", "watershed": "watershed"},
    "hierarchical": {"stacked": "stacked", "cutout": "cutout"},
    "mode": {"pixel": "pixel", "none": "pixel", "polygon": "polygon", "spline": "spline"},
}
# Fixed values: (least, most).
BOUNDS = {"filter_speckle": (0, 128), "color_precision": (1, 8), "layer_difference": (0, 255), "corner_threshold": (0, 180), "length_threshold": (3.5, 10.0), "splice_threshold": (0, 180), "path_precision": (0, 20), "optimize": (0, 2), "binary_threshold": (0, 255)}


@dataclass(frozen=True)
class Settings:
    """One vectorisation's settings; values outside their bounds are refused."""

    clustering: str = "color-cluster"
    hierarchical: str = "stacked"
    filter_speckle: int = 4
    color_precision: int = 6
    layer_difference: int = 16
    mode: str = "spline"
    corner_threshold: int = 60
    length_threshold: float = 4.0
    splice_threshold: int = 45
    simplify: float | None = None
    path_precision: int = 2
    palette: tuple[tuple[int, int, int], ...] = field(default=())
    max_colors: int | None = None
    optimize: int = 1
    binary_threshold: int = 128
    binary_adaptive: bool = False
    binary_window: int = 0
    binary_percent: float = 15.0
    watershed_detail: int = 128

    def __post_init__(self) -> None:
        for name, words in ALIASES.items():
            if getattr(self, name) not in words:
                raise ValueError(f"{name}: {getattr(self, name)!r} is none of {sorted(words)}")
            object.__setattr__(self, name, words[getattr(self, name)])
        for name, (low, high) in BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name}: {getattr(self, name)} is not within {low} and {high}")

    @property
    def segment_key(self) -> tuple:
        """What a segmentation depends on; other settings only change how it is drawn."""
        drawn = {"hierarchical": "stacked", "mode": "pixel", "corner_threshold": 0, "length_threshold": 4.0, "splice_threshold": 0, "simplify": None, "path_precision": 2, "palette": (), "max_colors": None, "optimize": 1}
        return astuple(replace(self, **drawn))


# What each preset changes.
PRESETS = {
    "bw": Settings(clustering="binary"),
    "poster": Settings(color_precision=8),
    "photo": Settings(filter_speckle=10, color_precision=8, layer_difference=48, corner_threshold=180),
}


def segmented(px: DataFrame, s: Settings) -> DataFrame:
    """Layers of pixels(image_id, x, y, r, g, b, a), bottom first."""
    if s.clustering == "binary":
        mask = pixels.adaptive_threshold(px, s.binary_window, s.binary_percent) if s.binary_adaptive else pixels.fixed_threshold(px, s.binary_threshold)
        return clusters.binary_layers(mask, s.filter_speckle)
    if s.clustering == "watershed":
        return watershed.watershed_layers(px, s.watershed_detail, s.filter_speckle**2)
    return clusters.colour_layers(clusters.with_keyed(px), s.color_precision, s.layer_difference, s.filter_speckle)


def painted(layers: DataFrame, s: Settings) -> DataFrame:
    """Layers in the palette's colours, or in few of their own, where that is asked for."""
    if s.palette:
        snapped = regions.snapped(layers, list(s.palette)).select("image_id", "z", *[F.col(f"p{c}").alias(c) for c in "rgb"], "cells")
        return palettes.joined_neighbours(snapped)
    if s.max_colors:
        return palettes.joined_neighbours(palettes.quantised_layers(layers, s.max_colors))
    return layers


def drawn(layers: DataFrame, px: DataFrame, s: Settings) -> DataFrame:
    """(image_id, svg): layers stacked, or cut out as a flat partition."""
    curve = {"corner": s.corner_threshold, "length": s.length_threshold, "splice": s.splice_threshold, "simplify": s.simplify or 0.0}
    if s.hierarchical == "cutout":
        most = max(2, (255 - s.watershed_detail) // 8) if s.clustering == "watershed" else s.layer_difference
        return mosaic.cutout(painted(layers, s), pixels.sizes(px), s.mode, most, s.optimize, s.path_precision, **curve)
    return paths.vectorised(painted(layers, s), pixels.sizes(px), s.mode, s.optimize, s.path_precision, **curve)


def vectorise(px: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(image_id, svg) of a table of pixels."""
    s = settings or Settings()
    return drawn(segmented(px, s), px, s)


class Session:
    """Draws one table of images again and again; a segmentation is kept until a setting that it depends on changes."""

    def __init__(self, px: DataFrame):
        self.px, self.key, self.layers = px, None, None
        self.made = 0

    def render(self, s: Settings) -> DataFrame:
        if s.segment_key != self.key or self.layers is None:
            self.close()
            self.layers, self.key = segmented(self.px, s).persist(), s.segment_key
            self.made += 1
        return drawn(self.layers, self.px, s)

    def close(self) -> None:
        if self.layers is not None:
            self.layers.unpersist()
        self.layers = self.key = None
