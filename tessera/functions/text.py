"""Text functions over columns: numbers in paths, names, sizes, formats, palettes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_away(v: Column, digits: int) -> Column:
    """Half away from zero, by multiply and floor."""
    k = float(10**digits)
    return F.signum(v) * F.floor(F.abs(v) * k + 0.5) / k


def path_number(v: Column, digits: int) -> Column:
    """A coordinate as paths write it: rounded, without trailing zeros, leading zero or minus zero."""
    r = rounded_away(v, digits)
    text = F.format_string(f"%.{digits}f", r)
    text = F.regexp_replace(F.when(F.lit(digits) > 0, F.regexp_replace(text, r"0+$", "")).otherwise(text), r"\.$", "")
    return F.when(r == 0, "0").otherwise(F.regexp_replace(text, r"^(-?)0\.", "$1."))


def joined_numbers(texts: Column) -> Column:
    """Comma between two numbers unless the next begins with a minus."""
    return F.regexp_replace(F.array_join(texts, ","), ",-", "-")


def human_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", rounded_away(n / 1024, 1)), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", rounded_away(n / (1024 * 1024), 1)), F.lit(" MB")))
    )


def image_format(content: Column) -> Column:
    """The container format by the file's first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    # First bytes of image files.
    return (
        F.when(head.startswith("89504E") & (F.octet_length(content) >= 8), "PNG")
        .when(head.startswith("FFD8FF"), "JPEG")
        .when(head.startswith("474946") & (F.octet_length(content) >= 4), "GIF")
        .when(head.startswith("52494646") & (F.substring(head, 17, 4) == "5745") & (F.octet_length(content) >= 12), "WebP")
        .when(head.startswith("424D"), "BMP")
        .otherwise("Image")
    )


def palette_tokens(text: Column) -> Column:
    """The tokens of a palette text."""
    return F.filter(F.split(text, r"[,\s]+", -1), lambda t: t != "")


def hex_channels(token: Column) -> Column:
    """[r, g, b] of #rrggbb, rrggbb or #rgb; null for anything else."""
    digits = F.regexp_replace(token, "^#", "")
    long = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    values = F.array(*[F.conv(F.substring(long, k, 2), 16, 10).cast("int") for k in (1, 3, 5)])
    return F.when(token.rlike("^#?([0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})$"), values)


def save_name(source: Column, when: Column) -> Column:
    """<base>_<time>-traced.svg, with what file systems dislike replaced."""
    base = F.regexp_replace(F.coalesce(source, F.lit("")), r"(?s)^(.+)\.[^.]*$", "$1")
    base = F.when(F.trim(base) == "", "image").otherwise(F.regexp_replace(base, r'[\\/:*?"<>|\x00-\x1f]', "_"))
    return F.concat(base, F.lit("_"), F.date_format(when, "yyyyMMdd-HHmmss"), F.lit("-traced.svg"))


def svg_facts(svg: Column) -> list[Column]:
    """Width, height, paths, distinct fills and length of an SVG text."""
    dims = r'width="(\d+)"[^>]*?height="(\d+)"'
    return [
        F.regexp_extract(svg, dims, 1).cast("int").alias("width"),
        F.regexp_extract(svg, dims, 2).cast("int").alias("height"),
        F.regexp_count(svg, F.lit("<path")).alias("shapes"),
        F.size(F.array_distinct(F.regexp_extract_all(svg, F.lit(r'fill="([^"]+)"'), F.lit(1)))).alias("layers"),
        F.length(svg).alias("bytes"),
    ]
