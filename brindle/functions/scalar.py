"""Scalar rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types by ending.
MEDIA_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp", ".heic": "image/heic", ".pdf": "application/pdf", ".json": "application/json", ".html": "text/html"}


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def media_type(path: Column) -> Column:
    e = ending(path)
    return F.coalesce(*(F.when(e == k, F.lit(v)) for k, v in MEDIA_TYPES.items()), F.lit("application/octet-stream"))


def safe_name(name: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r"[\\/]", "_")), F.lit("")), F.lit(default))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s-]+", "_")


def provider(name: Column) -> Column:
    n = F.lower(F.trim(name))
    return F.when(n == "gpt", "openai").when(n == "google", "gemini").otherwise(n)


def backoff_ms(failures: Column) -> Column:
    """Wait before a reconnect, without its random part of up to 500 ms."""
    return F.least(F.lit(30000.0), 1000 * F.pow(F.lit(2.0), F.least(failures, F.lit(5)))).cast("long")


def millimetres_to_pixels(mm: Column, dpi: int = 300) -> Column:
    return F.bround(mm / 25.4 * dpi).cast("long")


def millimetres_per_pixel(width: Column, height: Column, page_w: float = 210.0, page_h: float = 297.0, margin: float = 10.0, dpi: int = 300) -> Column:
    inner_w, inner_h = (round((x - 2 * margin) / 25.4 * dpi) for x in (page_w, page_h))
    return F.least(F.lit(float(inner_w)) / width, F.lit(float(inner_h)) / height) * 25.4 / dpi


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def int_setting(text: Column, default: int, low: int, high: int) -> Column:
    return F.least(F.greatest(F.coalesce(text.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def cover_crop(width: Column, height: Column, ratio: float) -> Column:
    """Centred box of the largest size with this ratio: struct(x, y, w, h)."""
    wide = width > height * ratio
    w = F.when(wide, F.bround(height * ratio)).otherwise(width).cast("long")
    h = F.when(wide, height).otherwise(F.bround(width / ratio)).cast("long")
    return F.struct(F.floor((width - w) / 2).alias("x"), F.floor((height - h) / 2).alias("y"), w.alias("w"), h.alias("h"))


def crop_is_normal(x: Column, y: Column, w: Column, h: Column) -> Column:
    return (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1.000001) & (y + h <= 1.000001)


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """Message of the first rule that fails, null where all hold."""
    return F.coalesce(*(F.when(~ok, F.lit(message)) for ok, message in rules))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("long"), 16).bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(b.cast("long"))


def label_colour(label: Column) -> list[Column]:
    return [(label * m % 255).cast("int") for m in (37, 91, 151)]


def label_height_mm(room: Column) -> Column:
    """Largest of 4, 3, 2, 1 mm that fits; null where none does."""
    return F.coalesce(*(F.when(room >= h, F.lit(h)) for h in (4, 3, 2, 1)))


def range_text(values: Column) -> Column:
    """"low-high", or one number, of an array."""
    low, high = F.array_min(values), F.array_max(values)
    return F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low, high))


def fold(items: Column, zero: Column, step) -> Column:
    return F.aggregate(items, zero, step)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
