"""Rules for requests to other services, as column expressions: crops, prompts, errors, public ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.scalar import crop_is_normal

#: Digits of public ids.
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def explicit_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, ratio: float, tolerance: float = 0.015) -> Column:
    """Pixels of a crop given in parts of the image: struct(left, top, right, bottom, failure); no box where failure tells why.

    A missing edge means the image's own.
    """
    x, y = (F.coalesce(c, F.lit(0.0)) for c in (x, y))
    w, h = (F.coalesce(c, F.lit(1.0)) for c in (w, h))
    edges = {"left": x * width, "top": y * height, "right": (x + w) * width, "bottom": (y + h) * height}
    box = {k: F.bround(v).cast("long") for k, v in edges.items()}
    shape = (box["right"] - box["left"]) / F.greatest(F.lit(1), box["bottom"] - box["top"])
    failure = F.when(~crop_is_normal(x, y, w, h), "outside the image").when(F.abs(shape - ratio) / ratio > tolerance, "another shape")
    return F.struct(*(F.when(failure.isNull(), v).alias(k) for k, v in box.items()), failure.alias("failure"))


def rescaled(edge: Column, asked: Column, got: Column) -> Column:
    """An edge of a box, in pixels of an image that came in another size than asked for."""
    return F.bround(edge * (got / asked)).cast("long")


def listed(items: Column, default: str) -> Column:
    """Items by commas, or a default where there are none."""
    return F.coalesce(F.nullif(F.array_join(items, ", "), F.lit("")), F.lit(default))


def section(title: str, text: Column) -> Column:
    """A titled section after an empty line; nothing where the text is blank."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "").otherwise(F.concat(F.lit(f"\n\n{title}:\n"), F.trim(text)))


def error_detail(status: Column, body: Column) -> Column:
    """What an answer says about an error: struct(message, type, code, request_id, stage, categories, retryable).

    The body may be JSON with an ``error`` that is an object or a text, or plain text. Of moderation only
    the stage and the names of categories are taken. Values of another type than text count as missing.
    """
    v = F.try_parse_json(body)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    text = lambda path: F.when(F.schema_of_variant(get(path, "variant")) == "STRING", get(path, "string"))
    said = F.when(v.isNull(), body).otherwise(F.coalesce(text("$.error.message"), text("$.error")))
    code = text("$.error.code")
    names = F.filter(get("$.error.moderation_details.categories", "array<variant>"), lambda c: F.schema_of_variant(c) == "STRING")
    names = F.filter(F.transform(names, lambda c: F.try_variant_get(c, "$", "string")), lambda c: c != "")
    return F.struct(
        F.coalesce(F.nullif(said, F.lit("")), F.concat(F.lit("HTTP "), status.cast("string"))).alias("message"),
        text("$.error.type").alias("type"),
        code.alias("code"),
        F.coalesce(text("$.error.request_id"), text("$.request_id")).alias("request_id"),
        F.nullif(text("$.error.moderation_details.moderation_stage"), F.lit("")).alias("stage"),
        F.nullif(F.array_join(names, ","), F.lit("")).alias("categories"),
        (~code.eqNullSafe("moderation_blocked")).alias("retryable"),
    )


def public_id(n: int) -> Column:
    """A random id of n lower-case base-32 digits, 8 at least; another one for each row and each run."""
    return F.concat(*(F.substr(F.lit(BASE32), (F.rand() * 32).cast("int") + 1, F.lit(1)) for _ in range(max(n, 8))))
