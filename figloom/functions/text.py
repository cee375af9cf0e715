"""Scalar functions over names and paths, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.when(c != "", c)


def basename(c: Column) -> Column:
    """Last part of a path; an empty string for a null or empty one."""
    return F.coalesce(F.element_at(F.split(c, "/"), -1), F.lit(""))


def stem(c: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def join_path(folder: str, c: Column) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), c)


def mime_type(c: Column) -> Column:
    """Guess by extension; ``image/png`` where it says nothing."""
    ext = F.lower(F.regexp_extract(c, r"\.([^.]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg", "jpe"), "image/jpeg").when(ext == "gif", "image/gif").when(ext == "webp", "image/webp").when(ext == "bmp", "image/bmp").when(ext.isin("tif", "tiff"), "image/tiff").otherwise("image/png")


def data_url(content: Column, path: Column) -> Column:
    """Bytes as a data URL; the built-in base64 breaks lines, which a URL must not."""
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def back_off(attempt: Column, base: float = 2.0) -> Column:
    """Seconds to wait after a failed attempt, numbered from 0."""
    return F.lit(base) * F.pow(F.lit(2.0), attempt)


def fit_size(width: Column, height: Column, max_pixels: int = 1_048_576, multiple: int = 16) -> Column:
    """Size with at most ``max_pixels``, both sides rounded down to a multiple, as struct(width, height)."""
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(max_pixels)) / (width * height)))
    return F.struct(
        (F.floor(width * scale / multiple) * multiple).cast("int").alias("width"), (F.floor(height * scale / multiple) * multiple).cast("int").alias("height")
    )
