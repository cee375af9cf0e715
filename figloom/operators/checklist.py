"""Prompts by mode, active tracks, requests for checklists and verdicts, routing of errors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figloom.functions.text import basename, filled
from figloom.operators.segments import keep_last

MODES = ("cot", "abstract")


def canonical_name(image_filename: Column, image_path: Column) -> Column:
    """One name for the join key, whichever of the two columns a file has."""
    return F.coalesce(filled(image_filename), filled(basename(image_path)))


def active_tracks(reasoning: Column) -> Column:
    """Keys with a value that is not null, any key; sorted, as a map promises no order."""
    return F.coalesce(F.array_sort(F.map_keys(F.map_filter(reasoning, lambda k, v: v.isNotNull()))), F.array().cast("array<string>"))


def tracks_text(tracks: Column) -> Column:
    return F.when(F.size(tracks) > 0, F.array_join(tracks, ", ")).otherwise("General")


def prompt_of(mode: Column, long: Column, short: Column, strict: bool = False) -> Column:
    """Text of the mode; another mode is an error where ``strict``, else it takes the long text."""
    other = F.raise_error(F.concat(F.lit("unknown mode "), F.coalesce(mode, F.lit("null")))).cast("string") if strict else long
    return F.when(mode == "abstract", short).when(mode == "cot", long).otherwise(other)


def json_text(value: Column, ascii_only: bool = False) -> Column:
    """JSON of a nested value with null fields kept; with ``ascii_only`` other signs are escaped as requests of checklists
    and verdicts write them."""
    text = F.to_json(value, {"ignoreNullFields": "false"})
    if not ascii_only:
        return text
    units = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))), lambda i: F.hex(F.substring(F.encode(text, "UTF-16BE"), (2 * i - 1).cast("int"), F.lit(2))))
    escaped = F.array_join(F.transform(units, lambda u: F.when(F.conv(u, 16, 10).cast("int") > 126, F.concat(F.lit("\\u"), F.lower(u))).otherwise(F.char(F.conv(u, 16, 10).cast("int")))), "")
    return F.when(text.rlike(r"[^\x00-\x7e]"), escaped).otherwise(text)


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """struct(text, error): ``{name}`` replaced by the field as it is, nothing escaped; a null field is an error that names
    it, so the row is told apart and not asked about."""
    parts = [F.lit(x) if i % 2 == 0 else F.coalesce(fields[x].cast("string"), F.lit("")) for i, x in enumerate(re.split(r"\{(\w+)\}", template))]
    used = list(dict.fromkeys(re.findall(r"\{(\w+)\}", template)))
    error = F.coalesce(*[F.when(fields[x].isNull(), F.lit(f"missing {x}")) for x in used], F.lit(None).cast("string"))
    return F.struct(F.when(error.isNull(), F.concat(*parts)).alias("text"), error.alias("error"))


def checklist_request(prompt: Column, tracks: Column, reasoning: Column) -> Column:
    return F.concat(
        F.lit("Prompt: "), F.coalesce(prompt, F.lit("")), F.lit("\nTracks: "), tracks_text(tracks), F.lit("\nReasoning: "), F.coalesce(F.to_json(reasoning), F.lit("{}"))
    )


def judge_requests(items: DataFrame, prompts: DataFrame, images: DataFrame, order: str) -> DataFrame:
    """Items (image_filename, mode) with ``prompt`` and ``error``, none dropped.

    ``prompts`` (image_filename, long, short, and ``order``): the last of a name counts. ``images`` (name) is the
    listing. A missing image goes before a missing prompt; an empty prompt is a missing one.
    """
    last = keep_last(prompts.where("image_filename is not null"), ["image_filename"], [order]).select("image_filename", "long", "short")
    there = images.select(F.col("name").alias("image_filename"), F.lit(True).alias("_there")).distinct()
    rows = items.join(last, "image_filename", "left").join(there, "image_filename", "left")
    prompt = filled(prompt_of(F.col("mode"), F.col("long"), F.col("short")))
    error = F.when(F.col("_there").isNull(), "Image file not found").when(prompt.isNull(), "Prompt not found")
    return rows.withColumns({"prompt": prompt, "error": error}).drop("long", "short", "_there")
