"""Benchmark selection: match captions, derive labels, group, percentile bands, median split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figloom.functions.text import basename, filled
from figloom.operators.segments import keep_first, keep_last
from figloom.schemas import TRACKS
from figloom.session import durable


def _items(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def term_count(reasoning: Column) -> Column:
    """Terms of the three tracks together; null and missing ones are 0."""
    return sum((_items(F.try_element_at(reasoning, F.lit(t))["terms"]) for t in TRACKS), F.lit(0))


def null_out_empty(reasoning: Column) -> Column:
    """The key of a track with neither terms nor visualization stays, its value becomes null; other keys are untouched."""
    return F.transform_values(
        reasoning,
        lambda k, v: F.when(~(k.isin(*TRACKS) & v.isNotNull() & (_items(v["terms"]) == 0) & (_items(v["visualization"]) == 0)), v),
    )


def content_labels(reasoning: Column, require_visualization: bool = False) -> Column:
    """Tracks with terms (and, on demand, visualization), in alphabetical order; null reasoning has none."""

    def holds(k: Column, v: Column) -> Column:
        full = _items(v["terms"]) > 0
        if require_visualization:
            full = full & (_items(v["visualization"]) > 0)
        return k.isin(*TRACKS) & F.coalesce(full, F.lit(False))

    return F.coalesce(F.array_sort(F.map_keys(F.map_filter(reasoning, holds))), F.array().cast("array<string>"))


def group_name(labels: Column) -> Column:
    """Two labels joined by ``_``, three are ``All_Three``, else null."""
    return F.when(F.size(labels) == 2, F.array_join(labels, "_")).when(F.size(labels) == 3, "All_Three")


def match_captions(segments: DataFrame, captions: DataFrame, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Segments (filename, path) with the caption of their file name or, failing that, of their path's base name.

    Of captions with one base name the last counts. Two equi-joins on the same side, no ``or`` in a condition.
    """
    right = keep_last(captions.withColumn("_key", basename(F.col("image_path"))), ["_key"], order).where("_key <> ''")
    cols = [c for c in captions.columns if c not in segments.columns]
    packed = right.select("_key", F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_c"))
    first = segments.withColumn("_k1", filled(F.col("filename"))).withColumn("_k2", filled(basename(F.col("path"))))
    both = (
        first.join(packed.select(F.col("_key").alias("_k1"), F.col("_c").alias("_c1")), "_k1", "left")
        .join(packed.select(F.col("_key").alias("_k2"), F.col("_c").alias("_c2")), "_k2", "left")
        .withColumn("_c", F.coalesce("_c1", "_c2")).where("_c is not null")
    )
    return both.select(*segments.columns, *[F.col("_c").getField(c).alias(c) for c in cols])


def candidates(matched: DataFrame, order: Sequence[str]) -> DataFrame:
    """First match of each file name (nulls are one name), labelled, grouped, with the lengths selection works on."""
    once = keep_first(matched, ["filename"], order)
    labels = content_labels(F.col("reasoning"))
    rows = once.withColumn("labels", labels).withColumn("group_name", group_name(F.col("labels"))).where("group_name is not null")
    return rows.withColumns({
        "term_count": term_count(F.col("reasoning")), "rendered_len": _items(F.col("rendered_text_stage2")), "retained_len": _items(F.col("retained_text_stage3")),
    })


def _quantiles(rows: DataFrame, group: str, value: str, at: Sequence[float]) -> DataFrame:
    """(group, _q) from the frequencies of the distinct values of each group, kept: a row per group."""
    freq = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    return durable(freq.groupBy(group).agg(F.percentile(value, F.array(*map(F.lit, at)), F.col("_n")).alias("_q")), "quantiles")


def iqr_band(rows: DataFrame, group: str, value: str, slack: float = 1.0) -> DataFrame:
    """Rows whose value lies within the group's quartiles widened by ``slack``; null values are outside.

    The quartiles are taken at once, so a band adds to the plan a join with a row per group and not its input again.
    """
    q = _quantiles(rows, group, value, (0.25, 0.75))
    v = F.col(value).cast("double")
    return rows.join(q, group).where((v >= F.col("_q")[0] - slack) & (v <= F.col("_q")[1] + slack)).drop("_q")


CHAIN = ("term_count", "rendered_len", "retained_len")


def iqr_chain(rows: DataFrame, group: str = "group_name", values: Sequence[str] = CHAIN, slack: float = 1.0) -> DataFrame:
    """One band after the other, quartiles taken of what the band before left. ``rows`` are kept and made once."""
    rows = durable(rows, "candidates")
    for v in values:
        rows = iqr_band(rows, group, v, slack)
    return rows


def median_split(rows: DataFrame, group: str = "group_name", value: str = "term_count") -> DataFrame:
    """Column ``half``: ``prompt`` below the group's median, ``CoT`` at or above it."""
    m = _quantiles(rows, group, value, (0.5,))
    return rows.join(m, group).withColumn("half", F.when(F.col(value) < F.col("_q")[0], "prompt").otherwise("CoT")).drop("_q")


def more_terms(rows: DataFrame, least: int = 3) -> DataFrame:
    """The documented, optional filter: more than ``least`` terms."""
    return rows.where(F.col("term_count") > least)


def stage_counts(rows: DataFrame, group: str = "group_name", values: Sequence[str] = CHAIN) -> DataFrame:
    """(stage, group, n): rows before the bands and after each; a row is counted at every stage it reaches, in one pass."""
    rows = durable(rows.select(group, *values), "candidates")
    kept, reached = rows, []
    for v in values:
        q = _quantiles(kept, group, v, (0.25, 0.75))
        reached.append(q.withColumnRenamed("_q", f"_q_{v}"))
        kept = kept.join(q, group).where((F.col(v) >= F.col("_q")[0] - 1) & (F.col(v) <= F.col("_q")[1] + 1)).drop("_q")
    stages = [F.lit(0)]
    inside = F.lit(True)
    for i, (v, q) in enumerate(zip(values, reached), 1):
        rows = rows.join(q, group, "left")
        inside = inside & F.coalesce((F.col(v) >= F.col(f"_q_{v}")[0] - 1) & (F.col(v) <= F.col(f"_q_{v}")[1] + 1), F.lit(False))
        stages.append(F.when(inside, F.lit(i)))
    each = rows.select(group, F.explode(F.filter(F.array(*stages), lambda x: x.isNotNull())).alias("stage"))
    return each.groupBy("stage", group).agg(F.count("*").alias("n")).select("stage", group, "n")


def present(rows: DataFrame, listing: DataFrame, name: str = "image_filename") -> DataFrame:
    """Rows whose file is listed (name); a row without a name stays, the split is not taken again."""
    flag = listing.select(F.col("name").alias(name)).distinct().withColumn("_there", F.lit(True))
    return rows.join(flag, name, "left").where(F.col("_there") | F.col(name).isNull() | (F.col(name) == "")).drop("_there")


def missing_names(rows: DataFrame, listing: DataFrame, name: str = "image_filename") -> DataFrame:
    """Distinct names (name) that are not listed."""
    wanted = rows.select(F.col(name).alias("name")).where("name is not null and name <> ''")
    return wanted.join(listing.select("name"), "name", "left_anti").distinct()


def without_missing(captions: DataFrame, missing: DataFrame) -> DataFrame:
    """Captions but for those of missing images."""
    return captions.withColumn("name", basename(F.col("image_path"))).join(missing, "name", "left_anti").drop("name")


def segments_without_missing(articles: DataFrame, missing: DataFrame, key: str) -> DataFrame:
    """Articles whose segments of missing images are gone; an article keeps its array when that empties it."""
    flat = articles.select(key, F.explode(F.array_distinct(F.transform("segments", lambda s: s["filename"]))).alias("name"))
    gone = flat.join(missing, "name").groupBy(key).agg(F.collect_set("name").alias("_gone"))
    kept = F.filter("segments", lambda s: ~F.coalesce(F.array_contains(F.col("_gone"), s["filename"]), F.lit(False)))
    return articles.join(gone, key, "left").withColumn("segments", F.when(F.col("_gone").isNull(), F.col("segments")).otherwise(kept)).drop("_gone")
