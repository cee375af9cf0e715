"""Articles and their segments: attach, explode, resolve names, replace nested fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figloom.functions.text import basename, filled, join_path
from figloom.schemas import SEGMENT


def collect_segments(segments: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, segments): the rows of each key as one array in the given order."""
    rest = [c for c in segments.columns if c != key]
    packed = F.struct(*order, *[c for c in rest if c not in order])
    arranged = F.array_sort(F.collect_list(packed))
    return segments.groupBy(key).agg(F.transform(arranged, lambda s: F.struct(*[s[c].alias(c) for c in rest])).alias("segments"))


def attach_segments(articles: DataFrame, arrays: DataFrame, key: str) -> DataFrame:
    """Articles with ``segments`` replaced; an unknown or null key gets an empty array, no article is lost."""
    bare = articles.drop("segments").join(arrays, key, "left")
    kind = arrays.schema["segments"].dataType
    return bare.withColumn("segments", F.coalesce("segments", F.array().cast(kind)))


def explode_tasks(articles: DataFrame, image_dir: str | None = None, row_key: str | None = None) -> DataFrame:
    """One task per segment: the columns of ``articles`` but ``segments``, and place, filename, labels, path, task_key.

    Without segments an article stands for its own image (``local_path``, else ``image_path``) with no labels;
    with neither it is dropped. Null elements give no task and keep their place. The key of a task is its path, else its
    file name, else, with ``row_key``, ``<row>#<place>``.
    """
    own = F.coalesce(filled(F.col("local_path")), filled(F.col("image_path")))
    fallback = F.when(
        own.isNotNull(),
        F.array(
            F.struct(
                basename(own).alias("filename"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
                F.array().cast("array<string>").alias("labels"), own.alias("path"),
            ).cast(SEGMENT)
        ),
    )
    listed = F.when(F.coalesce(F.size("segments"), F.lit(0)) > 0, F.col("segments").cast(f"array<{SEGMENT}>")).otherwise(fallback)
    rows = articles.withColumn("_s", listed).select(*[c for c in articles.columns if c != "segments"], F.posexplode("_s").alias("place", "seg"))
    rows = rows.where("seg is not null")
    name = F.coalesce(filled(F.col("seg.filename")), filled(basename(F.col("seg.path"))))
    path = F.col("seg.path") if image_dir is None else F.coalesce(join_path(image_dir, name), F.col("seg.path"))
    rows = rows.withColumns({"filename": name, "labels": F.col("seg.labels"), "path": path}).drop("seg")
    last = [F.concat(F.col(row_key).cast("string"), F.lit("#"), F.col("place").cast("string"))] if row_key else []
    return rows.withColumn("task_key", F.coalesce(filled(F.col("path")), filled(F.col("filename")), *last))


def per_label(tasks: DataFrame) -> DataFrame:
    """A task per label it carries (column ``label``), for pipelines that serve one track; repeats count once."""
    return tasks.select("*", F.explode(F.array_distinct("labels")).alias("label")).where("label is not null")


def explode_for_matching(articles: DataFrame) -> DataFrame:
    """Segments with their place; articles without segments give none."""
    return articles.select("*", F.posexplode("segments").alias("place", "segment")).where("segment is not null")


def replace_labels(articles: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Articles whose segments carry the labels of ``results`` (filename, labels); others keep their own.

    ``results`` is joined on the file name, exploded once and gathered again in place; an article without segments
    is left as it is.
    """
    flat = articles.select(key, F.posexplode("segments").alias("place", "s")).withColumn("_f", F.col("s.filename"))
    named = results.select(F.col("filename").alias("_f"), F.col("labels").alias("_l"))
    put = F.when(F.col("_l").isNotNull(), F.col("s").withField("labels", F.col("_l"))).otherwise(F.col("s"))
    new = flat.join(named, "_f", "left").select(key, "place", put.alias("s"))
    gathered = new.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda x: x["s"]).alias("_new"))
    return articles.join(gathered, key, "left").withColumn("segments", F.coalesce("_new", "segments")).drop("_new")


def set_segment_size(segments: Column, side: int = 1024) -> Column:
    """Every segment with the size of the standard canvas; null and empty arrays stay."""
    return F.transform(segments, lambda s: F.when(s.isNotNull(), s.withField("width", F.lit(side)).withField("height", F.lit(side))))


def drop_named(segments: Column, missing: Column) -> Column:
    """Segments but for those named in the array ``missing``; a segment without a name stays."""
    return F.filter(segments, lambda s: ~F.coalesce(F.array_contains(missing, s["filename"]), F.lit(False)))


def _one_of_each(df: DataFrame, key: Sequence[str], order: Sequence[str], pick) -> DataFrame:  # noqa: ANN001
    """One row of each key by an aggregate that combines on the map side, so a hot key is cut down before any exchange."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    row = pick(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(f"`{c}`") for c in order]))
    one = df.groupBy(*[F.col(f"`{c}`") for c in key]).agg(row.alias("_row"))
    return one.select(*[F.col(f"`{c}`") if c in key else F.col("_row").getField(c).alias(c) for c in df.columns])


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, nulls ordered first; null is a key like any other."""
    return _one_of_each(df, key, order, F.max_by)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, nulls ordered first; null is a key like any other."""
    return _one_of_each(df, key, order, F.min_by)
