"""Verdicts to scores: strict, threshold and average pass rates, means over tracks, differences of models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verdicts(results: DataFrame) -> DataFrame:
    """(image_filename, mode, category, answer) of each verdict; results without any give none."""
    return results.select("image_filename", "mode", F.explode("evaluation.evaluation_results").alias("v")).where("v is not null").select(
        "image_filename", "mode", "v.category", "v.answer"
    )


def sample_scores(rows: DataFrame, by: Sequence[str] = ("mode", "category", "image_filename"), errors: str = "fail") -> DataFrame:
    """(by, strict, rate): whether every question of the sample is answered Yes, and the share that is.

    An answer counts as Yes without regard to case and blanks. A null answer fails, or with ``errors='exclude'`` is
    left out. Only samples that have the category are scored.
    """
    if errors == "exclude":
        rows = rows.where("answer is not null")
    yes = F.coalesce(F.lower(F.trim("answer")) == "yes", F.lit(False))
    return rows.groupBy(*by).agg(F.bool_and(yes).alias("strict"), F.avg(yes.cast("double")).alias("rate"))


def _per_cent(c) -> object:  # noqa: ANN001
    return F.round(100.0 * F.avg(c), 6)


def accuracy(scored: DataFrame, by: Sequence[str], threshold: float = 0.8, samples: DataFrame | None = None) -> DataFrame:
    """(by, n, strict, at_threshold, average) in per cent over the samples of each group.

    With ``samples``, distinct samples with the columns of ``by`` but ``category``, every sample counts and one
    without questions in a category passes it vacuously: the literal formula.
    """
    if samples is not None:
        every = scored.agg(F.collect_set("category")).scalar()  # a handful of categories
        pairs = samples.select("*", F.explode(every).alias("category"))
        keys = [c for c in scored.columns if c not in ("strict", "rate")]
        scored = pairs.join(scored, keys, "left").withColumns({"strict": F.coalesce("strict", F.lit(True)), "rate": F.coalesce("rate", F.lit(1.0))})
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), _per_cent(F.col("strict").cast("double")).alias("strict"),
        _per_cent((F.col("rate") >= threshold).cast("double")).alias("at_threshold"), _per_cent(F.col("rate")).alias("average"),
    )


def by_mode_and_pooled(scored: DataFrame) -> DataFrame:
    """(category, mode, strict): of each mode and, with mode ``Avg``, of both together, in one pass."""
    rows = scored.select("category", F.coalesce("mode", F.lit("unknown")).alias("mode"), F.col("strict").cast("double").alias("s"))
    sets = rows.groupingSets([["category", "mode"], ["category"]], "category", "mode")
    mean = F.round(100.0 * F.avg("s"), 6).alias("strict")
    return sets.agg(mean).select("category", F.coalesce("mode", F.lit("Avg")).alias("mode"), "strict")


def final_score(scored: DataFrame, tracks: Sequence[str] = ("EntityStructure", "ScientificLaw", "ScientificProcess", "Text")) -> DataFrame:
    """Unweighted mean of the pooled strict accuracies of the tracks, from unrounded values."""
    per = scored.where(F.col("category").isin(*tracks)).groupBy("category").agg(F.avg(F.col("strict").cast("double")).alias("a"))
    return per.agg(F.round(100.0 * F.avg("a"), 6).alias("final"))


def score_delta(accuracies: DataFrame, by: Sequence[str], model: str, a: str, b: str, score: str = "strict") -> DataFrame:
    """(by, delta): score of ``a`` less that of ``b`` where both have one."""
    wide = accuracies.groupBy(*by).agg(F.max(F.when(F.col(model) == a, F.col(score))).alias("_a"), F.max(F.when(F.col(model) == b, F.col(score))).alias("_b"))
    return wide.where("_a is not null and _b is not null").select(*by, F.round(F.col("_a") - F.col("_b"), 6).alias("delta"))


def rank_models(accuracies: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Place of each row in its group, best first; equal scores share a place. Groups hold one row per model."""
    from pyspark.sql import Window

    return accuracies.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(F.col(score).desc())).cast("int"))
