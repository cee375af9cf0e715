"""Relevance scores to labels, and label statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figloom.schemas import DIMENSIONS


def score_labels(relevance: Column, threshold: float = 7, dims: Sequence[str] = DIMENSIONS) -> Column:
    """Dimensions with a score of at least the threshold, in fixed order; a missing score is 0."""
    return F.filter(
        F.array(*[F.when(F.coalesce(F.try_element_at(relevance, F.lit(d))["score"], F.lit(0.0)) >= threshold, F.lit(d)) for d in dims]), lambda x: x.isNotNull()
    )


def _by_set(results: DataFrame) -> DataFrame:
    """(labels, n, _total) of each distinct label array, null and empty ones included: few rows, so the total is summed
    over them and the results are read once."""
    sets = results.groupBy("labels").agg(F.count("*").alias("n"))
    return sets.withColumn("_total", F.sum("n").over(Window.partitionBy()))


def label_counts(results: DataFrame) -> DataFrame:
    """(label, n, share): per cent of all results, those without labels included."""
    n = _by_set(results).select(F.explode("labels").alias("label"), "n", "_total").groupBy("label").agg(F.sum("n").alias("n"), F.max("_total").alias("_total"))
    return n.select("label", "n", _share(F.col("_total")).alias("share"))


def combination_counts(results: DataFrame, top: int | None = 10) -> DataFrame:
    """(combination, n, share) of the label sets that are not empty, most frequent first, names breaking ties."""
    named = _by_set(results).where(F.size("labels") > 0).select(F.array_join(F.array_sort("labels"), " + ").alias("combination"), "n", "_total")
    n = named.groupBy("combination").agg(F.sum("n").alias("n"), F.max("_total").alias("_total")).select("combination", "n", _share(F.col("_total")).alias("share"))
    return n if top is None else n.orderBy(F.desc("n"), "combination").limit(top)


def without_labels(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.size("labels") == 0).alias("n"), F.count("*").alias("total")).select("n", "total", _share(F.col("total")).alias("share"))


def _share(total: Column) -> Column:
    return F.round(100.0 * F.col("n") / F.greatest(F.lit(1), total), 6)


def union_fresh(fresh: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Fresh results, and cached ones where there is no fresh one, stale files included."""
    return fresh.unionByName(cache.join(fresh.select(key), key, "left_anti"))


def drop_low_reasoning(rows: DataFrame) -> DataFrame:
    """Rows with at least one label; for the training export only."""
    return rows.where(F.coalesce(F.size("labels"), F.lit(0)) > 0)
