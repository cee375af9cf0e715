"""Cutoff keeping a target fraction of each source's records.

Scores are first counted per source and distinct value, on the map side; the descending cumulative sums and the
choice of the cutoff then run over those compact frequencies, never over records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_set(labels: Column) -> Column:
    """Names in alphabetical order joined by ``+``; order, repeats, null and blank elements ignored; null if none."""
    kept = F.array_sort(F.array_distinct(F.filter(F.transform(labels, F.trim), lambda x: x.isNotNull() & (x != ""))))
    return F.when(F.size(kept) > 0, F.array_join(kept, "+"))


def scored(candidates: DataFrame) -> DataFrame:
    """(candidate_id, label_set, term_count) of the records that count, each once."""
    return (
        candidates.where("term_count is not null")
        .select("candidate_id", label_set(F.col("labels")).alias("label_set"), "term_count")
        .where("label_set is not null").distinct()
    )


def cutoffs(records: DataFrame, targets: DataFrame, group: str = "label_set", score: str = "term_count") -> DataFrame:
    """(group, target_pct, cutoff, n_records, n_kept, kept_pct), one row for every target with records.

    The cutoff is the largest score that at least ``target_pct`` per cent of the group's records reach; ties at the
    cutoff are kept. Targets of 0 or less still keep the records with the highest score, targets above 100 keep
    none and give no row. Groups without target give no row.
    """
    freq = records.groupBy(group, score).agg(F.count("*").alias("n"))
    down = Window.partitionBy(group).orderBy(F.col(score).desc())
    cum = freq.select(
        group, score, F.sum("n").over(down).alias("n_kept"), F.sum("n").over(Window.partitionBy(group)).alias("n_records")
    )
    fits = cum.join(targets, group).where(F.col("n_kept") * 100 >= F.col("target_pct") * F.col("n_records"))
    best = fits.groupBy(group).agg(
        F.max_by(F.struct("target_pct", score, "n_records", "n_kept"), score).alias("x")
    )
    return best.select(
        group, F.col("x.target_pct").alias("target_pct"), F.col(f"x.{score}").alias("cutoff"),
        F.col("x.n_records").alias("n_records"), F.col("x.n_kept").alias("n_kept"),
        F.round(F.col("x.n_kept") * 100.0 / F.col("x.n_records"), 4).alias("kept_pct"),
    )


def kept(records: DataFrame, chosen: DataFrame, group: str = "label_set", score: str = "term_count") -> DataFrame:
    """Records at or above the cutoff of their group."""
    return records.join(chosen.select(group, "cutoff"), group).where(F.col(score) >= F.col("cutoff"))
