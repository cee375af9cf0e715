"""Samples and splits that are the same on every run: all order rows by a hash of their id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(c: Column, seed: str = "") -> Column:
    return F.md5(F.concat(F.lit(seed), c.cast("string")))


def spot_check(rows: DataFrame, key: str, share: float = 0.1, seed: str = "") -> DataFrame:
    """About ``share`` of the rows; no exchange, any row can be tested alone."""
    return rows.where(F.substring(hash_order(F.col(key), seed), 1, 8) < f"{int(share * 0x100000000):08x}")


def quota(rows: DataFrame, by: Sequence[str], key: str, n: int, seed: str = "") -> DataFrame:
    """At most ``n`` rows of each group, those first in hash order.

    Groups are first thinned in hash buckets, ``n`` rows of each bucket at most, so a hot group is cut down in many
    tasks before its few rows meet.
    """
    h = hash_order(F.col(key), seed)
    part = rows.withColumn("_h", h).withColumn("_b", F.substring("_h", -2, 2))
    inner = Window.partitionBy(*by, "_b").orderBy("_h", key)
    thin = part.withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= n)
    outer = Window.partitionBy(*by).orderBy("_h", key)
    return thin.withColumn("_r", F.row_number().over(outer)).where(F.col("_r") <= n).drop("_h", "_b", "_r")


BUCKET_DIGITS = 4


def deal(rows: DataFrame, key: str, hands: int, total: int | None = None, seed: str = "") -> DataFrame:
    """Column ``hand`` from 1: rows dealt evenly to raters in hash order, ``total`` of them at most.

    Rows are numbered in buckets of the first digits of the hash, from the counts of the buckets before: at most
    16 ** BUCKET_DIGITS counts meet in one task, whatever the rows.
    """
    picked = quota(rows.withColumn("_g", F.lit(1)), ["_g"], key, total, seed).drop("_g") if total is not None else rows
    hashed = picked.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", F.coalesce(F.substring("_h", 1, BUCKET_DIGITS), F.lit("")))
    counts = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    numbered = hashed.withColumn("_r", inside).join(before, "_b")
    return numbered.select(*picked.columns, (F.pmod(F.col("_before") + F.col("_r") - 1, F.lit(hands)) + 1).cast("int").alias("hand"))


def head_split(rows: DataFrame, position: str, n: int = 50) -> DataFrame:
    """Column ``part``: ``test`` for the first ``n`` positions, counted from 0, ``train`` for the rest."""
    return rows.withColumn("part", F.when(F.col(position) < n, "test").otherwise("train"))


def repeat(rows: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, with its number from 0; no exchange."""
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("repeat"))
