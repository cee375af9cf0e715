"""Correlation, frequency and audit statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figloom.session import durable


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r); r is null where a side is constant."""
    both = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    return both.agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 8).alias("r"))


def _mean_ranks(rows: DataFrame, c: str) -> DataFrame:
    """(value, rank): mean rank of each distinct value.

    Distinct values are range-partitioned and kept; a running sum inside each part and the sums of the parts before it
    give the rank, so no task sees more than its part, also where every value is distinct.
    """
    freq = rows.groupBy(F.col(c).alias(c)).agg(F.count("*").alias("_n"))
    parts = durable(freq.repartitionByRange(F.col(c)).withColumn("_p", F.spark_partition_id()), "ranks")
    sums = parts.groupBy("_p").agg(F.sum("_n").alias("_s"))  # a row per part
    offsets = sums.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy("_p").orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    return parts.withColumn("_inside", inside).join(offsets, "_p").select(c, (F.col("_before") + F.col("_inside") + (F.col("_n") + 1) / 2.0).alias(f"_rank_{c}"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho) over mean ranks of ties. Ranks come from the distinct values, so ratings of any number are cheap."""
    both = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    ranked = both.join(_mean_ranks(both, "x"), "x").join(_mean_ranks(both, "y"), "y")
    return ranked.agg(F.count("*").alias("n"), F.round(F.corr("_rank_x", "_rank_y"), 8).alias("rho"))


def _kendall_b(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float | None:
    """tau-b from distinct pairs and their counts: one ordered sweep with a Fenwick tree over the ranks of y."""
    ranks = np.unique(y, return_inverse=True)[1] + 1
    size = int(ranks.max()) if len(ranks) else 0
    tree = [0] * (size + 1)

    def add(i: int, v: int) -> None:
        while i <= size:
            tree[i] += v
            i += i & -i

    def upto(i: int) -> int:
        s = 0
        while i > 0:
            s += tree[i]
            i -= i & -i
        return s

    order = np.lexsort((y, x))
    total, score, seen, at = int(n.sum()), 0, 0, 0
    while at < len(order):
        end = at
        while end < len(order) and x[order[end]] == x[order[at]]:
            i = order[end]
            below = upto(int(ranks[i]) - 1)
            score += int(n[i]) * (below - (seen - upto(int(ranks[i]))))
            end += 1
        for i in order[at:end]:
            add(int(ranks[i]), int(n[i]))
            seen += int(n[i])
        at = end
    pairs = total * (total - 1) // 2

    def tied(v: np.ndarray) -> int:
        c = np.bincount(np.unique(v, return_inverse=True)[1], weights=n).astype(np.int64)
        return int((c * (c - 1) // 2).sum())

    base = (pairs - tied(x)) * (pairs - tied(y))
    return score / math.sqrt(base) if base > 0 else None


#: Distinct pairs that Kendall's sweep takes in one task, at most.
MOST_PAIRS = 2_000_000


def kendall(rows: DataFrame, x: str, y: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(n, tau): tau-b. Equal pairs are counted first; ratings and rates take few values, so few pairs are swept.

    More than ``most_pairs`` distinct pairs are an error and not a sample: round continuous values before.
    """
    both = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    compact = durable(both.groupBy("x", "y").agg(F.count("*").alias("c")).withColumn("one", F.lit(1)), "pairs")
    if (found := compact.count()) > most_pairs:
        raise ValueError(f"{found} distinct pairs are more than {most_pairs}; round the values")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        tau = _kendall_b(p["x"].to_numpy(), p["y"].to_numpy(), p["c"].to_numpy())
        return pd.DataFrame({"n": [int(p["c"].sum())], "tau": [None if tau is None else round(tau, 8)]})

    return compact.groupBy("one").applyInPandas(run, "n long, tau double")


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def t_test_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a Pearson or Spearman coefficient under Student's t with n - 2 degrees of freedom."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r  # df / (df + t * t)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if 0 < x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * _betacf(a, b, x) / a)
    return min(1.0, 1 - front * _betacf(b, a, 1 - x) / b)


def kendall_p(tau: float | None, n: int) -> float | None:
    """Two-sided p of tau by the normal approximation."""
    if tau is None or n < 2:
        return None
    z = 3 * tau * math.sqrt(n * (n - 1)) / math.sqrt(2 * (2 * n + 5))
    return math.erfc(abs(z) / math.sqrt(2))


def rater_consensus(ratings: DataFrame, item: str = "image_id", score: str = "score") -> DataFrame:
    """(item, consensus, n_raters): mean rating of each item."""
    return ratings.groupBy(item).agg(F.round(F.avg(score), 6).alias("consensus"), F.count(score).alias("n_raters"))


def length_stats(rows: DataFrame, group: str, long: str, short: str, population: bool = False) -> DataFrame:
    """(group, n, mean and deviation of both lengths, ratio of the means)."""
    dev = F.stddev_pop if population else F.stddev_samp
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.round(F.avg(long), 6).alias("mean_long"), F.round(dev(long), 6).alias("std_long"),
        F.round(F.avg(short), 6).alias("mean_short"), F.round(dev(short), 6).alias("std_short"), F.round(F.avg(long) / F.avg(short), 6).alias("ratio"),
    )


def shares(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, share) in per cent of all rows."""
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"))  # compact, so its sum is taken over it
    return counted.select(*by, "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def false_positive_gate(reviews: DataFrame, batch: str, flag: str, gate: float = 0.05) -> DataFrame:
    """(batch, n, rate) of the batches whose rate of false positives exceeds the gate."""
    r = reviews.groupBy(batch).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("rate"))
    return r.where(F.col("rate") > gate).select(batch, "n", F.round("rate", 6).alias("rate"))


def audit_rates(audit: DataFrame, task: str, outcome: str, outcomes: Sequence[str] = ("pass", "minor", "major")) -> DataFrame:
    """(task, one column per outcome) in per cent, cut after one decimal."""
    return audit.groupBy(task).agg(*[F.round(F.floor(1000.0 * F.count_if(F.col(outcome) == o) / F.count("*")) / 10.0, 1).alias(o) for o in outcomes])
