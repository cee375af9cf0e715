"""Queries of correlations, frequencies, audits and samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figloom.operators import sampling, select, stats
from figloom.session import table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("candidate_id", "rendered_len", F.col("retained_len"), "term_count").distinct()


def pearson(spark: SparkSession, d: str) -> DataFrame:
    return stats.pearson(_pairs(spark, d), "term_count", "rendered_len")


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(_pairs(spark, d), "term_count", "rendered_len")


def kendall(spark: SparkSession, d: str) -> DataFrame:
    return stats.kendall(_pairs(spark, d), "rendered_len", "retained_len")


def correlation_p_values(spark: SparkSession, d: str) -> DataFrame:
    """p of each coefficient: three numbers, taken on the driver."""
    rows = _pairs(spark, d)
    r, rho, tau = stats.pearson(rows, "term_count", "rendered_len").first(), stats.spearman(rows, "term_count", "rendered_len").first(), stats.kendall(rows, "rendered_len", "retained_len").first()
    out = [("pearson", r["r"], stats.t_test_p(r["r"], r["n"])), ("spearman", rho["rho"], stats.t_test_p(rho["rho"], rho["n"])), ("kendall", tau["tau"], stats.kendall_p(tau["tau"], tau["n"]))]
    return spark.createDataFrame(pd.DataFrame(out, columns=["metric", "value", "p"]), "metric string, value double, p double")


def rater_consensus(spark: SparkSession, d: str) -> DataFrame:
    return stats.rater_consensus(table(spark, d, "evaluation_results").select("image_filename", F.size("evaluation.evaluation_results").alias("score")), "image_filename")


def text_stats_by_combo(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.size(F.split(F.trim(F.col(f"`{c}`")), " "))
    rows = table(spark, d, "captions").select(
        F.array_join(select.content_labels(F.col("reasoning")), "+").alias("combination"), words("sci-RCoT").alias("long"), words("science_abstract_prompt").alias("short")
    )
    return stats.length_stats(rows.where("combination <> '' and long is not null and short is not null"), "combination", "long", "short")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captions").select("row_id", F.explode("reasoning").alias("track", "v")).where("v is not null")


def term_histogram(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size("v.terms"), F.lit(0)).cast("bigint")
    return _terms(spark, d).groupBy("track", n.alias("terms")).agg(F.count("*").alias("n"))


def keyword_freq(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select(F.explode("v.terms").alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("n"))


def subject_share(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "metadata").select(F.explode("subjects").alias("subject")).where("subject is not null")
    return stats.shares(rows, ["subject"])


def fpr_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").select("candidate_id", "batch", (F.col("retained_len") == 0).alias("wrong")).where("batch is not null and wrong is not null")
    return stats.false_positive_gate(rows, "batch", "wrong")


def audit_rates(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("retained_len") > 1, "pass").when(F.col("retained_len") == 1, "minor").otherwise("major")
    return stats.audit_rates(table(spark, d, "candidates").select("group_name", outcome.alias("outcome")), "group_name", "outcome")


def spot_check_10pct(spark: SparkSession, d: str) -> DataFrame:
    return sampling.spot_check(table(spark, d, "captions").select("row_id"), "row_id")


def quota_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").select("candidate_id", "group_name").distinct()
    return sampling.quota(rows, ["group_name"], "candidate_id", 20)


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evaluation_results").select("row_id", "mode", F.substring("image_filename", 1, 5).alias("stratum"))
    return sampling.quota(rows, ["mode", "stratum"], "row_id", 25)


def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.deal(table(spark, d, "captions").select("row_id"), "row_id", 3, total=450)


def dataset_repeat(spark: SparkSession, d: str) -> DataFrame:
    return sampling.repeat(table(spark, d, "captions").select("row_id"), 3).groupBy("repeat").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


def group_stage_sizes(spark: SparkSession, d: str) -> DataFrame:
    return stats.shares(table(spark, d, "candidates").select("group_name", "split"), ["group_name", "split"])


QUERIES = {
    f.__name__: f
    for f in (
        pearson, spearman, kendall, correlation_p_values, rater_consensus, text_stats_by_combo, term_histogram, keyword_freq, subject_share, fpr_gate,
        audit_rates, spot_check_10pct, quota_per_group, stratified_sample, audit_sample, dataset_repeat, group_stage_sizes,
    )
}

_P = "p as (select distinct candidate_id, cast(rendered_len as double) as rl, cast(retained_len as double) as tl, cast(term_count as double) as tc from candidates)"
_E = "e0 as (select row_id, unnest(map_entries(reasoning)) as kv from captions where reasoning is not null), e as (select row_id, kv.key as track, kv.value as v from e0 where kv.value is not null)"

ORACLE = {
    "pearson": f"with {_P} select count(*) as n, round(corr(tc, rl), 8) as r from p where tc is not null and rl is not null",
    "spearman": f"""
with {_P}, q as (select * from p where tc is not null and rl is not null),
r as (select rank() over (order by tc) + (count(*) over (partition by tc) - 1) / 2.0::double as x, rank() over (order by rl) + (count(*) over (partition by rl) - 1) / 2.0::double as y from q)
select count(*) as n, round(corr(x, y), 8) as rho from r""",
    "kendall": f"""
with {_P}, q as (select rl as x, tl as y, count(*) as c from p where rl is not null and tl is not null group by 1, 2),
s as (select sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) / 2 as s from q a, q b),
n as (select cast(sum(c) as double) as n from q),
tx as (select sum(c * (c - 1) / 2) as t from (select cast(sum(c) as double) as c from q group by x)), ty as (select sum(c * (c - 1) / 2) as t from (select cast(sum(c) as double) as c from q group by y))
select cast(n.n as bigint) as n, round(s.s / sqrt((n.n * (n.n - 1) / 2 - tx.t) * (n.n * (n.n - 1) / 2 - ty.t)), 8) as tau from s, n, tx, ty""",
    "rater_consensus": "select image_filename, round(avg(len(evaluation.evaluation_results)), 6) as consensus, count(evaluation.evaluation_results) as n_raters from evaluation_results group by 1",
    "text_stats_by_combo": f"""
with {_E}, lab as (select c.row_id, coalesce(string_agg(track, '+' order by track), '') as combination from captions c join e on e.row_id = c.row_id and len(v.terms) > 0
  and track in ('EntityStructure', 'ScientificLaw', 'ScientificProcess') group by c.row_id),
w as (select combination, len(string_split(trim("sci-RCoT", ' '), ' ')) as long, len(string_split(trim(science_abstract_prompt, ' '), ' ')) as short from captions join lab using (row_id))
select combination, count(*) as n, round(avg(long), 6) as mean_long, round(stddev_samp(long), 6) as std_long, round(avg(short), 6) as mean_short, round(stddev_samp(short), 6) as std_short,
  round(avg(long) / avg(short), 6) as ratio from w where long is not null and short is not null group by 1""",
    "term_histogram": f"with {_E} select track, coalesce(len(v.terms), 0) as terms, count(*) as n from e group by 1, 2",
    "keyword_freq": f"with {_E}, t as (select unnest(v.terms) as term from e) select term, count(*) as n from t where term is not null group by 1",
    "subject_share": "with s as (select unnest(subjects) as subject from metadata), t as (select * from s where subject is not null) select subject, count(*) as n, round(100.0::double * count(*) / (select count(*) from t), 6) as share from t group by 1",
    "fpr_gate": "with r as (select batch, count(*) as n, avg(case when retained_len = 0 then 1.0::double else 0 end) as rate from candidates where batch is not null and retained_len is not null group by 1) select batch, n, round(rate, 6) as rate from r where rate > 0.05::double",
    "audit_rates": """
with o as (select group_name, case when retained_len > 1 then 'pass' when retained_len = 1 then 'minor' else 'major' end as outcome from candidates)
select group_name, """
    + ", ".join(f"round(floor(1000::double * count(*) filter (outcome = '{o}') / count(*)) / 10, 1) as {o}" for o in ("pass", "minor", "major"))
    + " from o group by 1",
    "spot_check_10pct": f"select row_id from captions where substring(md5(cast(row_id as varchar)), 1, 8) < '{int(0.1 * 0x100000000):08x}'",
    "quota_per_group": "with c as (select distinct candidate_id, group_name from candidates) select candidate_id, group_name from c qualify row_number() over (partition by group_name order by md5(cast(candidate_id as varchar)), candidate_id) <= 20",
    "stratified_sample": "with c as (select row_id, mode, substring(image_filename, 1, 5) as stratum from evaluation_results) select * from c qualify row_number() over (partition by mode, stratum order by md5(cast(row_id as varchar)), row_id) <= 25",
    "audit_sample": "with c as (select row_id, row_number() over (order by md5(cast(row_id as varchar)), row_id) as r from captions) select row_id, cast((r - 1) % 3 + 1 as integer) as hand from c where r <= 450",
    "dataset_repeat": "select cast(unnest(range(3)) as integer) as repeat, n, ids from (select count(*) as n, cast(sum(row_id) as bigint) as ids from captions)",
    "group_stage_sizes": "select group_name, split, count(*) as n, round(100.0::double * count(*) / (select count(*) from candidates), 6) as share from candidates group by 1, 2",
}
