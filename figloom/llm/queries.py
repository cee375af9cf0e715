"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figloom.llm import components, cutoff, markup, mixture, mojibake, overlap, pairs, tokenise
from figloom.session import durable, run_folder, table


def _split_targets(spark: SparkSession, d: str) -> list[tuple[str, float]]:
    """The table of splits wanted; it names the splits, so it has a handful of rows whatever the data."""
    rows = table(spark, d, "split_targets").orderBy("split").collect()
    return [(r["split"], float(r["target_pct"])) for r in rows]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return components.linked_groups(table(spark, d, "candidates"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return components.split_records(table(spark, d, "candidates"), _split_targets(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    records = components.candidate_keys(table(spark, d, "candidates"))
    _, splits, _ = components.extend(records, _split_targets(spark, d))
    return components.split_report(splits, table(spark, d, "split_targets"))


def p1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Batch 2 first, then the others: what batch 2 was given stays, conflicting merges are quarantined."""
    targets = _split_targets(spark, d)
    rows = table(spark, d, "candidates")
    early = F.coalesce(F.col("batch") == 2, F.lit(False))
    path = f"{run_folder(spark)}/splits-{uuid.uuid4().hex}"
    for part in (early, ~early):  # each increment opens the table that the one before has kept
        kept = components.extend_kept(path, components.candidate_keys(rows.where(part)), targets)
    return components.split_report(kept.splits, table(spark, d, "split_targets"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    texts = markup.values(table(spark, d, "metadata"))
    return markup.labelled(texts, markup.fit(texts))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).where("found").select("row_id", "field")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.pair_ids(table(spark, d, "candidates"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "candidates"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    sft = table(spark, d, "scientific_cot_sft_stream")
    capt = table(spark, d, "captions")
    return sft.select(
        F.lit("scientific_cot_sft_stream").alias("table_name"), F.col("sft_id").alias("row_id"),
        F.col("input").alias("question"), F.col("output").alias("answer"),
    ).unionByName(capt.select(
        F.lit("captions").alias("table_name"), "row_id",
        F.col("science_abstract_prompt").alias("question"), F.col("sci-RCoT").alias("answer"),
    ))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d)
    return pairs.defects(rows, pairs.fit(table(spark, d, "documents"), rows))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("table_name", "defect").agg(F.count("*").alias("n"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    records = cutoff.scored(table(spark, d, "candidates"))
    chosen = cutoff.cutoffs(records, table(spark, d, "cutoff_targets"))
    return cutoff.kept(records, chosen).select("candidate_id").distinct()


def p6_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cutoffs(cutoff.scored(table(spark, d, "candidates")), table(spark, d, "cutoff_targets"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.encode(table(spark, d, "documents"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = mixture.sized(table(spark, d, "documents"))
    plan = durable(mixture.rates(sizes, table(spark, d, "mix_targets")), "plan")
    return mixture.mix(sizes, plan), plan


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.report(*_mix(spark, d))


def p8_filled_report(spark: SparkSession, d: str) -> DataFrame:
    """The mix of as many tokens as all documents have: sources stop at their repeats, the report shows the shortfall."""
    sizes = mixture.sized(table(spark, d, "documents"))
    plan = durable(mixture.rates(sizes, table(spark, d, "mix_targets"), sizes.agg(F.sum("n_tokens")).scalar()), "plan")
    return mixture.report(mixture.mix(sizes, plan), plan)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.found_ids(table(spark, d, "documents"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_splits, p1_report, p1_incremental, p2_found, p2_clean, p3_found, p3_report, p5_found, p5_report, p6_found, p6_cutoffs, p7_ids, p8_mix, p8_report, p8_filled_report, p9_found, p9_restored)
}

_P6 = """
with r as (
  select distinct candidate_id, term_count,
    array_to_string(list_sort(list_distinct(list_filter(list_transform(labels, lambda x: trim(x)), lambda x: x is not null and x <> ''))), '+') as label_set
  from candidates where term_count is not null and labels is not null),
s as (select * from r where label_set <> ''),
f as (select label_set, term_count, count(*) as n from s group by 1, 2),
c as (select label_set, term_count, sum(n) over (partition by label_set order by term_count desc) as n_kept,
             sum(n) over (partition by label_set) as n_records from f),
b as (select c.label_set, t.target_pct, max(c.term_count) as cutoff, any_value(c.n_records) as n_records, min(c.n_kept) as n_kept
      from c join cutoff_targets t using (label_set) where c.n_kept * 100 >= t.target_pct * c.n_records group by 1, 2)
"""

ORACLE: dict[str, str] = {
    "p1_found": r"""
with recursive r as (
  select distinct candidate_id,
    nullif(lower(regexp_replace(source_image_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '') as s,
    nullif(lower(regexp_replace(regexp_replace(regexp_replace(image_filename, '[\s\p{Z}]+$', ''), '^.*[/\\]', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '') as f
  from candidates),
m as (select f, min(s) as s0 from r where s is not null and f is not null group by f having count(distinct s) > 1),
e as (select distinct r.s as a, m.s0 as b from r join m using (f) where r.s is not null),
e2 as (select a, b from e union select b, a from e),
reach(a, b) as (select a, a from e2 union select reach.a, e2.b from reach join e2 on reach.b = e2.a),
comp as (select a as s, min(b) as root from reach group by a),
fs as (select f, min(s) as s0 from r where s is not null and f is not null group by f),
mem as (
  select r.candidate_id, comp.root from r join comp on r.s = comp.s
  union select r.candidate_id, comp.root from r join fs on r.f = fs.f join comp on fs.s0 = comp.s where r.s is null),
g as (select root, min(candidate_id) as group_first_id from mem group by root)
select g.group_first_id, mem.candidate_id from mem join g using (root)""",
    "p6_found": _P6 + "select distinct s.candidate_id from s join b on s.label_set = b.label_set and s.term_count >= b.cutoff",
    "p6_cutoffs": _P6 + """
select label_set, target_pct, cutoff, cast(n_records as bigint) as n_records, cast(n_kept as bigint) as n_kept,
  round(cast(n_kept as double) * 100.0 / cast(n_records as double), 4) as kept_pct from b""",
}
